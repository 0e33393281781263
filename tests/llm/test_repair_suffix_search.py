"""Structure repair, suffix-array dedup and lexical search against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import lexical_search, suffix_dedup, turn_repair
from strataloom.llm.common import Scratch
from strataloom.llm.earley import parse
from strataloom.llm.queries import QUERIES
from tests.test_oracle import SF

WHITE = " \t\n\x0b\x0c\r"
STEP = {"S": {"s": "B", "u": "U"}, "B": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}


# -- 11 -------------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit, rows that come out), by going backwards over all rows and states; rows: role, text, must go, truncated."""
    n = len(rows)
    best = {(n, s): (0, "", ()) for s in "SA"}
    for i in range(n, -1, -1):
        here = {}
        for s, step in STEP.items():
            ways = [best[i, s]] if (i, s) in best else []
            if i < n:
                role, text, must, cut = rows[i]
                edits = [(s, 3, "D", ())]
                if not must:
                    edits += [(step.get(role[:1]), cut, "K", ((role, text),))]
                    edits += [(step.get(r[0]), 2 + cut, "R", ((r, text),)) for r in ("user", "assistant")]
                for t, cost, letter, out in edits:
                    if (i + 1, t) in best:
                        b = best[i + 1, t]
                        ways.append((cost + b[0], letter + b[1], out + b[2]))
            if ways:
                here[s] = min(ways)
        for _ in range(5):  # insertions, as often as there are states
            for s, step in STEP.items():
                for r in ("user", "assistant"):
                    if step.get(r[0]) in here:
                        b = here[step[r[0]]]
                        here[s] = min(here.get(s, (math.inf,)), (2 + b[0], "I" + b[1], ((r, ""), *b[2])))
        best |= {(i, s): v for s, v in here.items()}
    return best[0, "S"]


def repaired(rows):
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        own, role, text = conversations[c], " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for c, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, n = set(), [], Counter()
        for _, role, text in own:
            core = text.rstrip(WHITE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
            n[fault] += 1
            seen.add((role, text))
            faults.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:], strict=False))
        cost, audit, result = cheapest(faults)
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in result).encode()).hexdigest()))
    return sorted(out, key=repr)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " "]), st.booleans(), st.booleans()), max_size=9), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_charts_hold_the_cheapest_edits(rows, cut):
    whole = parse([(r[:1], m, t and not m) for r, m, t in rows])
    want = cheapest([(r, "x", m, t and not m) for r, m, t in rows])
    assert min((whole[s] for s in "SA" if s in whole), key=lambda v: v[:2])[:2] == want[:2]
    # charts of two parts, joined, are the chart of the whole
    items = [(r[:1], m, t and not m) for r, m, t in rows]
    joined = {}
    for s, a in parse(items[:cut]).items():
        for t, b in parse(items[cut:], s).items():
            v = (a[0] + b[0], a[1] + b[1], a[2] + b[2])
            joined[t] = min(joined.get(t, v), v)
    assert joined == whole


def test_repair_equals_brute_force(spark):
    df = QUERIES["op11_turn_repair"](spark, SF)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, df.collect()), key=repr) == repaired(rows)


def test_repair_of_awkward_rows_in_short_parts(spark, monkeypatch):
    """Nulls everywhere, repeated rows, unknown roles, a conversation of hundreds of rows dealt over parts and tasks."""
    monkeypatch.setattr(turn_repair, "PART", 7)
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]) if i % 2 else 9, rng.choice([None, 1, 2, 3, 5, *range(20, 60)]), rng.choice(["system", "user", "assistant", "tool", None, "user", "assistant", ""]), rng.choice([None, "", " \t", "yes.", "no", "what?  ", "hm...\n", "é", "ok!"]), "x", "y") for i in range(400)]
    rows += rows[:20] + [(4, None, None, None, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, part string").repartition(5)
    assert sorted(map(tuple, turn_repair.repair_damaged(df).collect()), key=repr) == repaired([r[:4] for r in rows])


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair_damaged(none).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "x.")], none.schema)
    assert [tuple(r) for r in turn_repair.repair_damaged(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_rows(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "user", "Hi!"), (1, 3, "user", "Hello?"), (1, 4, "assistant", "Yes")]
    report, out = turn_repair.turn_repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Scratch(spark, "test"))
    assert [tuple(r)[6:] for r in report.collect()] == [(3, "KKIKK")]
    assert [tuple(r)[3:] for r in out.orderBy("part", "place").collect()] == [("K", "system", "Be kind."), ("K", "user", "Hi!"), ("I", "assistant", ""), ("K", "user", "Hello?"), ("K", "assistant", "Yes")]


# -- 12 -------------------------------------------------------------------------


def without_repeats(raws, least):
    seen = Counter(r[p : p + least] for r in raws for p in range(len(r) - least + 1))
    out = []
    for r in raws:
        end, spans = 0, []
        for p in range(len(r) - least + 1):
            if seen[r[p : p + least]] > 1:
                if spans and p <= end:
                    spans[-1][1] = p + least - spans[-1][0]
                else:
                    spans.append([p, least])
                end = p + least
        gone = {i for x, n in spans for i in range(x, x + n)}
        out.append((len(r), tuple(map(tuple, spans)), bytes(b for i, b in enumerate(r) if i not in gone)))
    return out


def found(df):
    return sorted(((r["doc_id"], (r["n_bytes"], tuple((s["start"], s["length"]) for s in r["spans"]), bytes(r["kept"]))) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("letters", "widths"), [("abcdefgh", (8, 3, 1)), ("ab", (8, 1)), ("aé", (1,))])
def test_suffix_dedup_equals_brute_force(spark, letters, widths):
    """Near copies, periods, texts just long enough, repeated rows, null ids and texts, clashing names."""
    rng = random.Random(5)
    base = ["".join(rng.choices(letters, k=300)) for _ in range(5)]
    texts = []
    for _ in range(30):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        at = rng.randrange(250)
        texts.append("".join(rng.choices("abcdefghé", k=rng.randint(0, 50))) + "".join(b[at : at + rng.randint(10, 200)]) + "".join(rng.choices("abcdefgh", k=rng.randint(0, 50))))
    texts += ["a" * 300, "ab" * 150, "abc" * 80 + "q" + "abc" * 40, None, "", "same", "x" * 24, "y" * 25, base[0], base[0]]
    ids = [None if i % 9 == 8 else i for i in range(len(texts))]
    rows = [(i, t, 1, 2, "x") for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, Held string").repartition(3)
    want = without_repeats([(r[1] or "").encode() for r in rows], 24)
    assert found(suffix_dedup.suffix_dedup(df, least=24, gram=8, widths=widths)) == sorted(zip([r[0] for r in rows], want, strict=True), key=repr)


def test_suffix_dedup_query(spark):
    df = QUERIES["op12_suffix_dedup"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = without_repeats([(r["text"] or "").encode() for r in docs], 200)
    assert sum(len(x[1]) for x in want) > 20
    assert sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == sorted((r["doc_id"], n, sum(y for _, y in s), len(s), hashlib.sha256(k).hexdigest()) for r, (n, s, k) in zip(docs, want, strict=True))


def test_suffix_dedup_of_nothing_and_of_long_texts(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=700_000))
    texts = ["q" + long, long[400_000:400_300] + "!", "z" * 300_000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(found(suffix_dedup.suffix_dedup(df)))
    assert [got[i][1] for i in range(4)] == [((400_001, 300),), ((0, 300),), ((0, 300_000),), ()]


def test_runs_equal_in_pieces(monkeypatch):
    raw = "".join(random.Random(2).choices("abc", k=4000)).encode() + b"z" * 600
    whole = [x.tolist() for x in suffix_dedup.runs(raw, 40, 12)]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 333)
    assert [x.tolist() for x in suffix_dedup.runs(raw, 40, 12)] == whole
    h = suffix_dedup.grams(np.frombuffer(raw, np.uint8), 12)
    start, place, _ = map(np.array, whole)
    cut = h & ~np.uint64((1 << suffix_dedup._PIECE_BITS) - 1)
    for p in range(0, len(raw) - 39, 17):
        i = np.searchsorted(start, p, "right") - 1
        assert place[i] == p + int(np.argmin(cut[p : p + 29]))


# -- 13 -------------------------------------------------------------------------


def ranked(docs, items, best=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(words(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = Counter(w for _, c in own for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for w, f in df.items()}
    out = []
    for item, text in set(items):
        asked = words(text)
        scores = []
        for d, c in own:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in asked if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("full", "block", "chunk"), [(2_000_000, 1024, 1 << 16), (40, 3, 16)])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, full, block, chunk):
    """One shard or many, one block of items or several; ties, repeated rows, null ids, texts without terms, clashing names."""
    monkeypatch.setattr(lexical_search, "_CHUNK", chunk)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(["Émile", "A", "b", "x1", "naïve", "日本", "The", "the", "q-r", "zz"], k=n))
    docs = [(None if i % 17 == 3 else rng.randrange(60), text(rng.randint(0, 30)), "s", "t") for i in range(80)] + [(90, None, "s", "t"), (91, "", "s", "t"), (92, "—!", "s", "t"), (93, "a" * 50_000 + " b" * 2000, "s", "t")]
    docs += docs[:5]
    items = [(i, text(rng.randint(0, 12))) for i in range(12)] + [(20, None), (21, "unheard of"), (None, "The zz")]
    items.append(items[0])
    df = spark.createDataFrame(docs, "doc_id long, text string, term string, Shard string").repartition(3)
    index = lexical_search.build_index(df, f"{tmp_path}/index", full=full)
    assert index.filter("term IS NULL").count() >= (3 if full > 40 else 10)
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked([d[:2] for d in docs], items)


def test_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = lexical_search.build_index(none, f"{tmp_path}/none")
    assert lexical_search.search(index, items).count() == 0
    index = lexical_search.build_index(spark.createDataFrame([(1, "a"), (2, "b")], none.schema), f"{tmp_path}/two")
    assert lexical_search.search(index, items.limit(0)).count() == 0 and lexical_search.search(index, items, best=1).count() == 1


@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_packed_numbers_come_back(values):
    raw, sizes = lexical_search.pack(np.array(values, np.int64))
    assert lexical_search.unpack(raw).tolist() == values and sizes.sum() == len(raw)
