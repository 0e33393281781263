"""The ten operators against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm import chat_format, exact_dedup, language_id, license_scan, near_dedup, packing, quality_rules, source_mix, substring_dedup, token_counts
from strataloom.llm.bpe import vocabulary
from strataloom.llm.common import Scratch, maybe_in, shared_dir, spread_join
from strataloom.llm.components import components
from strataloom.llm.hilbert import hilbert_key
from strataloom.llm.license_rules import RULES, SIGNATURES
from strataloom.llm.shingles import jaccard, shingles

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, quality string, exact string, node string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "k", "s", "q", "e", "n")


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empties, blanks, ties, repeated rows, a long text, copies, near copies and a shared passage."""
    rng = random.Random(11)
    base, shared = words(rng, 300), words(rng, 60)
    near = base.split()
    near[150] = "changed"
    rows = [
        row(1, base), row(2, base), row(3, base.replace(" ", "\n")), row(4, " ".join(near)), row(5, None), row(6, ""), row(7, " \t\n"), row(8, "x"), row(8, "x"), row(None, "null id"), row(9, None, None, None),
        row(10, words(rng, 120) + " " + shared + " " + words(rng, 100)), row(11, words(rng, 90) + " " + shared), row(12, words(rng, 60_000)), row(13, "ab" * 40_000), row(14, "Émile çà 日本語 ☃ <|endoftext|> x"), row(15, "a\x00b"), row(16, "ÀÉ " * 30 + "\n" + "same line\n" * 40, "fr", "ß"),
    ]
    return rows + [row(100 + i, words(rng, rng.randint(30, 200)), ["en", "fr", None][i % 3], ["s", "t", None, "u"][i % 4]) for i in range(80)]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 --------------------------------------------------------------------------


def test_cuts_move_with_insertions():
    rng = random.Random(1)
    for _ in range(30):
        raw = words(rng, 200).encode()
        ends = substring_dedup.cuts(raw).tolist()
        moved = [e + 9 for e in ends if e > 100]
        assert set(moved) <= set(substring_dedup.cuts(b"inserted " + raw).tolist()) and ends[-1] == len(raw)


def test_cuts_equal_in_pieces(monkeypatch):
    raw = words(random.Random(2), 3000).encode() + b"z" * 500
    whole = substring_dedup.cuts(raw).tolist()
    monkeypatch.setattr(substring_dedup, "_PIECE", 777)
    assert substring_dedup.cuts(raw).tolist() == whole


def test_gear_hash_is_the_rolling_one():
    raw = words(random.Random(3), 40).encode()
    got = substring_dedup._gear_hashes(np.frombuffer(raw, np.uint8))
    h = 0
    for i, b in enumerate(raw):
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFFFFFF
        assert i < 31 or int(got[i]) == h


def test_repeated_passages_are_found(docs, none):
    got = substring_dedup.substring_dedup(docs).collect()
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r)
    assert {10, 11, 1, 2, 4} <= found.keys() and not found.keys() & {5, 6, 7, 8, 9, 12, 13, 15, *range(100, 180)}
    assert {r["first_doc_id"] for r in found[11]} == {10} and any(r["kept"] for r in found[10]) and not any(r["kept"] for r in found[11])
    assert substring_dedup.substring_dedup(none).count() == 0


def test_spans_repeat_literally(docs, awkward):
    text = {r[0]: r[1].encode() for r in awkward if r[0] and r[1]}
    for r in substring_dedup.substring_dedup(docs).collect():
        if r["n_chunks"] == 1:
            part = text[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert sum(part in t for t in text.values()) > 1


def test_a_passage_beside_a_template_is_left_once(spark):
    rng = random.Random(13)
    head, passage = words(rng, 90), words(rng, 90)
    rows = [(i, f"{words(rng, 20)} {head} {words(rng, 20)}") for i in (1, 2, 3)] + [(i, f"{words(rng, 20)} {head} {passage} {words(rng, 20)}") for i in (7, 9)]
    left = {i: t.encode() for i, t in rows}
    spans = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in sorted(spans, key=lambda r: -r["start"]):
        if not r["kept"]:
            left[r["doc_id"]] = left[r["doc_id"]][: r["start"]] + left[r["doc_id"]][r["start"] + r["length"] :]
    for whole, at in ((head, [1]), (passage, [7])):
        middle = " ".join(whole.split()[30:60]).encode()
        assert [i for i, t in left.items() if middle in t] == at


def test_passages_of_51_words_are_found_whatever_the_word_length(spark):
    rng, rows, places = random.Random(14), [], {}
    for size in (1, 2, 3, 4, 9):
        for _ in range(40):
            passage = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(51))
            for _ in range(2):
                front = words(rng, rng.randint(0, 40)) + " "
                places[len(rows)] = (len(front), len(front) + len(passage))
                rows.append((len(rows), front + passage + rng.choice(["", "\n" + words(rng, 30)])))
    got = defaultdict(int)
    for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        a, b = places[r["doc_id"]]
        got[r["doc_id"]] += max(0, min(b, r["start"] + r["length"]) - max(a, r["start"]))
    assert [i for i, (a, b) in places.items() if 2 * got[i] < b - a] == []


# -- 2 --------------------------------------------------------------------------


def library_count(t):
    return len(vocabulary(PATH).library.encode(t or "", add_special_tokens=False).ids)


def test_token_counts(docs, none, awkward):
    got = Counter(map(tuple, token_counts.token_counts(docs, PATH).collect()))
    want = Counter((r[0], len((r[1] or "").encode()), n := library_count(r[1]), n > 2048) for r in awkward)
    assert got == want and token_counts.token_counts(none, PATH).count() == 0


def test_quick_cut_equals_the_library_for_every_common_character():
    for c in map(chr, range(0x250)):
        for t in (c, f"a{c}b", f"'{c}s", f"x {c}1"):
            assert token_counts.count_text(PATH, t) == library_count(t), repr(t)


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=80))
def test_any_text_counts_as_in_the_library(t):
    assert token_counts.count_text(PATH, t) == library_count(t)


# -- 3 --------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


LICENSES = [
    "Licensed under the Apache License, Version 2.0.", "GNU GENERAL PUBLIC LICENSE version 3, or any later version", "All  rights -- reserved. all rights reserved", "CC BY-NC 4.0; CC-BY", "SPDX-License-Identifier: MIT", "cc by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "the GNU Lesser General Public License v2.1", "no licence at all", "ACC BYE all rights are reserved",
]


def test_license_scan(spark, docs, none, awkward):
    rows = [*[(r[0], r[1]) for r in awkward], *[(1000 + i, t) for i, t in enumerate(LICENSES)]]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((i, *brute_base(t)) for i, t in rows)
    labels = {r["doc_id"]: r["labels"].split(",") for r in got}
    assert "apache-2.0" in labels[1000] and "gpl-3-or-later" in labels[1001] and "cc-by-nc-4.0" in labels[1003] and "spdx:mit" in labels[1004] and "mit" in labels[1006] and "lgpl-2.1" in labels[1007]
    assert labels[1008] == [""] and all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert len(RULES) > 300 and license_scan.license_scan(none).count() == 0


def test_kept_detections_lie_in_no_other():
    kept = license_scan.detections("licensed under the gnu affero general public license version 3 or later all rights reserved")
    assert [r.label for _, _, r in kept if "gpl" in r.label] == ["agpl-3-or-later"]
    assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] and b[2].priority > a[2].priority for a in kept for b in kept)


def test_every_alternative_of_a_rule_contains_its_gate():
    for rule in RULES:
        depth, alternatives = 0, [""]
        for c in rule.pattern.pattern.removeprefix(r"(?<!\S)(?:").removesuffix(r")(?!\S)"):
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                alternatives.append("")
            else:
                alternatives[-1] += c
        assert all(rule.gate in a for a in alternatives), rule
    for text, label in (("do what the fuck you want to public license", "wtfpl"), ("creative commons zero", "cc0-1.0"), ("mozilla public license 2 0 no copyleft exception", "mpl-2.0-no-copyleft-exception")):
        assert label in [r.label for _, _, r in license_scan.detections(text)]


# -- 4 --------------------------------------------------------------------------


def brute_classes(rows, same=0.8):
    sets = []
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in SPACE.split(w) if x]
        sets.append((tuple(w), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (w, s) in enumerate(sets):
        for j in range(i):
            v, t = sets[j]
            both = len(s & t)
            if w == v or both and both >= same * (len(s) + len(t) - both):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    ids = {k: min((x for x in g if x is not None), default=None) for k, g in groups.items()}
    return Counter((rows[i][0], ids[top(i)], len(groups[top(i)])) for i in range(len(rows)))


def test_near_classes(spark, docs, none, awkward):
    rows = [(r[0], r[1]) for r in awkward]
    got = near_dedup.near_dedup(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(rows)
    assert Counter(r["class_id"] for r in got if r["kept"]).most_common(1)[0][1] == 1
    assert near_dedup.near_dedup(none).count() == 0


@pytest.mark.parametrize("direct", [0, 64])
def test_near_classes_in_a_large_group_of_variants(spark, direct):
    rng = random.Random(5)
    base, rows = words(rng, 120).split(), []
    for i in range(120):
        w = base.copy()
        for k in rng.sample(range(120), rng.randint(0, 9)):
            w[k] = f"{w[k]}{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), direct=direct).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(rows)


def repeated_lines(rng):
    """Two texts whose shingle sets have a similarity of 0.8 or more; one repeats a third of its lines a hundred times."""
    body, line = words(rng, 70), words(rng, 33)
    left, right = f"{body} {line} {line}", " ".join([body, *[line] * 100])
    changed = left.split()
    changed[20] = "changed"
    return left, right, " ".join(changed)


def test_repeated_lines_are_not_screened_out():
    rng, missed, screened = random.Random(9), 0, 0
    for _ in range(150):
        texts = repeated_lines(rng)
        raw = [t.encode() for t in texts]
        assert (jaccard(raw[:1] * 2, raw[1:]) >= 0.8).all()
        _, _, keys, sig = near_dedup._sketch(list(texts))
        for other in (0, 2):
            missed += not (keys[1] == keys[other]).any()
            x = sig[1].view(np.uint64) ^ sig[other].view(np.uint64)
            screened += sum(int(v).bit_count() for v in (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)) > near_dedup._MISSES
    assert missed == screened == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a[:60] = 0
    keep_a, keep_b = a > 0, b > 0
    sig = near_dedup.signatures(np.concatenate((ids[keep_a], ids[keep_b])), np.concatenate((a[keep_a], b[keep_b])), np.array([0, keep_a.sum(), keep_a.sum() + keep_b.sum()]), 2048)
    p, q = a / a.sum(), b / b.sum()
    want = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in range(300) if p[i] and q[i])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_shingles_equal_in_pieces(monkeypatch):
    texts = [words(random.Random(i), n).encode() for i, n in enumerate((0, 1, 4, 5, 400, 3))]
    whole = shingles(texts)
    monkeypatch.setattr("strataloom.llm.shingles._PIECE", 64)
    assert all((x == y).all() for x, y in zip(whole, shingles(texts), strict=True))
    assert jaccard(texts, texts).tolist() == [1.0] * 6


def test_components(spark):
    rng = random.Random(8)
    edges = [(a, b) for a, b in ((rng.randint(0, 199), rng.randint(0, 199)) for _ in range(110)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    scratch = Scratch(spark, "test")
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), scratch).collect())) == {x: top(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


# -- 5 --------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


def test_source_mix(docs, none, awkward):
    got = source_mix.source_mix(docs).collect()
    size = lambda t: len([w for w in SPACE.split(t or "") if w])
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], size(r[1])) for r in awkward)
    sums = Counter()
    for r in awkward:
        sums[r[3]] += size(r[1])
    target, taken, largest = brute_targets(sums), Counter(), Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sums[r["source"]] and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    assert Counter(map(tuple, got)) == Counter(map(tuple, source_mix.source_mix(docs.repartition(2)).collect()))
    assert source_mix.source_mix(none).count() == 0


# -- 6 --------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = [x for x in SPACE.split(t) if x]
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def test_quality_rules(docs, none, awkward):
    got = quality_rules.quality_rules(docs).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *brute_quality(r[1])) for r in awkward)
    assert quality_rules.quality_rules(docs).filter("quality.kept AND quality.base_failed").count() == 0 and quality_rules.quality_rules(none).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    prose = "The river that runs by the old town was full of boats in the spring, and people from the hills came to see them.\n" * 1
    good = " ".join(f"{prose.strip()} Number {w} of the story is told by an old man." for w in ("one", "two", "three", "four", "five", "six"))
    distinct = " ".join(f"the w{''.join(random.Random(i).choices('abcdefg', k=5))} and" for i in range(60))
    rows = [(1, distinct), (2, distinct.replace(" ", "%% ")), (3, distinct.upper().replace(" ", "!! ")), (4, good[:100])]
    got = dict(map(tuple, quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "quality.kept").collect()))
    assert got == {1: True, 2: False, 3: False, 4: False}


# -- 7 --------------------------------------------------------------------------


def test_packing(docs, none, awkward):
    pieces = packing.packing(docs, PATH).collect()
    want = Counter()
    for r in awkward:
        ids = np.array([*vocabulary(PATH).library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r[0], len(ids), ids.tobytes()] += 1
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append(p)
        assert any(zlib.crc32(np.frombuffer(b, "<u4")[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for d, n, b in want if d == p["doc_id"] and n == p["doc_tokens"])
    for seq in by_seq.values():
        seq.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in seq] == [0, *np.cumsum([p["length"] for p in seq])[:-1]]
        total = sum(p["length"] for p in seq)
        assert total <= 2048 and total & (total - 1) == 0
    places = Counter((p["doc_id"], p["doc_tokens"], i) for p in pieces for i in range(p["start"], p["start"] + p["length"]))
    assert places == Counter({(d, n, i): c for (d, n, _), c in _by_size(want).items() for i in range(n)})
    assert packing.packing(none, PATH).count() == 0


def _by_size(want):
    out = Counter()
    for (d, n, _), c in want.items():
        out[d, n, None] += c
    return out


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 50), max_size=12), st.integers(2, 16))
def test_streams_are_cut_without_gaps(sizes, length):
    docs = [(i, np.arange(n)) for i, n in enumerate(sizes)]
    seen = defaultdict(list)
    for d, start, part, size, _, _ in packing.pack_stream(iter(docs), length):
        assert part.tolist() == list(range(start, start + len(part))) and size == sizes[d]
        seen[d] += part.tolist()
    assert all(seen[i] == list(range(n)) for i, n in enumerate(sizes))


# -- 8 --------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_id_on_awkward_rows(docs, none, awkward):
    model = language_id.fit(docs)
    got = language_id.language_id(docs, model).collect()
    assert len(got) == len(awkward) and {r["lang_pred"] for r in got} <= {"en", "fr", "und"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {5, 6, 7, 9}
    assert language_id.fit(none) is None and language_id.language_id(none, None).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(docs, None).collect()} == {"und"}


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts, langs = [words(rng, 30) + " the" for _ in range(20)] + ["zz" + words(rng, 30).replace("a", "z") for _ in range(20)], ["a"] * 20 + ["z"] * 20
    model = language_id.train(texts, langs)
    whole = model.logits(texts)
    monkeypatch.setattr(language_id, "_PIECE", 50)
    assert np.allclose(whole, model.logits(texts), atol=1e-4)


# -- 9 --------------------------------------------------------------------------


def test_preference_pairs(spark):
    t = lambda pair, chosen, *turns: [(pair, chosen, i, r, x, "extra") for i, (r, x) in enumerate(turns)]
    hi, good, bad = ("user", "hi"), ("assistant", "good"), ("assistant", "bad")
    rows = t(1, True, hi, good) + t(1, False, hi, bad) + t(2, True, hi, good) + t(2, False, hi, good) + t(3, True, hi, good) + t(4, True, hi, good, hi) + t(4, False, hi, good)
    rows += t(5, True, hi, (None, None)) + t(5, False, hi, bad) + rows[:1] + [(None, True, None, "user", "x", "e")]
    df = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string, part string")
    got = defaultdict(list)
    for r in chat_format.preference_pairs(df).orderBy("pair_id", "part", "turn").collect():
        got[r["pair_id"], r["part"]].append(r)
    shape = {k: [x["turn"] for x in v] for k, v in got.items()}
    assert shape == {(1, "prompt"): [0], (1, "chosen"): [1], (1, "rejected"): [1], (2, "prompt"): [0, 1], (3, "chosen"): [0, 1], (4, "prompt"): [0, 1], (4, "chosen"): [2], (5, "prompt"): [0], (5, "chosen"): [1], (5, "rejected"): [1], (None, "chosen"): [None]}
    x = got[1, "chosen"][0]
    assert x["rendered"][x["loss_from"] : x["loss_to"]] == "good<|end|>\n" and got[1, "prompt"][0]["loss_from"] is None and got[5, "chosen"][0]["role"] == "unknown"
    assert chat_format.preference_pairs(df.limit(0)).count() == 0


# -- 10 -------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((i, t))
    out = Counter()
    for g in groups.values():
        keep = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        out.update((i, keep, len(g)) for i, _ in g)
    return out


def test_exact_groups(docs, none, awkward):
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r["doc_id"], r["exact"]["keep_id"], r["exact"]["group_size"]) for r in got) == brute_exact([(r[0], r[1]) for r in awkward])
    assert sum(r["exact"]["kept"] for r in got) == len({SPACE.sub("", r[1] or "") for r in awkward})
    assert exact_dedup.exact_dedup(none).count() == 0 and {"kept", "size", "node"} <= set(got[0].asDict())


def test_exact_groups_part_on_every_level(spark):
    stem = "s" * 40_000
    rows = [(i, stem[:n] + tail) for i, (n, tail) in enumerate([(63, "a"), (63, "b"), (63, "a"), (570, "ab"), (570, "ac"), (570, "ab"), (5000, "x"), (5000, "y"), (40_000, "1"), (40_000, "2"), (40_000, "1"), (64, ""), (64, " ")])]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["exact"]["keep_id"], r["exact"]["group_size"]) for r in got) == brute_exact(rows)


def test_exact_query_gives_the_digest(spark):
    r = exact_dedup.query(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "doc_id").first()
    assert r["text_sha256"] == hashlib.sha256(SPACE.sub("", r["text"]).encode()).hexdigest()


# -- what the operators share ----------------------------------------------------


def test_spread_join_deals_hot_keys(spark):
    rows = spark.range(4000).selectExpr("if(id < 3000, 0, id) AS k", "id AS v")
    groups = Scratch(spark, "test").write(rows.groupBy("k").count().filter("k % 2 = 0").withColumn("name", F.concat(F.lit("g"), "k")), "groups")
    want = {(k, v, f"g{k}") for v in range(4000) if (k := 0 if v < 3000 else v) % 2 == 0}
    joined = spread_join(rows, groups, ["k"], "count", "v").select("k", "v", "name")
    assert {tuple(r) for r in joined.collect()} == want and joined.count() == len(want)
    assert spread_join(rows, groups, ["k"], "count", "v", "left").filter("name is null").count() == 500


def test_bitmap_filter_misses_nothing(spark):
    wanted = Scratch(spark, "test").write(spark.range(500).select(F.xxhash64("id").alias("hash")), "hashes")
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("hash"))
    got = {r["id"] for r in maybe_in(rows, wanted, "hash").collect()}
    assert set(range(500)) <= got and len(got) < 4000
    assert maybe_in(rows, wanted.filter("false"), "hash").count() == 0


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_clashing_names(spark):
    names = ["Quality", "EXACT", "__x_rest", "__x_", "row", "a.b", "Size", "n_words", "bands", "tie", "KEY", "uid", "class"]
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None)]
    docs = spark.createDataFrame(rows, ["doc_id", "text"]).withColumns({"source": F.lit("s")} | {n: F.lit("x") for n in names})
    assert quality_rules.quality_rules(docs).count() == 3
    kept = {r["doc_id"]: r["exact"]["kept"] for r in exact_dedup.exact_dedup(docs).collect()}
    assert kept == {1: True, 2: False, 3: True}
    assert {r["doc_id"] for r in near_dedup.near_dedup(docs).filter("kept").collect()} == {1, 3}
    assert source_mix.source_mix(docs).count() == 3 and packing.packing(docs, PATH).agg(F.sum("length")).first()[0] == 15
    assert license_scan.license_scan(docs).count() == token_counts.token_counts(docs, PATH).count() == 3


# -- 3, again --------------------------------------------------------------------


def test_contained_detections_go_as_by_the_definition():
    rng = random.Random(5)
    pieces = ["apache license version 2 0", "licensed under the apache license version 2 0", "gnu general public license version 2 or any later version", "general public license", "cc by sa 4 0", "creative commons", "all rights reserved", "mit license", "copyright c 2020 2021", "as is", "x", "y z"]
    for _ in range(60):
        text = " ".join(rng.choices(pieces, k=rng.randint(1, 40)))
        found = sorted((-r.priority, i, *m.span(), r) for i, r in enumerate(RULES) if r.gate in text for m in r.pattern.finditer(text))
        kept = []
        for _, _, a, b, r in found:
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, r))
        assert license_scan.detections(text) == sorted(kept, key=lambda x: (x[0], x[1]))
        got = license_scan.scan_text(text)
        assert got["spans"] == [(text.count(" ", 0, a), text.count(" ", 0, b) + 1, r.label) for a, b, r in sorted(kept, key=lambda x: (x[0], x[1]))]


def test_a_file_of_notices_takes_seconds():
    began = time.monotonic()
    got = license_scan.scan_text("All rights reserved. é " * 100_000)
    assert time.monotonic() - began < 20
    assert (got["n_base"], len(got["spans"]), got["first_word"], got["last_word"]) == (100_000, 100_000, 0, 399_996)


def test_hundreds_of_patterns_are_written_by_hand():
    lines = [line.split(" | ", 3)[3] for line in SIGNATURES.strip().splitlines()]
    assert len(set(lines)) == len(lines) >= 200


# -- 1, again --------------------------------------------------------------------


def brute_spans(rows, least):
    """The definition, byte by byte: (doc, start, length, first_doc)."""
    gear = [int(x) for x in substring_dedup._GEAR]
    blank = b" \t\n\x0b\x0c\r"

    def pieces(raw):
        h = []
        for i in range(len(raw)):
            back = raw[max(0, i - 31) : i + 1]
            h.append(sum(gear[b] << (len(back) - 1 - k) for k, b in enumerate(back)) % (1 << 32))
        full = [x if i >= 31 else 0 for i, x in enumerate(h)]
        tops = [i for i, x in enumerate(full) if x and x == max(full[max(0, i - 20) : i + 21])]
        ends = [i + 1 for k, i in enumerate(tops) if not k or i - tops[k - 1] > 20]
        ends = [e for e in ends if e < len(raw)] + [len(raw)] * bool(raw)
        out = [(a, b, False) for a, b in zip([0, *ends], ends, strict=False)]
        word = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        at = [k for k, (_, e) in enumerate(word) if e < len(raw)]
        chosen = {max(at[k : k + 20], key=lambda w: (h[word[w][1]], w)) for k in range(len(at) - 19)}
        out += [(word[w - 15][0], word[w + 16][1], True) for w in chosen if w >= 15 and w + 16 < len(word)]
        return [(a, b, wide, raw[a:b]) for a, b, wide in out]

    docs = {(i, (t or "").encode()) for i, t in rows}
    cut = {d: pieces(d[1]) for d in docs}
    holders = defaultdict(set)
    for d, ps in cut.items():
        for *_, content in ps:
            holders[content].add(d)
    out = []
    for (i, raw), ps in cut.items():
        first, wide = [()] * len(raw), [False] * len(raw)
        touch = [False] * (len(raw) + 1)
        for a, b, w, content in ps:
            if len(holders[content]) > 1:
                low = min((d[0] for d in holders[content] if d[0] is not None), default=None)
                for k in range(a, b):
                    first[k] = (min([x for x in (*first[k], low) if x is not None], default=None),)
                    wide[k] |= w
                    touch[k] = True
        k = 0
        while k < len(raw):
            if not touch[k]:
                k += 1
                continue
            end = k
            while touch[end]:
                end += 1
            if any(wide[k:end]) or end - k >= least:
                while k < end:
                    stop = k
                    while stop < end and first[stop] == first[k]:
                        stop += 1
                    out.append((i, k, stop - k, first[k][0]))
                    k = stop
            k = end
    return out


def test_spans_as_by_the_definition(spark):
    rng = random.Random(23)
    shared, template = words(rng, 70), words(rng, 45)
    rows = [(1, template + " " + words(rng, 40)), (2, words(rng, 30) + " " + template + " " + shared), (3, template + " " + shared + " " + words(rng, 20)), (4, shared), (5, shared), (6, None), (7, ""), (None, words(rng, 8) + " " + shared), (8, "aa " * 300), (9, "aa " * 250), (9, "aa " * 250)]
    rows += [(20 + i, words(rng, rng.randint(1, 80)) + " " + rng.choice([shared, template, ""])[: rng.randint(0, 500)]) for i in range(25)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["start"], r["length"], r["first_doc_id"]) for r in got))) == sorted(map(repr, brute_spans(rows, substring_dedup.LEAST)))
    assert all(r["kept"] == (r["first_doc_id"] == r["doc_id"]) for r in got)


# -- 7, again --------------------------------------------------------------------


def test_sequences_follow_the_curve(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(5, 400))) for i in range(150)]
    got = packing.packing(spark.createDataFrame(rows, "doc_id long, text string"), PATH).filter("start = 0").orderBy("sequence_id", "offset").collect()
    e = packing.encoder(PATH)
    keys = dict(zip((i for i, _ in rows), packing.curve_keys([e.encode(t) for _, t in rows], e.kind, e.vocabulary.size).tolist(), strict=True))
    along = [keys[r["doc_id"]] for r in got]
    assert along == sorted(along) and len(set(along)) > 100


def test_words_are_cut_and_merged_once(monkeypatch):
    """A piece that has been met is neither cut nor encoded again, whatever texts it stands in."""
    rng = random.Random(7)
    bag = [w + m for w in words(rng, 40).split() for m in ("", ",", "!?", "'s")]
    texts = [" ".join(rng.choices(bag, k=500)) for _ in range(20)]
    vocab, cut = vocabulary(PATH), []
    monkeypatch.setattr(vocab, "words", lambda text, f=vocab.words: cut.append(len(text)) or f(text))
    e = packing.Encoder(PATH)
    got = [e.encode(t) for t in texts]
    assert sum(cut) <= sum(map(len, set(bag)))
    assert [np.frombuffer(g, e.kind).tolist() for g in got] == [[*vocab.library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_ids_are_the_librarys():
    """Every white space, marks behind words, special strings, code points that change or combine; batches and slices."""
    rng = random.Random(8)
    parts = [*" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2028\u3000\u200b\x00\x7fabBsHE'.,;:!?)(<|>_1½²éÉ\u0301\u0338\u0331İıẞΣ日が한ﬁǄÅ\u0345", "  ", "re", "'LL", "don't", "<|endoftext|>", "<|startoftext|>", "<|endof", "👩\u200d💻"]
    texts = ["", None, *["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)], "ab" * 40_000]
    e = packing.encoder(PATH)
    got = e.encode_all(pa.array(["before", *texts])[1:]).to_pylist()
    assert [np.frombuffer(g, e.kind).tolist() for g in got] == [[*vocabulary(PATH).library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_curve_keys_in_blocks_and_parts(monkeypatch):
    rng = random.Random(9)
    e = packing.encoder(PATH)
    ids = [e.encode(words(rng, rng.randint(0, 300))) for _ in range(40)]
    want = packing.curve_keys(ids, e.kind, e.vocabulary.size)
    monkeypatch.setattr(packing, "BLOCK", 100)
    assert packing.curve_keys(ids, e.kind, e.vocabulary.size).tolist() == want.tolist() == [packing.curve_keys([i], e.kind, e.vocabulary.size)[0] for i in ids]
    monkeypatch.setattr(packing, "PART", 100)
    batch = pa.record_batch({"doc_id": range(9), "text": ["x" * 40 * i for i in range(9)]})
    light = list(packing._light(batch))
    assert pa.Table.from_batches(light).equals(pa.Table.from_batches([batch])) and all(b.num_rows == 1 or b.column(1).nbytes <= 100 for b in light)


# -- 8, again --------------------------------------------------------------------


@pytest.mark.parametrize(("text", "letters"), [("½", False), ("12 ²", False), ("Ⅷ", False), ("7", False), ("_-!", False), ("ª", True), ("日", True), ("x1", True)])
def test_only_letters_are_letters(text, letters):
    model = language_id.train(["le chat dort", "the cat sleeps"] * 10, ["fr", "en"] * 10)
    lang, score = model.predict([text])
    assert (lang[0] != "und") == letters == (score[0] > 0)


# -- 9, again --------------------------------------------------------------------


def test_preference_pairs_of_any_kind(spark):
    rows = [("p", True, 0, "user", "hi"), ("p", None, 0, "user", "hi"), ("p", True, 1, "assistant", "a" * 300_000), ("p", False, 1, "assistant", "b"), (None, None, 0, "user", "x"), (None, True, 0, "user", "x"), ("q", None, None, None, None)]
    turns = spark.createDataFrame(rows, "pair_id string, chosen boolean, turn long, role string, text string").withColumns({"pair": F.lit(1), "of": F.lit(2), "C": F.lit(3)})
    got = {(r["pair_id"], r["part"], r["turn"], r["n_chars"]) for r in chat_format.preference_pairs(turns).collect()}
    mark = len("<|user|>\n<|end|>\n")
    assert {g[:3] for g in got} == {("p", "prompt", 0), ("p", "chosen", 1), ("p", "rejected", 1), (None, "prompt", 0), ("q", "rejected", None)}
    assert ("p", "prompt", 0, mark + 2) in got and max(g[3] for g in got) > 300_000
    assert chat_format.preference_pairs(turns.limit(0)).count() == 0
