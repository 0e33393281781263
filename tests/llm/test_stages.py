"""The pipeline's stages and operators 1, 4 and 8 on awkward tables, and language scores by slow arithmetic."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataloom.llm import language_id, near_dedup, substring_dedup
from strataloom.llm.common import Scratch
from tests.llm.test_operators import SPACE, awkward, brute_classes, docs, none, words  # noqa: F401

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def clashing(docs):  # noqa: F811
    """The awkward table twice over in part, with further columns of names that the code uses itself."""
    more = docs.withColumns({"Key": F.lit("k"), "row": F.lit(1), "__map": F.lit(2), "copies": F.lit("c"), "a.b": F.lit(3), "row_a": F.lit(4), "Held": F.lit(5)})
    return more.unionByName(more.filter("doc_id < 5 OR doc_id IS NULL")).repartition(3).cache()


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def run(stage, spark, df):
    out = STAGES[stage](spark, df, "unused")
    assert out.columns == df.columns
    return rows_of(out)


def test_quality_stage(spark, clashing):
    before, kept = rows_of(clashing), run("quality rules", spark, clashing)
    assert all(n == before[r] for r, n in kept.items()) and kept  # repeated rows share their fate
    assert all(len((r[1] or "").split()) >= 50 for r in kept)


def test_exact_stage(spark, clashing):
    before, kept = rows_of(clashing), run("exact dedup", spark, clashing)
    groups: dict = {}
    for r in before:
        groups.setdefault(SPACE.sub("", r[1] or ""), []).append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(map(repr, kept.elements())) == sorted(map(repr, best))


def test_near_stage(spark, clashing):
    kept = run("near dedup", spark, clashing)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in clashing.collect()])
    assert max(kept.values()) == 1
    assert sorted(((r[0] is None, r[0] or 0) for r in kept)) == sorted({(c is None, c or 0) for _, c, _ in classes})


def test_mix_stage(spark, clashing):
    before, taken = rows_of(clashing), run("source mix", spark, clashing)
    assert all(n <= 3 * before[r] for r, n in taken.items()) and sum(taken.values()) > 0.3 * sum(before.values())


def test_pack_stage(spark, clashing):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    small = clashing.filter("length(text) < 5000 OR text IS NULL")
    want = Counter()
    for r in small.collect():
        want.update((r["doc_id"], k) for k in range(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1))
    got = Counter()
    for p in STAGES["packing"](spark, small, "unused").collect():
        got.update((p["doc_id"], k) for k in range(p["start"], p["start"] + p["length"]))
    assert got == want


def test_stages_of_nothing(spark, none):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "unused")
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_operators_ignore_other_columns(clashing):
    plain = clashing.select("doc_id", "text", "lang")
    for f in (lambda d: substring_dedup.substring_dedup(d), lambda d: language_id.language_id(d, MODEL)):
        assert rows_of(f(clashing)) == rows_of(f(plain))


# -- 4: members of one shingle that meet block by block ---------------------------


def test_hot_shingles_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    shared, top = words(rng, 5), words(rng, 60).split()
    texts = {0: " ".join(top)}
    for i in range(1, 160):
        w = top[: rng.randint(48, 58)] + [f"x{rng.randint(0, 2)}"] + shared.split()
        texts[i] = " ".join(w)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "node long, text string")
    sketch = near_dedup._sketches(df.withColumn("doc_id", F.col("node")), "doc_id", "text", F.lit(0))
    members = df.filter("node > 0").select(F.lit(0).cast("long").alias("head"), "node", F.col("node").alias("class"))
    pairs = {}
    for meet in (10**6, 40):
        monkeypatch.setattr(near_dedup, "MEET", meet)
        scratch = Scratch(spark, "test")
        nodes = scratch.write(sketch.select(F.col("id").alias("node"), "n", "sig"), "nodes")
        pairs[meet] = {(r["a"], r["b"]) for r in near_dedup._rare_pairs(members, df, nodes, scratch).collect()}
    assert pairs[40] == pairs[10**6] and len(pairs[40]) > 100
    words_of = {i: t.split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words_of.items()}
    similar = {(a, b) for a in sets for b in sets if 0 < a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and words_of[a] != words_of[b]}
    assert similar <= pairs[40]


def test_near_classes_with_every_search(spark):
    """No spare buckets, and no direct comparison: the classes stay."""
    rng = random.Random(15)
    base, rows = words(rng, 100).split(), []
    for i in range(90):
        w = base.copy()
        for k in rng.sample(range(100), rng.randint(0, 8)):
            w[k] = f"{w[k]}{rng.randint(0, 2)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dedup(df, spare=0, direct=4).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(rows)


# -- 8 ----------------------------------------------------------------------------

RNG = random.Random(3)
MODEL = language_id.train([words(RNG, 30) + " the" for _ in range(20)] + ["zz" + words(RNG, 30).replace("a", "ž") for _ in range(20)], ["a"] * 20 + ["z"] * 20)


def slow_score(model, text):
    """(language, probability) with one subword after the other."""
    raw = " " + "".join(c if c.isalpha() or ord(c) >= 128 else " " for c in text.lower()) + "   "
    buf = raw.encode()
    total, n = np.zeros(language_id.DIMENSIONS), 0
    for i in range(len(buf) - 3):
        for k in language_id.GRAMS:
            value = int.from_bytes(buf[i : i + k], "big") * 0x9E3779B1 & 0xFFFFFFFF
            total += model.embedding[(value >> (32 - language_id.BITS)) + (language_id.GRAMS.index(k) << language_id.BITS)].astype(float)
            n += 1
    logits = (total / n) @ model.weights.astype(float) + model.bias
    e = np.exp(logits / model.temperature - max(logits / model.temperature))
    return model.languages[int(e.argmax())], float(e.max() / e.sum())


def test_language_scores_by_slow_arithmetic():
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 40)) for _ in range(15)] + ["Žluť ÀÉ", "x", "the", "a1b2", "日本語 text", "line\nline\t!"]
    said, score = MODEL.predict(texts)
    for t, s, p in zip(texts, said, score, strict=True):
        language, want = slow_score(MODEL, t)
        assert abs(p - want) < 1e-4 and (s == language or abs(want - 0.5) < 1e-4), t
    alone = [MODEL.predict([t])[1][0] for t in texts]
    assert np.allclose(alone, score, atol=1e-5)  # neighbours in a batch don't matter


def test_languages_of_long_texts_only(spark):
    rng = random.Random(5)
    long = [(i, words(rng, 6000) if i % 2 else words(rng, 6000).replace("a", "ž"), "ab"[i % 2]) for i in range(16)]
    model = language_id.fit(spark.createDataFrame(long, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b"] and model.predict([words(rng, 50)])[0] == ["b"]
    short = [(100 + i, words(rng, 40), "b") for i in range(30)]
    model = language_id.fit(spark.createDataFrame(long + short, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b"]
