"""The pipeline's stages against brute force on the small documents."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from strataloom.llm.common import written  # noqa: E402
from tests.llm.test_operators import SPACE, brute_classes, brute_exact, brute_quality, brute_targets  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables, before = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        before, _ = written(stage(spark, before, SF), "test")
        tables.append(before)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mix", "packing"]
    assert all(t.columns == docs.columns for t in tables[:5])
    raw, good, single, apart, mixed = ([(r["doc_id"], r["text"], r["source"]) for r in t.collect()] for t in tables[:5])

    assert set(good) <= set(raw) and not any(brute_quality(t)[-1] for _, t, _ in good) and len(good) > 0.6 * len(raw)
    keep = {k for _, k, _ in brute_exact([(i, t) for i, t, _ in good])}
    assert sorted(i for i, _, _ in single) == sorted(keep)
    classes = brute_classes([(i, t) for i, t, _ in single])
    assert sorted(i for i, _, _ in apart) == sorted({c for _, c, _ in classes})

    size = lambda t: len([w for w in SPACE.split(t or "") if w])
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, t, s in apart:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    for _, t, s in mixed:
        taken[s] += size(t)
    assert set(mixed) <= set(apart) and max(Counter(mixed).values()) <= 3
    assert all(abs(taken[s] - x) <= largest[s] / 2 + 1e-6 for s, x in brute_targets(sizes).items())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in mixed:
        want.update((i, k) for k in range(len(library.encode(t, add_special_tokens=False).ids) + 1))
    got = Counter()
    for p in tables[5].collect():
        got.update((p["doc_id"], k) for k in np.arange(p["start"], p["start"] + p["length"]).tolist())
    assert got == want


def test_run_chains_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None
