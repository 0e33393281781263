"""Operator 2, token counts: byte-pair merges by heap and linked list, without emitting identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.bpe import vocabulary
from strataloom.llm.common import map_arrow, table

#: Words whose counts a worker remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED = 1_000_000
LIMIT = 2048


class _Counts(dict):
    """Token count by word, filled on demand: initial symbols minus merges."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n, merges = self.vocabulary.merges(word)
        if len(word) <= 64:
            self[word] = n - merges
        return n - merges


_counts: dict[str, _Counts] = {}


def count_text(path: str, text: str | None) -> int:
    counts = _counts.get(path)
    if counts is None:
        counts = _counts[path] = _Counts(path)
    return sum((special is not None) + sum(map(counts.__getitem__, words)) for special, words in counts.vocabulary.segments(text or ""))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    path: a tokenizers file (BPE with word ends). One pass without a shuffle; a worker remembers word counts in a
    bounded dictionary, so memory doesn't grow with the input. Null and empty texts count 0 bytes and 0 tokens; a
    null id stays null; repeated rows come out as often as they went in; other columns are ignored; special strings
    in a text count one token each, as by the library's default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_text(path, t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", deal=True), public_tokenizers.path("word_bpe_49k.json"))
