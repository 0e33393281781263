"""From raw documents to packed training sequences: five operators, each on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import free, quoted, table, whole_row, written
from strataloom.llm.exact_dedup import exact_dedup
from strataloom.llm.near_dedup import near_dedup
from strataloom.llm.packing import packing
from strataloom.llm.quality_rules import quality_rules
from strataloom.llm.source_mix import source_mix

# What holds for each stage: null and empty texts, null ids, sources and languages, very long texts, ties, repeated rows,
# columns of any name besides those of documents, and empty tables (which stay empty) are allowed.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts too. Repeated rows share their fate."""
    name = free(docs, "quality")
    return _own(quality_rules(docs, out=name).filter(quoted(name)["kept"]), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the longest, then that with the smallest id (null ids last), one of repeated rows.

    Null, empty and blank texts are equal to each other.
    """
    name = free(docs, "exact")
    return _own(exact_dedup(docs, out=name).filter(quoted(name)["kept"]), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (null ids last), one of repeated rows.

    Texts without words are one class.
    """
    kept = near_dedup(docs, row=whole_row(docs)).filter("kept").select("row")
    return _rows(docs, kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; those that it doesn't take go.

    Repeated rows are documents of their own: together they stand as often as all of them are taken. A null source is
    a source; texts without words have size 0 and may stay or go.
    """
    taken = source_mix(docs, key=whole_row(docs)).filter("copies > 0")
    name = free(docs, "copies")
    return _own(_rows(docs, taken.groupBy(F.col("key").alias("row")).agg(F.sum("copies").cast("int").alias(name))).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a text that is null or empty is its end mark alone, repeated rows are packed one by one."""
    return packing(docs, public_tokenizers.path("word_bpe_49k.json"))


def _own(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select([quoted(c) for c in docs.columns])


def _rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs that are chosen (row: whole_row, further columns): once each, though docs may hold them twice.

    Rows that share their `row` are the same in every column, so any of them stands for all.
    """
    keys = [free(docs, "row_a"), free(docs, "row_b")]
    keyed = docs.withColumns({k: whole_row(docs)[x] for k, x in zip(keys, "ab", strict=True)})
    rest = [c for c in chosen.columns if c != "row"]
    chosen = chosen.select(*(F.col("row")[x].alias(k) for k, x in zip(keys, "ab", strict=True)), *rest)
    return keyed.hint("merge").join(chosen.hint("merge"), keys).dropDuplicates(keys).drop(*keys)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mix", mix), ("packing", pack)]

#: Near-duplicate classes and packing along a curve aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = written(docs, f"pipeline-{i}")
    return docs
