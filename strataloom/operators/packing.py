"""Filling a fixed budget from an ordered list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.rules import PACK_ALWAYS, PACK_OVERHEAD
from strataloom.operators.scan import WHOLE, Segments, by_size
from strataloom.plans.session import ship


def greedy(sizes: Column, budget: int, overhead: int = PACK_OVERHEAD, always: int = PACK_ALWAYS) -> Column:
    """array<boolean> of what is taken: an entry that doesn't fit is skipped, once `always` entries are taken.

    Skipped entries use no budget, so this is a fold; a running sum would count them.
    """
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("taken"))

    def step(s: Column, size: Column) -> Column:
        cost = size.cast("long") + overhead
        take = ~((s["used"] + cost > budget) & (s["n"] >= always))
        return F.struct((s["used"] + F.when(take, cost).otherwise(F.lit(0).cast("long"))).alias("used"), (s["n"] + take.cast("int")).alias("n"), F.concat(s["taken"], F.array(take)).alias("taken"))

    return F.aggregate(sizes, begin, step, lambda s: s["taken"])


def pack_context(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int, overhead: int = PACK_OVERHEAD, always: int = PACK_ALWAYS) -> DataFrame:
    """Rows of each key that fit its budget, taken greedily in order, as in `greedy`.

    The fold reads each key to its end, since a skipped row uses no budget: what is used goes on from batch to batch.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, n = None, 0, 0
        for b in batches:
            taken = []
            for i, (key, s) in enumerate(zip(zip(*[b.column(k).to_pylist() for k in keys], strict=True), b.column(size).to_pylist(), strict=True)):
                if key != last:
                    last, used, n = key, 0, 0
                if s is None or used is None:  # as in SQL, a sum with null stays null
                    fits, cost, used = n < always, 0, None
                else:
                    cost = s + overhead
                    fits = n < always or used + cost <= budget
                if fits:
                    taken.append(i)
                if fits or used is None:
                    used, n = None if used is None else used + cost, n + 1
            yield b.take(pa.array(taken, pa.int64()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, rows.schema)


def pack_prefix(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int, whole: int = WHOLE) -> DataFrame:
    """Rows of each key, with `used`, up to the first that overflows the budget. A key of more than `whole` rows is scanned in parts."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn("used", F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))

    packed = by_size(rows, keys, whole, plain, lambda rows, scratch: Segments(rows, keys, order, scratch).total(size, "used").out())
    return packed.filter(F.col("used") <= budget)


def diff_size(length: Column, n_files: Column, budget: int, marker: int = 22) -> Column:
    """Characters a patch takes: at most its share of the budget, cut patches with a marker line."""
    cap = F.greatest(F.lit(1200), F.floor(budget / F.greatest(F.lit(1), F.least(F.lit(4), n_files)) + 0.5))
    return F.when(length > cap, cap + marker).otherwise(length)
