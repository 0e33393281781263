"""Ordered scans of keys that are too large for one task: segmented prefix sums, maxima and predecessors.

Rows are range-sorted by key and order and so cut into parts of like size, whatever the keys. A part is scanned for itself; its
summary (sum, maximum, last row) goes to the parts behind it that begin with the same key: one row a part at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.shuffles import Scratch

#: Rows of a key that one task still sorts; larger keys are scanned in parts.
WHOLE = 1_000_000


def same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def by_size(rows: DataFrame, keys: list[str], whole: int, plain: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame, Scratch], DataFrame]) -> DataFrame:
    """plain() of the rows whose key has at most `whole` rows, and split() of the others: the same result either way."""
    scratch = Scratch(rows.sparkSession, "scan")
    large = scratch.write(rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > whole).drop("__n"), "large")
    if large.isEmpty():
        return plain(rows)
    is_large = same("r", "l", keys)
    small = rows.alias("r").join(large.alias("l"), is_large, "left_anti")
    return plain(small).unionByName(split(rows.alias("r").join(large.alias("l"), is_large, "left_semi"), scratch))


class Segments:
    """rows in parts by keys and order (nulls first); what order leaves open is settled by a hash of the row's number.

    Each method gives new Segments with a column more; `rows` has them all. Parts are written, so their borders stay.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], scratch: Scratch):
        self.keys, self.order = keys, [*order, "__tie"]
        rows = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced
        self._set(scratch.write(rows.repartitionByRange(parts, *keys, *self.order).withColumn("__part", F.spark_partition_id()), "parts"))

    def _set(self, rows: DataFrame) -> Segments:
        self.rows = rows
        return self

    def _with(self, rows: DataFrame) -> Segments:
        return Segments.__new__(Segments)._copy(self, rows)

    def _copy(self, of: Segments, rows: DataFrame) -> Segments:
        self.keys, self.order = of.keys, of.order
        return self._set(rows)

    def _local(self):
        return Window.partitionBy(*self.keys, "__part").orderBy(*self.order)

    def _carried(self, summary: Column, scanned: Callable[[str], Column]) -> DataFrame:
        """rows with __carry: scanned(summary) over the key's earlier parts.

        Only a key that goes on from one part to the next has earlier parts, so there are fewer rows than parts.
        """
        before = Window.partitionBy(*self.keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = self.rows.groupBy(*self.keys, "__part").agg(summary.alias("__own"))
        carry = parts.select(*self.keys, "__part", scanned("__own").over(before).alias("__carry"), F.count("*").over(before).alias("__n")).filter("__n > 0")
        on = same("r", "c", self.keys) & (F.col("r.__part") == F.col("c.__part"))
        return self.rows.alias("r").join(F.broadcast(carry.alias("c")), on, "left").select("r.*", "c.__carry")

    def total(self, value: Column, name: str) -> Segments:
        """The sum of value up to the row; null before the first that isn't null."""
        local = F.sum(value).over(self._local().rowsBetween(Window.unboundedPreceding, 0))
        rows = self._carried(F.sum(value), F.sum).withColumn(name, F.coalesce(local + F.col("__carry"), local, F.col("__carry")))
        return self._with(rows.drop("__carry"))

    def greatest_before(self, value: Column, name: str) -> Segments:
        """The greatest value of the rows before; null for the first."""
        local = F.max(value).over(self._local().rowsBetween(Window.unboundedPreceding, -1))
        rows = self._carried(F.max(value), F.max).withColumn(name, F.greatest(local, "__carry"))
        return self._with(rows.drop("__carry"))

    def before(self, value: Column, name: str) -> Segments:
        """A struct of the value of the row before; null for the first."""
        own = F.struct(value.alias("value"))
        local = F.lag(own).over(self._local())
        rows = self._carried(F.max_by(own, F.struct(*self.order)), F.last).withColumn(name, F.coalesce(local, "__carry"))
        return self._with(rows.drop("__carry"))

    def out(self) -> DataFrame:
        return self.rows.drop("__tie", "__part")


def sliding_sum(rows: DataFrame, keys: list[str], ts: str, value: str, micros: int, name: str, scratch: Scratch) -> DataFrame:
    """Sum over the rows of the last `micros`, the row that is exactly so old excluded: the difference of two prefix sums.

    Sums are exact in decimals of ten places, so that differences of large sums don't drift. A row without a time has none.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = scratch.write(rows.withColumn("__t", at), "rows")
    exact, zero = F.col(value).cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)")
    end = lambda at, v, given: F.struct(at.alias("__at"), v.alias("__v"), given.alias("__given"))
    ends = own.select(*keys, F.inline(F.array(end(F.col("__t"), F.coalesce(exact, zero), exact.isNotNull()), end(F.col("__t") - micros, zero, F.lit(False)))))
    points = ends.groupBy(*keys, "__at").agg(F.sum("__v").alias("__v"), F.count_if("__given").alias("__n"))
    cut = Segments(points, keys, ["__at"], scratch).total(F.col("__v"), "__sum").total(F.col("__n"), "__count").out()
    sums = scratch.write(cut.select(*keys, "__at", F.col("__sum").cast("decimal(38,10)").alias("__sum"), "__count"), "sums")
    here, then = sums.alias("h"), sums.alias("t")
    out = own.alias("r").join(here, same("r", "h", keys) & (F.col("r.__t") == F.col("h.__at")), "left").join(then, same("r", "t", keys) & (F.col("r.__t") - micros == F.col("t.__at")), "left")
    some = F.col("h.__count") > F.col("t.__count")
    return out.select("r.*", F.when(some, F.col("h.__sum") - F.col("t.__sum")).cast("double").alias(name)).drop("__t")
