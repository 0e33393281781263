"""Operators whose behaviour is a window: latest rows, coalesced ranges, sliding sums, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators import scan
from strataloom.operators.scan import WHOLE, Segments, by_size


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key by `order`, of which the last entry breaks ties.

    A max over a struct with map-side combine: a hot key costs one row a task, where a window would sort it whole.
    """
    cols = [c for c in rows.columns if c not in keys]
    by = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), by).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in cols])


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by `order`, likewise."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in cols])


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n).drop("__n")


def merge_windows(ranges: DataFrame, keys: list[str], total: Column, padding: int = 15, gap: int = 6, most: int = 4, whole: int = WHOLE) -> DataFrame:
    """Line ranges (start, end) padded, clamped to [1, total] and merged where the next begins within `gap` lines; the first `most`.

    A key of more than `whole` ranges is scanned in parts.
    """
    rows = ranges.withColumns({"start": F.greatest(F.lit(1), F.col("start") - padding), "end": F.least(total, F.col("end") + padding)}).select(*keys, "start", "end")
    opens = lambda before: (before.isNull() | (F.col("start") > before + gap)).cast("int")

    def plain(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("start", "end")
        before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("opens", opens(before)).withColumn("n", F.sum("opens").over(order)).select(*keys, "start", "end", "n")

    def split(rows: DataFrame, scratch: scan.Scratch) -> DataFrame:
        cut = Segments(rows, keys, ["start", "end"], scratch).greatest_before(F.col("end"), "before").total(opens(F.col("before")), "n")
        return cut.out().select(*keys, "start", "end", "n")

    merged = by_size(rows, keys, whole, plain, split)
    return merged.groupBy(*keys, "n").agg(F.min("start").alias("start"), F.max("end").alias("end")).filter(F.col("n") <= most)


def sliding_sum(rows: DataFrame, keys: list[str], ts: str, value: str, seconds: int = 60, name: str = "used", whole: int = WHOLE) -> DataFrame:
    """Sum over the rows of the last `seconds`, the row that is exactly so old excluded; null for a row without a time.

    A key of more than `whole` rows is scanned in parts.
    """

    def plain(rows: DataFrame) -> DataFrame:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        frame = Window.partitionBy(*keys).orderBy("__t").rangeBetween(1 - seconds * 1_000_000, 0)
        return rows.withColumn("__t", micros).withColumn(name, F.when(F.col("__t").isNotNull(), F.sum(value).over(frame))).drop("__t")

    return by_size(rows, keys, whole, plain, lambda rows, scratch: scan.sliding_sum(rows, keys, ts, value, seconds * 1_000_000, name, scratch))


def status_changes(rows: DataFrame, keys: list[str], order: list[str], status: Column, whole: int = WHOLE) -> DataFrame:
    """Rows whose status differs from the one before; the first of each key too. A key of more than `whole` rows is scanned in parts."""

    def plain(rows: DataFrame) -> DataFrame:
        before = F.lag("__s").over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("__s", status).withColumn("__b", before).filter(~F.col("__s").eqNullSafe(F.col("__b"))).drop("__s", "__b")

    def split(rows: DataFrame, scratch: scan.Scratch) -> DataFrame:
        cut = Segments(rows.withColumn("__s", status), keys, order, scratch).before(F.col("__s"), "__b").out()
        return cut.filter(~F.col("__s").eqNullSafe(F.col("__b.value"))).drop("__s", "__b")

    return by_size(rows, keys, whole, plain, split)


def fixed_rate(rows: DataFrame, keys: list[str], ts: str, seconds: int, most: int) -> DataFrame:
    """keys, window_start, n, rejected: requests in each fixed window and those beyond the limit."""
    start = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    return rows.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("n")).withColumn("rejected", F.greatest(F.lit(0), F.col("n") - most))


def stale(heartbeat: Column, now: Column, minutes: int) -> Column:
    return heartbeat < now - F.make_dt_interval(mins=F.lit(minutes))


def end_by_next(rows: DataFrame, keys: list[str], order: list[str], total: Column) -> DataFrame:
    """end_line of symbols: the line before the next begins, the last at `total`; never before its own start."""
    after = F.lead("start_line").over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("end_line", F.coalesce(F.greatest(F.col("start_line"), after - 1), total))
