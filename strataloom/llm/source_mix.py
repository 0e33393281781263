"""Operator 5, mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm.common import table, unit_interval, word_count, written

#: A source, and with it a document, is used at most so many times.
MOST = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Bins of each level of the search for the place where a source's words run out; parts into which a source is dealt.
BINS, SALTS = 4096, 32
SEED = "mix"

_SOURCE = ["s", "z"]  # the name, and whether it is null: keys without nulls keep the joins plain


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (s, z, source_size, ...) with target: the share of all sizes by weight, at most `most` times the size.

    Resharing the excess by weight until no target is above its limit ends at min(limit, weight * level) with one
    level for all: in the order of limit / weight the first sources are at their limits, and the level is what they
    leave over the weights that are left. One row a source, so the ordered windows see one small row for each.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy("z", "s")) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), "z", "s")))
    every, here_on = Window.partitionBy(), Window.orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    before = F.sum("limit").over(every) - F.sum("limit").over(here_on)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - before) / F.sum("weight").over(here_on))
    fits = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct("place", "level"))
    rows = rows.withColumn("level", F.min(fits).over(every)["level"])
    return rows.withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))).drop("level", "limit", "weight", "place")


def _log_size(size: Column) -> Column:
    """Sixteenths of the binary logarithm: whole numbers, so that sums agree in any order."""
    return F.round(F.log2(size + 1) * 16).cast("long")


def _salted(sources: DataFrame) -> DataFrame:
    return sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _run_out(rows: DataFrame, by: str) -> DataFrame:
    """For each source the first bin in which the running words pass `need`, and the words before that bin.

    Words are summed by bin on the map side; a source's window holds BINS rows at most.
    """
    words = rows.groupBy(*_SOURCE, by).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    after = F.sum("words").over(Window.partitionBy(*_SOURCE).orderBy(by))
    words = words.withColumn("after", after).withColumn("before", F.col("after") - F.col("words"))
    return words.filter((F.col("before") <= F.col("need")) & (F.col("need") < F.col("after"))).select(*_SOURCE, F.col(by).alias(f"{by}_at"), F.col("before").alias(f"{by}_before"))


def source_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs, and `key` where one is given.

    A source used f = target / source_size times takes floor(f) certain copies of each document; the fraction p that
    is left is drawn by Pareto order sampling. Inclusion rises with the logarithm of the size, by at most half of
    min(p, 1 - p), such that the expected words stay p times the source. Documents are ranked by random odds over
    inclusion odds and taken in that order while the middle of their words fits what is left, so a source ends
    within half a document of its target. Random numbers come from the id and the seed: reruns agree.

    A hot source isn't sorted: two levels of sums over bins of the rank find the place where the words run out; only
    the rows of that last bin are ordered. Null and empty texts have size 0 and take 0 words. A null source is one
    source, the last by name; sources of size 0 have target 0. Rows that repeat are separate documents; null ids
    rank alike. Other columns are ignored; an empty table gives an empty result.
    """
    name, carry = F.col(source_col).cast("string"), [] if key is None else ["key"]
    rows = docs.select(*([] if key is None else [key.alias("key")]), F.col(id_col).alias("doc_id"), F.coalesce(name, F.lit("")).alias("s"), name.isNull().alias("z"), word_count(F.col(text_col)).alias("size"))
    rows, _ = written(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "mix-sizes")

    sums = rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _log_size(F.col("size"))).alias("logs"), F.min(_log_size(F.col("size"))).alias("low"), F.max(_log_size(F.col("size"))).alias("high"))
    sources = source_targets(sums, weights, most)
    factor = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    sources = sources.withColumns({"whole": F.floor(factor + 1e-12), "mean": F.coalesce(F.try_divide(F.col("logs").cast("double"), F.col("source_size").cast("double")), F.lit(0.0))})
    sources = sources.withColumns({"p": F.greatest(factor - F.col("whole"), F.lit(0.0)), "spread": F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"), F.lit(1e-9))})
    sources = sources.withColumn("need", F.col("p") * F.col("source_size"))
    sources, _ = written(sources.select(*_SOURCE, "source_size", "target", "whole", "p", "need", "mean", "spread"), "mix-sources")

    by = [*_SOURCE, "salt"]
    inclusion = F.col("p") + 0.5 * F.least(F.col("p"), 1 - F.col("p")) * (_log_size(F.col("size")) - F.col("mean")) / F.col("spread")
    u = unit_interval(F.lit(seed), F.col("doc_id"))
    ranked = rows.join(_salted(sources), by).withColumn("rank", F.when(F.col("p") > 0, u / (1 - u) / (inclusion / (1 - inclusion))))
    digit = F.col("rank") / (1 + F.col("rank")) * BINS  # the leading digits to base BINS are the bins of the two levels
    ranked = ranked.withColumns({"bin": F.floor(digit), "sub": F.floor((digit - F.floor(digit)) * BINS)})
    ranked, _ = written(ranked.select("doc_id", *carry, *by, "size", "source_size", "target", "whole", "need", "rank", "bin", "sub"), "mix-ranked")

    drawn = ranked.filter(F.col("rank").isNotNull())
    bins, _ = written(_run_out(drawn, "bin"), "mix-bins")
    inside = drawn.join(_salted(bins), by).filter(F.col("bin") == F.col("bin_at")).withColumn("need", F.col("need") - F.col("bin_before"))
    ends, _ = written(bins.join(_run_out(inside, "sub"), _SOURCE), "mix-ends")

    placed = ranked.join(_salted(ends), by, "left")
    # sources without a last bin (nothing is left to draw) have null there, and documents without a rank too
    bin_, sub, bin_at, sub_at = (F.col(c) for c in ("bin", "sub", "bin_at", "sub_at"))
    last = F.coalesce((bin_ == bin_at) & (sub == sub_at), F.lit(False))
    ahead = bin_at.isNull() | (bin_ < bin_at) | ((bin_ == bin_at) & (sub < sub_at))
    clear = placed.filter(~last).withColumn("extra", F.coalesce(F.col("rank").isNotNull() & ahead, F.lit(False)).cast("long"))
    running = F.sum("size").over(Window.partitionBy(*_SOURCE).orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("bin_before") + F.col("sub_before") + running - F.col("size") / 2
    mixed = clear.unionByName(placed.filter(last).withColumn("extra", (middle <= F.col("need")).cast("long")))
    mixed = mixed.withColumn("copies", F.col("whole") + F.col("extra"))
    return mixed.select("doc_id", *carry, F.when(~F.col("z"), F.col("s")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS z, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint AS size FROM documents),
l AS (SELECT *, round(log2(size + 1) * 16)::bigint AS lg FROM d),
s1 AS (SELECT s, z, sum(size)::bigint AS source_size, sum(size * lg)::bigint AS logs, min(lg) AS low, max(lg) AS high FROM l GROUP BY s, z),
s2 AS (SELECT *, {MOST} * source_size AS lim, (row_number() OVER (ORDER BY z, s) - 1) % 3 + 1 AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY lim::double / weight, z, s) AS place FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER () - (sum(lim) OVER () - sum(lim) OVER w))::double / (sum(weight) OVER w)::double AS level FROM s3 WINDOW w AS (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s5 AS (SELECT level FROM s4 WHERE lim >= level * weight ORDER BY place LIMIT 1),
s6 AS (SELECT s4.* EXCLUDE (level), least(lim::double, s5.level * weight) AS target FROM s4, s5),
s7 AS (SELECT *, coalesce(target / nullif(source_size::double, 0), 0.0::double) AS f, coalesce(logs::double / nullif(source_size::double, 0), 0.0::double) AS mean FROM s6),
s8 AS (SELECT *, floor(f + 1e-12::double)::bigint AS whole FROM s7),
s9 AS (SELECT *, greatest(f - whole, 0.0::double) AS p, greatest(high - mean, mean - low, 1e-9::double) AS spread FROM s8),
u AS (SELECT l.doc_id, l.s, l.z, l.size, l.lg, s9.source_size, s9.target, s9.whole, s9.p, s9.mean, s9.spread, (('0x' || substr(md5('{SEED}:' || l.doc_id), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double AS u FROM l JOIN s9 ON l.s = s9.s AND l.z = s9.z),
i AS (SELECT *, p + 0.5::double * least(p, 1 - p) * (lg - mean) / spread AS inc FROM u),
q AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (inc / (1 - inc)) END AS rank FROM i),
r AS (SELECT *, sum(size) OVER (PARTITION BY s, z ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((whole + CASE WHEN rank IS NOT NULL AND run - size / 2.0::double <= p * source_size THEN 1 ELSE 0 END) * size)::bigint AS taken FROM r"""
