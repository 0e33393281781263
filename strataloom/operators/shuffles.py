"""Joins and intermediate tables that hold at any skew: hot keys dealt over tasks, bitmap filters, written lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that would be a folder of the driver
    alone, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended: whoever owns the shared folder clears it
        pass


class Scratch:
    """The intermediate tables of one call: one folder of the shared folder, cleared when the call is through."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/strataloom/{name}-{uuid.uuid4().hex}", 0
        atexit.register(delete_at_exit, spark, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        at = f"{self.path}/{self.count}-{name}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        delete(self.spark, self.path)


#: A key that holds more than one in HOT of all rows is hot; there can't be more than HOT such keys.
HOT = 4096
#: Rows up to which a key is never worth splitting.
COOL = 64


def spread_join(rows: DataFrame, groups: DataFrame, key: list[str], n: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups, which has one row a key and in `n` how many of the rows hold the key.

    The rows of a hot key are dealt over several tasks by a hash of their column `by`, and its group goes to each of
    them. Only the names of hot keys are broadcast: fewer than HOT, as each holds more than one in HOT of the rows.
    groups should be a written table: it is read twice.
    """
    step = max((groups.agg(F.sum(n)).first()[0] or 0) // HOT, COOL)
    hot = F.broadcast(groups.filter(F.col(n) > step).select(*key, F.ceil(F.col(n) / step).cast("int").alias("__parts")))
    salted = rows.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0)))
    copies = F.when(F.col(n) > step, F.ceil(F.col(n) / step).cast("int")).otherwise(1)
    dealt = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.drop("__parts").join(dealt, [*key, "__salt"], how).drop("__salt")


#: Bits of a map of bitmap_construct_agg, and bits of all maps of a filter at most (32 MB, which is broadcast).
_MAP_BITS, _FILTER_BITS = 1 << 15, 1 << 28


def maybe(rows: DataFrame, hashes: DataFrame, name: str, out: str) -> DataFrame:
    """rows with the boolean `out`: whether their long column `name` may be among those of hashes (a written table).

    A bitmap filter: eight bits for each hash, but _FILTER_BITS at most, so the broadcast is bounded; a fuller filter
    says yes more often, and never says no to a hash that is there.
    """
    bits = 1 << max(_MAP_BITS.bit_length() - 1, min((hashes.count() * 8).bit_length(), _FILTER_BITS.bit_length() - 1))
    bit = F.pmod(F.col(name), F.lit(bits))
    number, place = F.shiftright(bit, 15).alias("__map"), F.pmod(bit, F.lit(_MAP_BITS))
    maps = hashes.groupBy(number).agg(F.bitmap_construct_agg(place).alias("__bits"))
    # eight bytes of a map as a number, the first byte highest
    word = lambda i: F.conv(F.hex(F.substring("__bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    maps = maps.select("__map", F.transform(F.sequence(F.lit(0), F.lit(_MAP_BITS // 64 - 1)), word).alias("__words"))
    found = rows.withColumn("__map", F.shiftright(bit, 15)).join(F.broadcast(maps), "__map", "left").withColumn("__place", place.cast("int"))
    hit = F.expr("shiftright(get(__words, shiftright(__place, 6)), (7 - (shiftright(__place, 3) & 7)) * 8 + (__place & 7)) & 1") == 1
    return found.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(out))


def dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores where they are in fewer pieces, as a small table in one file is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def maybe_in(rows: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
    """rows whose long column `name` may be among those of hashes (a written table), and few others."""
    return maybe(rows, hashes, name, "__maybe").filter("__maybe").drop("__maybe")
