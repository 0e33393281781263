"""What the operators of this subpackage share: input tables, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.plans.session import ship

#: White space of the contracts, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    """A table; where deal is set and it has fewer pieces than there are cores, dealt to all of them by rows."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if deal and df.rdd.getNumPartitions() < cores else df


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


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended: whoever owns the shared folder clears it
        pass


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs no earlier stage.

    The files go when the driver ends; loops delete what they have superseded earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_delete_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def free(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df is called so; Spark ignores case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of that name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """128 bits of hash over all columns: rows with equal ones are the same in every column."""
    cols = [quoted(c) for c in df.columns]
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


class Scratch:
    """The intermediate tables of one call: one folder of the shared folder, cleared when the call is through."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/strataloom/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_delete_at_exit, spark, self.path)

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


def maybe_in(rows: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
    """rows whose long column `name` may be among those of hashes (a written table), and few others: a bitmap filter.

    Eight bits for each hash, but _FILTER_BITS at most, so the broadcast is bounded; a fuller filter lets more rows by.
    """
    bits = 1 << max(_MAP_BITS.bit_length() - 1, min((hashes.count() * 8).bit_length(), _FILTER_BITS.bit_length() - 1))
    bit = F.pmod(F.col(name), F.lit(bits))
    number, place = F.shiftright(bit, 15).alias("__map"), F.pmod(bit, F.lit(_MAP_BITS))
    maps = hashes.groupBy(number).agg(F.bitmap_construct_agg(place).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, __place % 8) & 1") == 1
    found = rows.withColumn("__map", F.shiftright(bit, 15)).join(F.broadcast(maps), "__map")
    return found.withColumns({"__byte": byte, "__place": place.cast("int")}).filter(hit).select(rows.columns)


def maybe(rows: DataFrame, hashes: DataFrame, name: str, out: str) -> DataFrame:
    """rows with the boolean `out`: whether their long column `name` may be among those of hashes (a written table).

    A bitmap filter: eight bits for each hash, but _FILTER_BITS at most, so the broadcast is bounded; a fuller filter says
    yes more often.
    """
    bits = 1 << max(_MAP_BITS.bit_length() - 1, min((hashes.count() * 8).bit_length(), _FILTER_BITS.bit_length() - 1))
    bit = F.pmod(F.col(name), F.lit(bits))
    number, place = F.shiftright(bit, 15).alias("__map"), F.pmod(bit, F.lit(_MAP_BITS))
    maps = hashes.groupBy(number).agg(F.bitmap_construct_agg(place).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__byte, __place % 8) & 1") == 1, F.lit(False))
    found = rows.withColumn("__map", F.shiftright(bit, 15)).join(F.broadcast(maps), "__map", "left")
    return found.withColumns({"__byte": byte, "__place": place.cast("int")}).select(*rows.columns, hit.alias(out))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 256) -> DataFrame:
    """df.mapInArrow(run, schema), where run gets batches of a few rows, so that long texts don't add up in a worker."""
    ship(df.sparkSession)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(small, schema)


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def without_space(text: Column) -> Column:
    """Text without any white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def unit_interval(*cols: Column) -> Column:
    """A random number strictly between 0 and 1 that depends on the columns alone (52 bits of MD5)."""
    head = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 52)
