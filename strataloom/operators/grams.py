"""Substring search by gram postings: which texts contain which needles, without comparing each with each.

A text that contains a needle contains the needle's rarest gram. Postings are rows (gram, id), sorted by gram where they are stored, so
that a search reads the row groups that may hold its grams and no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.shuffles import Scratch, dealt, delete, maybe_in, spread_join

#: Characters of a gram; shorter needles are looked up by grams of their own length.
SIZE = 3
#: Grams of a search that are pushed down to the scan by name; more are joined.
PUSHED = 1000


def grams(text: Column, size: int = SIZE, words: bool = False) -> Column:
    """The distinct grams of `size` characters of a text; none where it is shorter or null. words: only those behind a blank."""
    # a match of no length at each place, which looks ahead: one pass over the text
    every = F.regexp_extract_all(text, F.lit(f"(?s){'(?<= )' if words else ''}(?=(.{{{size}}}))"), F.lit(1))
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def postings(texts: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (SIZE,), words: bool = False) -> DataFrame:
    """gram, hash (of the gram), id: a row for each distinct gram of each text."""
    all_ = F.flatten(F.array(*[grams(F.col(text_col), n, words) for n in sizes]))
    return texts.select(F.col(id_col).alias("id"), F.explode(all_).alias("gram")).select("gram", F.xxhash64("gram").alias("hash"), "id")


def nested_postings(texts: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...]) -> DataFrame:
    """postings, with one pass over a text: its shorter grams are the beginnings of the longer ones and the text's last characters."""
    out = dealt(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    last = None
    for n in sorted(set(sizes), reverse=True):
        if last is None:
            every = grams(F.col("text"), n)
        else:
            end = F.when(F.length("text") < last, F.col("text")).otherwise(F.right("text", F.lit(last - 1)))
            every = F.array_distinct(F.concat(F.transform(f"g{last}", lambda g: F.substring(g, 1, n)), grams(end, n)))  # noqa: B023
        out, last = out.withColumn(f"g{n}", every), n
    held = out.select("id", F.explode(F.flatten(F.array(*[f"g{n}" for n in sorted(set(sizes))]))).alias("gram"))
    return held.select("gram", F.xxhash64("gram").alias("hash"), "id")


class GramIndex:
    """The stored postings of a table of texts, and how many texts hold each gram."""

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self.postings = spark.read.schema(f"gram string, hash long, id {kind}").parquet(f"{path}/postings")
        self.counts = spark.read.schema("gram string, hash long, n long").parquet(f"{path}/counts")

    @staticmethod
    def write(texts: DataFrame, id_col: str, text_col: str, path: str, sizes: tuple[int, ...] = (1, 2, SIZE)) -> GramIndex:
        """Build and store the index; sizes: lengths of grams, of which short needles need their own.

        A frequent gram is dealt over several files, as ids are part of the order.
        """
        spark = texts.sparkSession
        rows = nested_postings(texts, id_col, text_col, sizes)
        # written once, as a range sort reads its rows twice: for the ranges and for the sort
        rows.write.option("compression", "zstd").parquet(f"{path}/unsorted")
        spark.read.schema(rows.schema).parquet(f"{path}/unsorted").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
        delete(spark, f"{path}/unsorted")
        out = spark.read.schema(rows.schema).parquet(f"{path}/postings")
        out.groupBy("gram", "hash").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        return GramIndex(spark, path, texts.schema[id_col].dataType.simpleString())

    def of(self, wanted: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
        """Rows of postings or counts for the wanted grams (gram, hash; a written table), and a few others where there are many."""
        few = [r["gram"] for r in wanted.select("gram").limit(PUSHED + 1).collect()]
        return table.filter(F.col("gram").isin(few)) if len(few) <= PUSHED else maybe_in(table, wanted.select("hash"), "hash")


def candidates(needles: DataFrame, index: GramIndex | DataFrame, scratch: Scratch, size: int = SIZE, words: bool = False) -> DataFrame:
    """needle, id: texts that hold the rarest gram of a needle (needle: distinct texts that aren't null or empty).

    index: a stored one, or the postings of the texts by the sizes of the needles. Hot grams are dealt over tasks.
    """
    of_needle = F.when(F.length("needle") < size, F.array("needle")).otherwise(grams(F.col("needle"), size, words))
    asked = needles.select("needle", F.explode(of_needle).alias("gram")).withColumn("hash", F.xxhash64("gram"))
    wanted = scratch.write(asked.select("gram", "hash").distinct(), "wanted")
    if isinstance(index, GramIndex):
        counts = index.of(wanted, index.counts, scratch)
    else:
        index = scratch.write(maybe_in(index, wanted.select("hash"), "hash"), "postings")
        counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    held = asked.join(counts.select("gram", "n"), "gram", "left")
    # a needle with a gram that no text holds is in none
    rarest = held.groupBy("needle").agg(F.min_by(F.struct("gram", "hash", "n"), F.struct("n", "gram")).alias("g"), F.bool_or(F.col("n").isNull()).alias("none")).filter("NOT none")
    chosen = scratch.write(rarest.select("needle", "g.gram", "g.hash", "g.n").groupBy("gram", "hash").agg(F.max("n").alias("n"), F.collect_list("needle").alias("needles")), "chosen")
    rows = index.of(chosen, index.postings, scratch) if isinstance(index, GramIndex) else index
    return spread_join(rows.select("gram", "id"), chosen, ["gram"], "n", "id").select(F.explode("needles").alias("needle"), "id")


def containing(texts: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_col: str, scratch: Scratch, index: GramIndex | None = None, size: int = SIZE) -> DataFrame:
    """needle, id: each distinct needle with the ids of the texts that contain it; exact.

    Null needles match nothing, the empty one every text that isn't null; ids may repeat. Candidates are verified on
    the whole text. Without a stored index postings are made of the texts, and only those that may be asked for leave
    their task: needles of several words are looked up by grams behind a blank, of which a text has few, the others by all grams.
    """
    texts = dealt(texts.select(id_col, text_col))
    wanted = scratch.write(needles.select(F.col(needle_col).alias("needle")).filter("needle IS NOT NULL").distinct(), "needles")
    asked = wanted.filter("needle <> ''")
    of_kind = wanted.withColumn("words", F.size(grams(F.col("needle"), size, True)) > 0).groupBy("words").agg(F.collect_set(F.least(F.length("needle"), F.lit(size))).alias("lengths"))
    kinds = {r["words"]: r["lengths"] for r in of_kind.collect()}
    blank = 0 in kinds.get(False, [])
    kinds = {w: [n for n in lengths if n] for w, lengths in kinds.items() if any(lengths)}
    if index is not None:
        found = candidates(asked, index, scratch, size)
    else:
        asked = asked.withColumn("words", F.size(grams(F.col("needle"), size, True)) > 0)
        parts = [candidates(asked.filter(F.col("words") == w).drop("words"), postings(texts, id_col, text_col, tuple(sorted(lengths)), w), scratch, size, w) for w, lengths in kinds.items()]
        found = reduce(DataFrame.unionByName, parts) if parts else candidates(asked.drop("words"), postings(texts.limit(0), id_col, text_col), scratch, size)
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = found.distinct().join(own, "id").filter(F.contains("text", "needle")).select("needle", "id").distinct()
    empty = own.filter("text IS NOT NULL").select(F.lit("").alias("needle"), "id").distinct()
    return hits.unionByName(empty) if blank else hits
