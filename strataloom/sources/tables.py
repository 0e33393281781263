"""Readers of trees, files, landed API pages and stored tables."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a page, pages, and commits of a log.
PAGE, PAGES, LOG = 100, 3, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(rows: DataFrame, name: str, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """Store rows as the catalogue's table `name` under path, in sorted buckets by keys.

    Tables of as many buckets join by these keys, and group by them, without an exchange. A bucket is as many files as
    there were tasks, so rows are dealt by the keys first: one file a bucket, a hot key in one.
    """
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def checkout(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, content of every file below a folder, binary content as null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.substring_index(base, root.rstrip("/") + "/", -1).alias("path"), F.col("length").alias("size"), text.alias("content"))


def tree(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, folders) of raw tree entries (path, sha, mode, size, type)."""
    return entries.filter("type = 'blob'").drop("type"), entries.filter("type = 'tree'").select("path")


def decoded(content: Column, binary: Column) -> Column:
    """Text of base64 content, line breaks inside it allowed; empty for a binary file."""
    return F.when(binary, "").otherwise(F.decode(F.unbase64(F.regexp_replace(content, r"\s+", "")), "UTF-8"))


def blobs(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """entries with content and lines, by sha."""
    text = contents.select("sha", decoded(F.col("content"), F.lit(False)).alias("content"))
    return entries.join(text, "sha", "left").withColumn("lines", F.size(F.split("content", "\n")))


def compare_trees(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status (added, removed, modified) of what differs between two snapshots (path, sha)."""
    both = base.select("path", F.col("sha").alias("a")).join(head.select("path", F.col("sha").alias("b")), "path", "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", status.alias("status")).filter("status IS NOT NULL")


def commit_log(commits: DataFrame, path: str | None = None, most: int = LOG) -> DataFrame:
    rows = commits if path is None else commits.filter(F.array_contains("paths", path))
    return rows.orderBy(F.desc("committed_at"), "sha").limit(most)


def landed_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Items of landed pages (keys, page, items): to the first short page, of PAGES at most."""
    short = pages.filter(F.size("items") < PAGE).groupBy(*keys).agg(F.min("page").alias("last"))
    kept = pages.join(short, keys, "left").filter((F.col("page") <= F.coalesce("last", F.lit(PAGES))) & (F.col("page") <= PAGES))
    return kept.select(*keys, "page", F.posexplode("items").alias("place", "item"))


def identities(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (path) with the sha of the entry at each path; null where there is none."""
    return asked.join(entries.select("path", "sha"), "path", "left")


def compare_commits(base: DataFrame, head: DataFrame) -> DataFrame:
    """One row: status, ahead_by, behind_by of two histories (sha): commits that only head, or only base, has."""
    both = base.select("sha", F.lit(1).alias("b")).distinct().join(head.select("sha", F.lit(1).alias("h")).distinct(), "sha", "full")
    counts = both.agg(F.count_if(F.col("b").isNull()).alias("ahead_by"), F.count_if(F.col("h").isNull()).alias("behind_by"))
    ahead, behind = F.col("ahead_by") > 0, F.col("behind_by") > 0
    return counts.withColumn("status", F.when(ahead & behind, "diverged").when(ahead, "ahead").when(behind, "behind").otherwise("identical"))


def pulls_of_commits(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """sha and number of the pull requests (number, commits) that hold each commit."""
    held = pulls.select("number", F.explode("commits").alias("sha")).distinct()
    return commits.select("sha").distinct().join(held, "sha")


BRANCH = "name string, protected boolean, commit struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>>"


def branches(landed: Column) -> Column:
    """struct<name, sha, message, author, committed_at, protected> of a landed branch; missing texts are empty."""
    b = F.from_json(landed, BRANCH)
    author, none = b["commit"]["commit"]["author"], F.lit("")
    return F.struct(
        b["name"].alias("name"), b["commit"]["sha"].alias("sha"), F.coalesce(b["commit"]["commit"]["message"], none).alias("message"), F.coalesce(author["name"], none).alias("author"), author["date"].cast("timestamp").alias("committed_at"), F.coalesce(b["protected"], F.lit(False)).alias("protected")
    )


def installations(landed: Column) -> Column:
    """struct<id, account, account_type, repository_selection> of a landed installation."""
    i = F.from_json(landed, "id bigint, account struct<login:string,type:string>, repository_selection string")
    return F.struct(i["id"].alias("id"), F.coalesce(i["account"]["login"], F.lit("")).alias("account"), F.coalesce(i["account"]["type"], F.lit("")).alias("account_type"), i["repository_selection"].alias("repository_selection"))


def languages(landed: Column) -> Column:
    """Bytes of each language of a repository; an empty map where nothing landed."""
    return F.coalesce(F.from_json(landed, "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))


class Fallback:
    """Reads that are tried again anonymously where they fail with one of `codes` in the error's `code`.

    Where the anonymous try is refused for its rate, none is made for `pause` seconds. What is raised is always the
    error of the first try.
    """

    def __init__(self, codes: tuple[str, ...] = ("REPO_NOT_FOUND", "NOT_FOUND", "FORBIDDEN", "NO_WRITE_ACCESS"), pause: float = 60, clock=time.monotonic):
        self.codes, self.pause, self.clock, self.blocked_until = codes, pause, clock, float("-inf")

    def read(self, first, anonymous):
        try:
            return first()
        except Exception as error:
            if getattr(error, "code", None) not in self.codes or self.clock() < self.blocked_until:
                raise
            try:
                return anonymous()
            except Exception as refused:
                if getattr(refused, "code", None) == "RATE_LIMIT":
                    self.blocked_until = self.clock() + self.pause
                raise error from refused
