"""Lists, feeds and counters of stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.windows import latest_per_key

# Rows of a feed's part and of the lists.
FEED = 12
LISTS = {"repositories": 60, "changes": 30, "conversations": 20, "jobs": 15, "symbols": 200}


def newest(rows: DataFrame, owner: str, at: str, most: int, *tie: str) -> DataFrame:
    """The `most` newest rows of each owner with their place, ties by the columns `tie`; the cap is the feature."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), *tie))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def feed(parts: dict[str, DataFrame], owner: str, at: str, tie: str, most: int = FEED) -> DataFrame:
    """owner, kind, place, tie and time of the newest rows of each kind of record."""
    out = [newest(df.select(owner, at, tie), owner, at, most, tie).withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def with_name(records: DataFrame, repositories: DataFrame) -> DataFrame:
    """records (repository_id, owner, repo) with full_name: the repository's, or owner and repo where it is unknown."""
    known = repositories.select("repository_id", F.col("full_name").alias("__name"))
    return records.join(known, "repository_id", "left").withColumn("full_name", F.coalesce("__name", F.concat_ws("/", "owner", "repo"))).drop("__name")


def uncited(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations of files that don't exist: an answer without any is valid."""
    return citations.join(files.select("file_path"), "file_path", "left_anti")


def counters(repositories: DataFrame, pulls: DataFrame) -> DataFrame:
    """One row: repositories, those that are indexed (in part), open pull requests."""
    counted = repositories.agg(F.count("*").alias("repositories"), F.count_if(F.col("status").isin("indexed", "partial")).alias("indexed"))
    return counted.join(pulls.agg(F.count_if(F.col("state") == "open").alias("open_pulls")))


def matching(repositories: DataFrame, search: str = "", indexed: bool = False, writable: bool = False, private: bool = False) -> DataFrame:
    """The filters of a repository list; each one that isn't set lets everything by."""
    rows = repositories.filter(F.contains(F.lower("full_name"), F.lit(search.lower()))) if search else repositories
    for wanted, test in ((indexed, F.col("status").isin("indexed", "partial")), (writable, F.col("can_write")), (private, F.col("private"))):
        rows = rows.filter(test) if wanted else rows
    return rows


def conversations(turns: DataFrame, owner: str, key: str, at: str, most: int = LISTS["conversations"]) -> DataFrame:
    """owner, key, messages, last, place: the conversations of each owner with their number of messages, the newest first."""
    each = turns.groupBy(owner, key).agg(F.count("*").alias("messages"), F.max(at).alias("last"))
    return newest(each, owner, "last", most, key)


def history(turns: DataFrame, key: str, order: str, most: int = 4, chars: int = 700, assistant: str = "Assistant") -> DataFrame:
    """key, block: the last turns of each conversation as lines of who said what, each cut to `chars`.

    A task keeps `most` turns a conversation before they meet.
    """
    who = F.when(F.col("role") == "user", "User").otherwise(F.lit(assistant))
    said = F.concat(who, F.lit(": "), F.coalesce(F.substring("text", 1, chars), F.lit("")))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    few = turns.select(key, order, said.alias("said")).withColumn("__n", last).filter(F.col("__n") <= most)
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), "said"))), lambda x: x["said"])
    return few.groupBy(key).agg(F.concat(F.lit("Earlier turns:\n"), F.array_join(lines, "\n")).alias("block"))


def with_reviews(pulls: DataFrame, reviews: DataFrame) -> DataFrame:
    """pulls (number, head_sha) with the newest of their reviews (number, head_sha, verdict, created_at, id) and whether it is stale.

    stale: the review is of another head; all of it is null without a review. Ties in time go to the greater id.
    """
    last = latest_per_key(reviews.select("number", F.col("head_sha").alias("reviewed_sha"), "verdict", "created_at", "id"), ["number"], "created_at", "id").drop("id")
    return pulls.join(last, "number", "left").withColumn("stale", F.when(F.col("created_at").isNotNull(), ~F.col("reviewed_sha").eqNullSafe(F.col("head_sha"))))
