"""Which files of a repository tree are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.functions.rules import MAX_FILE_SIZE, MAX_FILES


def classify_tree(entries: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """entries (path, size, ..) with include, reason (null when included) and language (null when not)."""
    path = F.col("path")
    rows = entries.withColumn("reason", paths.exclusion(path, F.col("size"), max_file_size))
    return rows.withColumns({"include": F.col("reason").isNull(), "language": F.when(F.col("reason").isNull(), paths.detect_language(path))})


def select_files(entries: DataFrame, keys: list[str] | None = None, max_files: int = MAX_FILES, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Every entry with score, selected and reason: the best max_files of each repository by score, then path.

    Paths order by code point. Eligible entries beyond the cap have the reason `over-max-files`.
    """
    rows = classify_tree(entries, max_file_size).withColumn("score", F.when(F.col("include"), paths.priority(F.col("path"), F.col("size"))))
    best = [F.desc("score"), F.col("path")]
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys, "include").orderBy(*best))
        rows = rows.withColumn("selected", F.col("include") & (place <= max_files))
    else:  # one repository: each task keeps its best max_files rows, so no task sorts them all
        top = rows.filter("include").orderBy(*best).limit(max_files).select("path", F.lit(True).alias("__top")).distinct()
        rows = rows.join(top, "path", "left").withColumn("selected", F.col("include") & F.coalesce("__top", F.lit(False))).select(*rows.columns, "selected")
    return rows.withColumn("reason", F.when(F.col("include") & ~F.col("selected"), "over-max-files").otherwise(F.col("reason")))


def selection_summary(selected: DataFrame, keys: list[str], tree_truncated: bool = False) -> DataFrame:
    over = F.count_if(F.col("reason") == "over-max-files")
    return selected.groupBy(*keys).agg(F.count("*").alias("discovered"), F.count_if("include").alias("source_count"), F.count_if("selected").alias("n_selected"), ((over > 0) | F.lit(tree_truncated)).alias("truncated"))
