"""Writing by key without a table format: old and new rows give the new table, which replaces the partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.windows import latest_per_key

# Kept issues and their length, and stored code.
ISSUES, ISSUE_CHARS, CODE_CHARS = 50, 300, 6000


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """old with new rows in place of those with their keys; of new rows with one key the last by `order`."""
    last = latest_per_key(new, keys, *order) if order else new.dropDuplicates(keys)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def upsert_defaults(old: DataFrame, new: DataFrame, keys: list[str], only_insert: list[str]) -> DataFrame:
    """As upsert, but an existing row keeps its own values in the columns `only_insert`."""
    kept = old.select(*keys, F.lit(True).alias("__old"), *[F.col(c).alias(f"__{c}") for c in only_insert])
    merged = new.join(kept, keys, "left").select(*[F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in only_insert else F.col(c) for c in new.columns])
    return upsert(old, merged, keys)


def drop_generation(rows: DataFrame, scope: Column, run_col: str, keep: str) -> DataFrame:
    """Rows of the scope from other runs than `keep` go; without a run to keep nothing goes."""
    return rows.filter(~scope | (F.col(run_col) == keep)) if keep else rows


def drop_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def put_in_array(items: Column, item: Column, key: str) -> Column:
    """items with `item` in place of the one with its key, at the end."""
    return F.concat(F.filter(items, lambda x: x[key] != item[key]), F.array(item))


def append_bounded(items: Column, item: Column, most: int = ISSUES) -> Column:
    """items with `item`, the last `most`."""
    every = F.concat(items, F.array(item))
    return F.slice(every, F.greatest(F.lit(1), F.size(every) - most + 1), most)


def replace_partitions(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Write rows in place of the partitions they belong to, and of no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
