"""Operator 10, exact dedup: MSD radix partitioning by successive bytes; equality is decided without a digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import delete, quoted, table, without_space, written

#: Bytes of the first digit; each further one is WIDER times as wide, so a text of n bytes takes log n levels.
FIRST, WIDER = 64, 8


def _with_groups(rows: DataFrame, key: list[str], own: str, name: str, level: int) -> tuple[DataFrame, str]:
    """rows (left) joined with the groups of key that have two rows or more; others get a null group.

    Counting combines on the map side; the join is a plain equi-join, so a hot group is split at run time.
    """
    groups = rows.groupBy(*key).agg(F.count("*").alias(f"{own}n")).filter(F.col(f"{own}n") > 1).drop(f"{own}n")
    # written before use: a number from monotonically_increasing_id must not change when a task is run again
    groups, path = written(groups.withColumn(f"{own}group", F.monotonically_increasing_id()), name)
    # a sort-merge join at every size: the plan, and with it the disk, grows with the rows alone
    return rows.hint("merge").join(groups.hint("merge"), key, "left").withColumn(f"{own}level", F.lit(level)), path


def _bytes(text: Column, start: int, n: int | None = None) -> Column:
    return F.substring(text, F.lit(start), F.lit(n if n is not None else 0x7FFFFFFF))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, out: str = "exact") -> DataFrame:
    """The columns carry of docs (by default all) with the struct column `out`: keep_id, group_size, kept.

    Texts are equal when they are identical after deleting all white space; null counts as empty, so null, empty and
    blank texts form one group. Of a group the row with the most code points in the original text stays, then the
    one with the smallest id (null ids last); of rows that repeat in both, exactly one stays. An input column
    of that name, in any case, is replaced; all other columns pass through, whatever their names. An empty table
    gives an empty result.

    Level 1 partitions by byte length and the first bytes. Rows that are alone leave at once; groups whose text has
    ended are done; only the rest goes on to the next, wider digit within its group. No row's text is gathered:
    groups are counted with map-side partial aggregates and rejoined by key.
    """
    own = "__x_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() != out.lower()]
    carry, text_there = [quoted(c) for c in names], text_col.lower() in map(str.lower, names)
    digit, length, group, level, uid, rest, own_id, chars, parent = (f"{own}{x}" for x in ("digit", "length", "group", "level", "uid", "rest", "id", "chars", "parent"))
    norm = F.encode(without_space(F.col(text_col)), "UTF-8")

    base = docs.select(*carry, F.col(id_col).alias(own_id), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias(chars), norm.alias(rest))
    base = base.withColumns({length: F.length(rest), digit: _bytes(F.col(rest), 1, FIRST)})
    if text_there:  # the text travels once; its tail is cut again behind the join
        base = base.drop(rest)
    first, groups = _with_groups(base, [length, digit], own, "exact-groups", 1)
    tail = F.when(F.col(group).isNotNull() & (F.col(length) > FIRST), _bytes(norm if text_there else F.col(rest), FIRST + 1))
    # the rows, each with a number of its own from here on; only rows that share a first digit keep their bytes
    rows, _ = written(first.drop(digit).withColumns({rest: tail, uid: F.monotonically_increasing_id()}), "exact-rows")
    delete(docs.sparkSession, groups)

    shared = rows.filter(F.col(group).isNotNull())
    done = [shared.filter(F.col(length) <= FIRST).select(uid, level, group)]
    active = shared.filter(F.col(length) > FIRST).select(uid, length, group, rest)
    longest = shared.agg(F.max(length)).first()[0] or 0
    at, width, n = FIRST, FIRST * WIDER, 1
    while at < longest:
        n += 1
        split = active.withColumnRenamed(group, parent).withColumn(digit, _bytes(F.col(rest), 1, width))
        joined, groups = _with_groups(split, [parent, digit], own, "exact-groups", n)
        still, _ = written(joined.filter(F.col(group).isNotNull()).select(uid, length, level, group, _bytes(F.col(rest), width + 1).alias(rest)), "exact-level")
        delete(docs.sparkSession, groups)
        at, width = at + width, width * WIDER
        done.append(still.filter(F.col(length) <= at).select(uid, level, group))
        active = still.filter(F.col(length) > at).select(uid, length, group, rest)
    ends = reduce(DataFrame.unionByName, done)

    # of each group: its size and the row that stays; rows that parted on a later level have no group
    members = shared.drop(level, group, rest, length).join(ends, uid, "left")
    order = F.struct((-F.col(chars)).alias("a"), F.col(own_id).isNull().alias("b"), F.col(own_id).alias("c"), F.col(uid).alias("d"))
    best = members.filter(F.col(group).isNotNull()).groupBy(level, group).agg(F.min(order).alias(f"{own}best"), F.count("*").alias(f"{own}n"))
    alone = F.struct(F.col(own_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    chosen = F.struct(F.col(f"{own}best.c").alias("keep_id"), F.col(f"{own}n").alias("group_size"), (F.col(f"{own}best.d") == F.col(uid)).alias("kept"))
    best, _ = written(best, "exact-best")  # read back, it is a plain side of the join, whose other side may be split
    decided = members.hint("merge").join(best.hint("merge"), [level, group], "left").select(*carry, F.when(F.col(f"{own}n").isNull(), alone).otherwise(chosen).alias(out))
    return rows.filter(F.col(group).isNull()).select(*carry, alone.alias(out)).unionByName(decided)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(without_space(F.col("text")), 256))
    return exact_dedup(docs, carry=["doc_id", "text_sha256"]).select("doc_id", "exact.keep_id", "exact.group_size", "exact.kept", "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS x FROM documents),
o AS (SELECT *, first_value(doc_id) OVER (PARTITION BY x ORDER BY length(coalesce(text, '')) DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  row_number() OVER (PARTITION BY x ORDER BY length(coalesce(text, '')) DESC, doc_id NULLS LAST) = 1 AS kept FROM t)
SELECT doc_id, keep_id, group_size, kept, sha256(x) AS text_sha256 FROM o"""
