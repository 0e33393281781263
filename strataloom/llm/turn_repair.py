"""Operator 11, conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Rows are range-sorted by conversation and turn, so a long conversation is dealt over several tasks. A task parses its parts of
conversations, each from every state that may precede it; a part comes down to a small chart of least edits by states
before and after. Charts of a conversation are joined in order, which fixes the edits of every part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import SPACE, Scratch, map_arrow, quoted, spread_join, table
from strataloom.llm.earley import FINAL, STATES, parse

#: Rows of a conversation that are parsed as one part.
PART = 4096

_CHART = "array<struct<before:string,after:string,cost:long,audit:string,roles:string>>"
_SUMS = ("min_turn", "max_turn", "turns", "blank", "duplicate", "truncated", "illegal")
_PART = f"conv string, part long, n int, role string, text string, {', '.join(f'{c} long' for c in _SUMS)}, first string, last string, chart {_CHART}"
_LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of the contract; nulls of role and text are one space.

    By crc32 of `conv_id:turn` (a null there is a space, too) modulo 20: 0 drops the row, 1 empties its text, 2 takes out
    its `[.!?]`, 3 repeats it, 4 sets the role user. Repeated rows are damaged alike.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    return conversations.filter(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("again")).drop("again")


def _faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends without a mark."""
    end = F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return ~F.rlike(text, F.lit(f"[^{SPACE}]")), ~end.isin(".", "!", "?")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, turn, role, text, blank, truncated, known, first_turn) to their parts: the rows, and a row with sums and chart."""
    from pyspark import TaskContext

    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("n", pa.int32()), ("role", pa.string()), ("text", pa.string()), *((c, pa.int64()) for c in _SUMS), ("first", pa.string()), ("last", pa.string()), ("chart", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])))])
    number, conv, begun, rows, before = TaskContext.get().partitionId() << 32, None, False, [], None

    def close() -> pa.RecordBatch:
        """begun: the conversation's first row is known to be the part's."""
        nonlocal number
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
        sums = [min(turns, default=None), max(turns, default=None), len(set(turns)), *(sum(r[3] == k for r in rows) for k in ("blank", "duplicate", "truncated")), illegal]
        faults = [(r[1][:1], r[3] in ("blank", "duplicate"), r[3] == "truncated") for r in rows]
        chart = [{"before": s, "after": t, "cost": c, "audit": a, "roles": o} for s in (STATES[:1] if begun else STATES) for t, (c, a, o) in parse(faults, s).items()]
        own = [{"conv": conv, "part": number, "n": n, "role": r[1], "text": r[2]} for n, r in enumerate(rows)]
        own.append({"conv": conv, "part": number, **dict(zip(_SUMS, sums, strict=True)), "first": initials[0], "last": initials[-1], "chart": chart})
        number += 1
        return pa.RecordBatch.from_pylist(own, schema)

    for b in batches:
        for r in b.to_pylist():
            if rows and (r["conv"] != conv or len(rows) == PART):
                yield close()
                rows = []
            if r["conv"] != conv:
                begun = conv is not None  # what the task before has of this conversation isn't known here
                before = None
            elif not rows:
                begun = False
            conv, here = r["conv"], (r["turn"], r["role"], r["text"])
            again = r["known"] and (here == before or r["turn"] != r["first_turn"])
            fault = "blank" if r["blank"] else "duplicate" if again else "truncated" if r["truncated"] else ""
            rows.append((*here, fault))
            before = here
    if rows:
        yield close()


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, parts to conv, gaps, blank, duplicate, truncated, illegal, cost, audit, chosen (part, audit and roles of each)."""
    kind = pa.list_(pa.struct([("part", pa.int64()), ("audit", pa.string()), ("roles", pa.string())]))
    for b in batches:
        out = []
        for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts.sort(key=lambda p: p["part"])
            low, high = ([p[c] for p in parts if p[c] is not None] for c in ("min_turn", "max_turn"))
            turns = sum(p["turns"] for p in parts)
            sums = {c: sum(p[c] for p in parts) for c in _SUMS[3:]}
            for p, q in zip(parts, parts[1:], strict=False):
                turns -= p["max_turn"] is not None and p["max_turn"] == q["min_turn"]
                sums["illegal"] += p["last"] + q["first"] not in _LEGAL
            best = {STATES[0]: (0, "", "", None)}
            for p in parts:
                new: dict[str, tuple] = {}
                for c in p["chart"]:
                    if c["before"] in best:
                        cost, audit, roles, _ = before = best[c["before"]]
                        found = (cost + c["cost"], audit + c["audit"], roles + c["roles"])
                        if c["after"] not in new or found < new[c["after"]][:3]:
                            new[c["after"]] = (*found, (before[3], {"part": p["part"], "audit": c["audit"], "roles": c["roles"]}))
                best = new
            cost, audit, _, chosen = min((best[s] for s in FINAL if s in best), key=lambda v: v[:2])
            path = []
            while chosen is not None:
                chosen, own = chosen
                path.append(own)
            gaps = max(high) - min(low) + 1 - turns if low else 0
            out.append((conv, gaps, *(sums[c] for c in _SUMS[3:]), cost, audit, path))
        cols = list(zip(*out, strict=True)) if out else [()] * 9
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), kind]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv", "gaps", *_SUMS[3:], "cost", "audit", "chosen"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, part, audit, roles to a row for each row that comes out: conv, part, place, n (the row it was, null for a new one), edit, role."""
    for b in batches:
        out = []
        for conv, part, audit, roles in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            n, place = 0, 0
            for letter in audit:
                if letter != "D":
                    out.append((conv, part, place, None if letter == "I" else n, letter, roles[place]))
                    place += 1
                n += letter != "I"
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv", "part", "place", "n", "edit", "initial"])


def turn_repair(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of rows (conv_id, turn, role, text, of which role and text aren't null).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation. repaired: conv_id,
    part, place, edit, role, text: what comes out, in the order of part and place. Edits keep a row (0), set its role to user or
    assistant (2), delete it (3, a must for blank rows and for copies of earlier ones) or insert an empty turn (2); a row
    that ends without a mark and stays costs 1 more. What comes out is a system turn or none, then pairs of user and
    assistant, by the roles' first letters. Of the cheapest edits those whose letters come first are taken.

    Rows are taken by turn (nulls first), then role and text; repeated rows are duplicates of the first one; a null
    conv_id is a conversation. No task holds more than a part of a conversation's rows; its edits meet in one row, as
    the audit does.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank, truncated = _faults(F.col("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    own = scratch.write(rows.select(key.alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", blank.alias("blank"), truncated.alias("truncated"), F.xxhash64("role", "text").alias("a"), F.xxhash64("text", "role").alias("b")), "rows")
    copies = own.groupBy("conv", "a", "b").agg(F.count("*").alias("members"), F.bool_or(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least")).filter("members > 1")
    copies = scratch.write(copies.select("conv", "a", "b", "members", F.when(~F.col("none"), F.col("least")).alias("first_turn")), "copies")
    known = spread_join(own, copies, ["conv", "a", "b"], "members", "turn", "left").select("conv", "turn", "role", "text", "blank", "truncated", F.col("members").isNotNull().alias("known"), "first_turn")
    known = scratch.write(known, "known")
    parts = scratch.write(map_arrow(known.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text"), _parts, _PART), "parts")
    sums = parts.filter("chart IS NOT NULL").groupBy("conv").agg(F.collect_list(F.struct("part", *_SUMS, "first", "last", "chart")).alias("parts"))
    counts = ", ".join(f"{c} long" for c in ("gaps", *_SUMS[3:], "cost"))
    joined = scratch.write(map_arrow(sums, _join_parts, f"conv string, {counts}, audit string, chosen array<struct<part:long,audit:string,roles:string>>"), "joined")
    back = lambda df: df.withColumn("conv_id", F.when(F.col("conv") != "", F.substring("conv", 2, 0x7FFFFFFF)).cast(kind))
    report = back(joined).select("conv_id", "gaps", *_SUMS[3:], "cost", "audit")
    edits = map_arrow(joined.select("conv", F.inline("chosen")), _edits, "conv string, part long, place int, n int, edit string, initial string")
    texts = parts.filter("chart IS NULL").select("part", "n", F.col("role").alias("was"), "text")
    out = back(edits.join(texts, ["part", "n"], "left"))
    role = F.when(F.col("edit") == "K", F.col("was")).otherwise(F.when(F.col("initial") == "u", "user").otherwise("assistant"))
    return report, out.select("conv_id", "part", "place", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashes(kind: pa.DataType):
    """Rows (conv_id, line), a conversation's in order, to conv_id and the SHA-256 of its lines; only the hash's state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []
        for b in batches:
            for c, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            if len(out) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], ["conv_id", "repaired_sha256"])
                out = []
        if state is not None:
            out.append((conv, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])

    return run


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The columns of the contract for each conv_id; one without a row after the damage has zeros and empty strings.

    A conversation's lines are hashed in one stream, as a SHA-256 has to be; the task holds none of them.
    """
    scratch = Scratch(conversations.sparkSession, "turns")
    own = conversations.select(quoted("conv_id").alias("conv_id"), quoted("turn").alias("turn"), quoted("role").alias("role"), quoted("text").alias("text"))
    report, repaired = turn_repair(damaged(own), scratch)
    kind = own.schema["conv_id"].dataType
    lines = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    hashes = map_arrow(lines, _hashes(arrow), f"conv_id {kind.simpleString()}, repaired_sha256 string")
    every = own.select("conv_id").distinct().alias("e")
    out = every.join(report.alias("r"), F.expr("e.conv_id <=> r.conv_id"), "left").join(hashes.alias("h"), F.expr("e.conv_id <=> h.conv_id"), "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_SUMS[3:], "cost")]
    return out.select("e.conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations", deal=True))
