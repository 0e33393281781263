"""Line edits, differences and the checks of proposed changes."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.paths import safe_path, unsafe_path
from strataloom.plans.session import ship

# Most lines of a file that may be rewritten whole, least share of the length that must remain, lines of context.
REWRITE_LINES, SHRINK, CONTEXT = 2500, 0.35, 3


class PatchError(ValueError):
    """Why a change doesn't apply."""


def apply_edits(original: str, edits: list[tuple[int, int, str]]) -> str:
    """original with each (first, last, replacement), lines from 1 and inclusive; an empty replacement deletes."""
    lines = original.split("\n")
    todo = sorted(edits, key=lambda e: e[0])
    for (_, last, _), (first, _, _) in zip([(0, 0, ""), *todo], todo, strict=False):
        if first <= last:
            raise PatchError("overlap")
    for first, last, _ in todo:
        if first > last:
            raise PatchError("inverted")
        if last > len(lines):
            raise PatchError("out-of-range")
    for first, last, new in reversed(todo):
        lines[first - 1 : last] = new.replace("\r\n", "\n").split("\n") if new else []
    return "\n".join(lines)


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of lines; what agrees at both ends is counted first."""
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - head) if a[-1 - i] != b[-1 - i]), most - head)
    return head + tail + _common_core(a[head : len(a) - tail], b[head : len(b) - tail])


def _common_core(a: list[str], b: list[str]) -> int:
    """By the furthest-reaching paths of the shortest edit script."""
    n, m = len(a), len(b)
    reach = {1: 0}
    for d in range(n + m + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return (n + m - d) // 2
    return 0


def _lines(text: str) -> list[str]:
    """Lines with their ends: the last without one differs from the same with."""
    return text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]] * (not text.endswith("\n"))


def diff_stats(original: str, modified: str) -> tuple[int, int]:
    """(additions, deletions) of the smallest line difference."""
    a, b = _lines(original), _lines(modified)
    same = common_length(a, b)
    return len(b) - same, len(a) - same


def unified_diff(path: str, original: str, modified: str) -> str:
    parts = difflib.unified_diff(_lines(original), _lines(modified), f"a/{path}", f"b/{path}", n=CONTEXT)
    return "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in parts)


def _change(original: str | None, action: str, new_content: str | None, edits) -> tuple:
    """(reason, modified, additions, deletions) of a change whose path is in order; all null for no change."""
    before = original or ""
    try:
        if new_content:
            after = new_content.replace("\r\n", "\n")
            if before and before.count("\n") + 1 > REWRITE_LINES:
                raise PatchError("too-large")
            if before and len(after) < SHRINK * len(before):
                raise PatchError("shrunk")
        elif edits is not None and len(edits):
            after = apply_edits(before, [(e["start_line"], e["end_line"], e["replacement"]) for e in edits])
        else:
            raise PatchError("no-content")
    except PatchError as e:
        return str(e), None, None, None
    if before.endswith("\n") and not after.endswith("\n"):
        after += "\n"
    if after == before:
        return None, None, None, None
    return None, after, *diff_stats(before, after)


def validate_changes(changes: DataFrame) -> DataFrame:
    """Proposed changes with reason (null when in order), modified_content, additions, deletions, diff.

    Input columns: path, action, new_content, edits (array of start_line, end_line, replacement), original (null
    where the file doesn't exist), allowed_paths, existing_paths. A change that changes nothing has neither a reason
    nor content.
    """
    ship(changes.sparkSession)
    path, creates = safe_path(F.col("path")), F.col("action") == "create"
    has = F.col("original").isNotNull()
    blank = F.coalesce(F.trim(F.regexp_replace("new_content", r"\s+", " ")), F.lit("")) == ""
    reason = (
        F.when(unsafe_path(F.col("path")).isNotNull(), F.concat(F.lit("path:"), unsafe_path(F.col("path"))))
        .when(~creates & ~F.array_contains("allowed_paths", path), "not-in-context")
        .when(creates & (has | F.coalesce(F.array_contains("existing_paths", path), F.lit(False))), "exists")
        .when(~creates & ~has, "missing")
        .when(creates & blank, "empty")
    )
    rows = changes.withColumn("reason", reason)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r, None, None, None) if r else _change(o, a, n, e) for r, o, a, n, e in zip(b.reason, b.original, b.action, b.new_content, b.edits, strict=True)]
            b[["reason", "modified_content", "additions", "deletions"]] = pd.DataFrame(out, columns=list("rmad"), dtype=object).to_numpy()
            b["diff"] = [unified_diff(p, o or "", m) if m is not None else None for p, o, m in zip(b.path, b.original, b.modified_content, strict=True)]
            yield b

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kept}, modified_content string, additions int, deletions int, diff string")


def base_moved(expected_sha: Column, current_sha: Column, expected: Column, current: Column) -> Column:
    """Why a change no longer applies to the current file, or null."""
    return F.when((expected_sha != "") & (current_sha != "") & (expected_sha != current_sha), "sha-moved").when(expected != current, "content-moved")


def line_totals(files: Column) -> Column:
    """struct<additions, deletions> over an array of files."""
    add = lambda f: F.aggregate(files, F.lit(0).cast("long"), lambda s, x: s + x[f])
    return F.struct(add("additions").alias("additions"), add("deletions").alias("deletions"))
