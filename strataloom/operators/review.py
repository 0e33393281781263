"""Context and outcome of a pull request's review: files, dependants, tests, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths, text
from strataloom.operators.impact import first_each
from strataloom.operators.packing import greedy
from strataloom.operators.windows import merge_windows

# Files of a review and of its context, dependants read and shown.
REVIEW_FILES, CONTEXT_FILES, DEPENDANTS, SHOWN = 12, 4, 50, 30
SEVERITIES = ("HIGH", "MEDIUM", "LOW")


def review_files(files: DataFrame, key: str, most: int = REVIEW_FILES) -> DataFrame:
    """Reviewable files of each pull request with their place: those with a patch that stay, the most changed first."""
    live = files.filter("patch IS NOT NULL AND patch <> '' AND status <> 'removed'")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("changes"), "path"))
    return live.withColumn("place", place).filter(F.col("place") <= most)


def file_context(chosen: DataFrame, contents: DataFrame, key: str, budget: int, most: int = CONTEXT_FILES) -> DataFrame:
    """key, path, content of the first files that fit into what the ones before have left; tests and binaries are skipped.

    contents: key, path, content (null where binary). A key has `most` rows here, so its fold is short.
    """
    first = chosen.filter((F.col("place") <= most) & ~paths.is_test_path(F.col("path"))).select(key, "path", "place")
    read = first.join(contents.select(key, "path", "content"), [key, "path"]).filter("content IS NOT NULL")
    rows = F.sort_array(F.collect_list(F.struct("place", "path", F.length("content").alias("n"))))
    lists = read.groupBy(key).agg(rows.alias("rows"))
    taken = lists.select(key, "rows", F.posexplode(greedy(F.transform("rows", lambda r: r["n"]), budget, overhead=0, always=0)).alias("at", "take")).filter("take")
    return read.join(taken.select(key, F.get("rows", F.col("at"))["path"].alias("path")), [key, "path"], "left_semi")


def dependants(edges: DataFrame, changed: DataFrame, most: int = DEPENDANTS, shown: int = SHOWN) -> DataFrame:
    """place and line of text for the imports and calls that reach changed files, the first `shown` of `most`."""
    near = edges.filter("type IN ('imports', 'calls')").join(changed.select(F.col("path").alias("to_file")).distinct(), "to_file", "left_semi")
    first = near.orderBy("from_file", "line", "type", "to_name", "to_file").limit(most)
    row = F.row_number().over(Window.orderBy("from_file", "line", "type", "to_name", "to_file"))  # `most` rows
    origin = F.when(F.col("from_symbol") == "", "<module>").otherwise(F.col("from_symbol"))
    said = F.format_string("%s:%d %s %s %s (%s)", F.col("from_file"), F.col("line"), origin, F.col("type"), F.col("to_name"), F.col("to_file"))
    return first.select(row.alias("place"), said.alias("dependant")).filter(F.col("place") <= shown)


def kept_findings(findings: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Findings without a path, with a path of the pull request, or that say they lack context."""
    known = files.select(key, F.col("path").alias("file_path"), F.lit(True).alias("__known")).distinct()
    kept = findings.join(known, [key, "file_path"], "left")
    return kept.filter((F.coalesce("file_path", F.lit("")) == "") | F.col("__known") | (F.col("confidence") == "INSUFFICIENT_CONTEXT")).select(findings.columns)


def by_severity(findings: DataFrame, key: str) -> DataFrame:
    """key, severity, n, items in the order HIGH, MEDIUM, LOW; a review holds 25 findings at most."""
    item = F.struct("place", "title", "file_path", "line", "confidence")
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    grouped = findings.filter(F.col("severity").isin(*SEVERITIES)).groupBy(key, "severity").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.withColumn("rank", rank)


def finding_line(f: Column) -> Column:
    """`title (path:line, confidence)`; the line only where it isn't 0."""
    at = F.concat(f["file_path"], F.when(f["line"] > 0, F.concat(F.lit(":"), f["line"].cast("string"))).otherwise(""))
    return F.concat(f["title"], F.lit(" ("), at, F.lit(", "), f["confidence"], F.lit(")"))


def ranked_targets(targets: DataFrame, retrieved: DataFrame, input_chars: int) -> DataFrame:
    """path and place of the files a change may touch: named ones first, then retrieved ones that aren't tests, each once.

    One file for every 5,000 characters of input, but 1 at least and 4 at most: the cap is the feature.
    """
    most = max(1, min(4, input_chars // 5000))
    every = targets.select("path", F.lit(0).alias("kind"), "place").unionByName(retrieved.filter(~paths.is_test_path(F.col("path"))).select("path", F.lit(1).alias("kind"), "place"))
    first = every.groupBy("path").agg(F.min(F.struct("kind", "place")).alias("o")).orderBy("o", "path").limit(most)
    return first.select("path", F.row_number().over(Window.orderBy("o", "path")).alias("place"))


# -- what a requested change is written from ------------------------------------------

# Lines of a file that is shown whole, the share of the input for contents, the room that a further file
# needs, windows of a file, lines of a file without a range; importers read and shown, paths told.
WHOLE_LINES, CONTENT_SHARE, LEAST_ROOM, WINDOWS, FIRST_LINES = 260, 0.65, 900, 3, 80
IMPORTERS, IMPORTERS_SHOWN, KNOWN_PATHS = 24, 14, 120
CUT = "\n... [excerpt truncated]"


def targets_each(targets: DataFrame, retrieved: DataFrame, input_chars: int) -> DataFrame:
    """ranked_targets for many requests: request, path, place; targets and retrieved have a request, too."""
    most = max(1, min(4, input_chars // 5000))
    every = targets.select("request", "path", F.lit(0).alias("kind"), "place").unionByName(retrieved.filter(~paths.is_test_path(F.col("path"))).select("request", "path", F.lit(1).alias("kind"), "place"))
    first = every.groupBy("request", "path").agg(F.min(F.struct("kind", "place")).alias("o"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("o", "path"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("request", "path", "place")


def change_files(targets: DataFrame, files: DataFrame, ranges: DataFrame, input_chars: int) -> DataFrame:
    """request, place, path, lines, windowed, rendered: the files of each request that its budget still shows.

    targets: those of targets_each, a few a request. files: path, content. ranges: request, path, start, end of the
    retrieved places. A file is shown whole with line numbers, or in windows around its ranges (its first lines without one)
    where it is too long or doesn't fit into what the files before have left; windows that don't fit are cut.
    A file that would find less than LEAST_ROOM characters isn't shown, nor are those behind it. Null and empty contents are skipped.
    """
    rows = targets.join(files.select("path", "content"), "path").filter("content <> ''").withColumn("lines", F.size(text.lines_of(F.col("content"))))
    given = ranges.select("request", "path", "start", "end", F.lit(True).alias("__given"))
    own = rows.select("request", "path", "lines").join(given, ["request", "path"], "left")
    own = own.select("request", "path", "lines", F.coalesce("start", F.lit(1)).alias("start"), F.when(F.col("__given"), F.col("end")).otherwise(F.least("lines", F.lit(FIRST_LINES))).alias("end"))
    merged = merge_windows(own, ["request", "path"], F.col("lines"), most=WINDOWS)
    merged = merged.groupBy("request", "path").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("windows"))
    shown = rows.join(merged, ["request", "path"])
    each = F.struct("place", "path", "lines", text.numbered(F.col("content")).alias("whole"), text.numbered_windows(F.col("content"), F.col("windows")).alias("part"))
    lists = shown.groupBy("request").agg(F.sort_array(F.collect_list(each)).alias("files"))  # a few, as targets are

    state = "struct<room:int,kept:array<struct<place:int,path:string,lines:int,windowed:boolean,rendered:string>>>"
    room = int(input_chars * CONTENT_SHARE + 0.5)

    def step(s: Column, f: Column) -> Column:
        windowed = (F.length(f["whole"]) > s["room"]) | (f["lines"] > WHOLE_LINES)
        part = F.when(F.length(f["part"]) > s["room"], F.concat(F.substring(f["part"], F.lit(1), s["room"]), F.lit(CUT))).otherwise(f["part"])
        rendered = F.when(windowed, part).otherwise(f["whole"])
        row = F.struct(f["place"].cast("int").alias("place"), f["path"].alias("path"), f["lines"].alias("lines"), windowed.alias("windowed"), rendered.alias("rendered"))
        after = F.struct((s["room"] - F.length(rendered)).alias("room"), F.concat(s["kept"], F.array(row)).alias("kept"))
        return F.when(s["room"] < LEAST_ROOM, s).otherwise(after).cast(state)

    none = F.struct(F.lit(room).alias("room"), F.array().cast(state[state.index("array") : -1]).alias("kept")).cast(state)
    return lists.select("request", F.inline(F.aggregate("files", none, step)["kept"]))


def change_importers(edges: DataFrame, shown: DataFrame, most: int = IMPORTERS, listed: int = IMPORTERS_SHOWN) -> DataFrame:
    """request, place, importer: lines for the calls and imports that reach a request's files (request, path), the first of them."""
    order = ["from_file", "line", "type", "to_name", "to_file", "from_symbol"]
    near = edges.filter("type IN ('imports', 'calls')").join(shown.select(F.col("path").alias("to_file")).distinct(), "to_file", "left_semi")
    few = first_each(near, ["to_file"], order, most).join(shown.select("request", F.col("path").alias("to_file")).distinct(), "to_file")
    place = F.row_number().over(Window.partitionBy("request").orderBy(*order))
    origin = F.when(F.coalesce("from_symbol", F.lit("")) == "", "<module>").otherwise(F.col("from_symbol"))
    said = F.format_string("- %s:%d %s %s %s", F.col("from_file"), F.col("line"), origin, F.col("type"), F.col("to_name"))
    return few.select("request", place.alias("place"), said.alias("importer")).filter(F.col("place") <= min(most, listed))


def known_paths(files: DataFrame, most: int = KNOWN_PATHS) -> DataFrame:
    """place, path: the paths a new file must not collide with, the first `most`."""
    first = files.select("path").distinct().orderBy("path").limit(most)
    return first.select(F.row_number().over(Window.orderBy("path")).alias("place"), "path")  # `most` rows
