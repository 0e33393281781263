"""Facts of a repository: roll-ups by language, directory and module, entry points, the architecture graph, the tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.functions.rules import ENTRY_POINTS
from strataloom.operators import grams
from strataloom.operators.shuffles import Scratch, dealt, maybe_in


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).cast("long").alias("lines")).orderBy(F.desc("lines"), "language")


def by_directory(files: DataFrame, most: int = 12) -> DataFrame:
    top = paths.top_directory(F.col("file_path")).alias("directory")
    return files.groupBy(top).agg(F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).cast("long").alias("lines")).orderBy(F.desc("files"), "directory").limit(most)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count_if("is_test").alias("test_files"), F.sum("lines").cast("long").alias("lines"), F.sum(F.size("routes")).cast("long").alias("routes"))


# Directories and modules that are listed.
DIRECTORIES, MODULES = 12, 40


def repository_facts(files: DataFrame, keys: list[str] | None = None, directories: int = DIRECTORIES, most_modules: int = MODULES) -> DataFrame:
    """keys, kind (total, language, directory, module), name, place, files, test_files, lines, symbols, routes.

    files: keys, file_path, language, lines, is_test, symbol_count, n_routes. One aggregation over grouping sets, so the
    files are read once, and a task gives a row for each group to the shuffle. Languages follow their lines, the
    others their files; of directories and modules the first are listed. Null counts are none; a repository without files has no facts.
    """
    keys = keys or []
    rows = files.select(*keys, F.col("language"), paths.top_directory(F.col("file_path")).alias("directory"), paths.module_of(F.col("file_path")).alias("module"), "lines", "is_test", "symbol_count", "n_routes")
    sets = [[*keys, *s] for s in ([], ["language"], ["directory"], ["module"])]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = rows.groupingSets(sets, *keys, "language", "directory", "module").agg(F.grouping_id().alias("__g"), F.count("*").alias("files"), F.count_if("is_test").alias("test_files"), total("lines").alias("lines"), total("symbol_count").alias("symbols"), total("n_routes").alias("routes"))
    # bits of the grouping id: language, directory, module; a bit is set where the column isn't grouped by
    kind = F.element_at(F.create_map(*[F.lit(x) for p in ((7, "total"), (3, "language"), (5, "directory"), (6, "module")) for x in p]), F.col("__g").cast("int"))
    name = F.when(kind == "language", F.col("language")).when(kind == "directory", F.col("directory")).when(kind == "module", F.col("module"))
    one = one.select(*keys, kind.alias("kind"), name.alias("name"), "files", "test_files", "lines", "symbols", "routes").filter("files > 0")
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc(F.when(F.col("kind") == "language", F.col("lines")).otherwise(F.col("files"))), "name")
    most = F.when(F.col("kind") == "directory", directories).when(F.col("kind") == "module", most_modules).otherwise(2**31 - 1)
    return one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def facts_record(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a repository: files, test_files, lines, symbols, routes and the lists languages, directories, modules in order."""
    keys = keys or []
    measures = ["files", "test_files", "lines", "symbols", "routes"]
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "name", *measures)))), lambda x: x.dropFields("place"))
    totals = [F.max(F.when(F.col("kind") == "total", F.col(m))).alias(m) for m in measures]
    return facts.groupBy(*keys).agg(*totals, listed("language").alias("languages"), listed("directory").alias("directories"), listed("module").alias("modules"))


def entry_points(files: DataFrame, most: int = 8) -> DataFrame:
    hit = reduce(Column.__or__, [F.col("file_path").rlike(p) for p in ENTRY_POINTS])
    return files.filter(hit).select("file_path").orderBy(paths.depth(F.col("file_path")), "file_path").limit(most)


def modules(files: DataFrame, most: int = 40) -> DataFrame:
    """module, files, lines, symbols, routes, languages (map of counts): two aggregations, so no list of files is gathered."""
    rows = files.withColumn("module", paths.module_of(F.col("file_path")))
    each = rows.groupBy("module", "language").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"), F.sum("symbol_count").alias("symbols"), F.sum(F.size("routes")).alias("routes"))
    languages = F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n"))))
    out = each.groupBy("module").agg(F.sum("n").alias("files"), F.sum("lines").alias("lines"), F.sum("symbols").alias("symbols"), F.sum("routes").alias("routes"), languages.alias("languages"))
    return out.orderBy(F.desc("files"), "module").limit(most)


def module_links(edges: DataFrame, most: int = 120) -> DataFrame:
    """source, target, weight of import edges inside the repository between different modules."""
    inside = edges.filter("type = 'imports' AND NOT external AND to_file <> ''")
    ends = inside.select(paths.module_of(F.col("from_file")).alias("source"), paths.module_of(F.col("to_file")).alias("target")).filter("source <> target")
    return ends.groupBy("source", "target").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "source", "target").limit(most)


def visible_links(links: DataFrame, nodes: DataFrame, most: int = 80) -> DataFrame:
    """The heaviest links both ends of which are shown."""
    shown = nodes.select("node")
    both = links.join(shown.withColumnRenamed("node", "source"), "source", "left_semi").join(shown.withColumnRenamed("node", "target"), "target", "left_semi")
    return both.orderBy(F.desc("weight"), "source", "target").limit(most)


def path_tree(files: DataFrame, path: str = "file_path") -> DataFrame:
    """path, name, parent, is_file of every distinct prefix; folders before files, then by name."""
    rows = files.select(F.col(path).alias("whole"), F.explode(paths.prefixes(F.col(path))).alias("path"))
    nodes = rows.groupBy("path").agg(F.bool_or(F.col("path") == F.col("whole")).alias("is_file"))
    parent = F.when(F.col("path").contains("/"), paths.dirname(F.col("path"))).otherwise("")
    return nodes.select("path", paths.basename(F.col("path")).alias("name"), parent.alias("parent"), "is_file").orderBy("parent", "is_file", "name")


def related_tests(tests: DataFrame, changed: DataFrame, most: int = 60) -> DataFrame:
    """Test files whose path contains the name of a changed file, without its extension: the first `most` by path.

    All changed files count. The pieces of a path that are as long as some name meet the names by an equi-join, so the
    work grows with the paths and not with the pairs of them.
    """
    scratch = Scratch(tests.sparkSession, "tests")
    base = F.regexp_replace(paths.basename(F.col("file_path")), r"(?i)\.[a-z]+$", "")
    names = changed.select(base.alias("gram")).filter("gram IS NOT NULL").distinct()
    names = scratch.write(names.withColumn("hash", F.xxhash64("gram")), "names")
    sizes = sorted(r["n"] for r in names.select(F.length("gram").alias("n")).distinct().collect())
    if 0 in sizes:  # the empty name is in every path
        hits = tests.filter("file_path IS NOT NULL")
    elif sizes:
        pieces = maybe_in(grams.postings(dealt(tests.select("file_path")), "file_path", "file_path", tuple(sizes)), names.select("hash"), "hash")
        found = pieces.join(names, ["gram", "hash"]).filter(F.contains("id", "gram")).select(F.col("id").alias("file_path")).distinct()
        hits = tests.join(found, "file_path", "left_semi")
    else:
        hits = tests.limit(0)
    return hits.orderBy("file_path").limit(most)


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
