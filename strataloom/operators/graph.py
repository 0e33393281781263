"""The relationship graph: imports, definitions, calls, tests and routes as one edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.functions.rules import NOISE_CALLS

EDGE = ["type", "from_file", "from_symbol", "to_file", "to_symbol", "to_name", "line", "external", "confidence"]
# Confidences by how a call resolves, and of imports.
IMPORTED, IMPORTED_MANY, LOCAL, UNIQUE, AMBIGUOUS, UNKNOWN = 0.95, 0.6, 0.85, 0.7, 0.35, 0.3
IMPORT_FOUND, IMPORT_EXTERNAL = 0.95, 0.5
MOST_CALLS = 40


def resolve_imports(imports: DataFrame, files: DataFrame, resolve_aliases: bool = False) -> DataFrame:
    """imports (file_path, raw, is_external, ..) with `resolved` ('' where none) and is_external brought up to date.

    Candidate paths are exploded with their rank and joined to the files; the best rank wins by a partial minimum.
    External specifiers aren't looked up unless resolve_aliases is set.
    """
    rows = imports.withColumn("__id", F.xxhash64("file_path", "raw"))
    look = rows if resolve_aliases else rows.filter(~F.col("is_external"))
    tries = look.select("file_path", "raw").distinct().select("file_path", "raw", F.posexplode(paths.import_candidates(F.col("file_path"), F.col("raw"))).alias("rank", "candidate"))
    found = tries.join(files.select(F.col("file_path").alias("candidate")).distinct(), "candidate").groupBy("file_path", "raw").agg(F.min(F.struct("rank", "candidate"))["candidate"].alias("resolved"))
    out = rows.drop("__id").join(found, ["file_path", "raw"], "left").withColumn("resolved", F.coalesce("resolved", F.lit("")))
    return out.withColumn("is_external", (F.col("resolved") == "") if resolve_aliases else F.col("is_external") | (F.col("resolved") == ""))


def symbol_index(symbols: DataFrame) -> DataFrame:
    """key, sym_file, sym_name for both names of each symbol."""
    names = F.array_distinct(F.filter(F.array("name", "qualified_name"), lambda n: n != ""))
    target = F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("name"))
    return symbols.select(F.explode(names).alias("key"), F.col("file_path").alias("sym_file"), target.alias("sym_name"), "start_line")


def resolve_calls(calls: DataFrame, index: DataFrame, imported: DataFrame) -> DataFrame:
    """calls (call_id, file_path, to, ..) with to_file, to_symbol, confidence.

    Of the symbols with the called name: the one in an imported file; of several the first by path and line; one in
    the file itself; the only one there is. Otherwise the call stays unresolved. Counts and firsts are partial
    aggregates by call, so no candidate list is gathered.
    """
    hits = calls.select("call_id", "file_path", F.col("to").alias("key")).join(index, "key")
    hits = hits.join(imported.select("file_path", F.col("resolved").alias("sym_file"), F.lit(True).alias("is_imported")).distinct(), ["file_path", "sym_file"], "left")
    place = F.struct("sym_file", "start_line", "sym_name")
    is_imported, is_local = F.col("is_imported").isNotNull(), F.col("sym_file") == F.col("file_path")
    picked = hits.groupBy("call_id").agg(
        F.count("*").alias("n"), F.count_if(is_imported).alias("n_imported"), F.min(F.when(is_imported, place)).alias("imported"), F.min(F.when(is_local, place)).alias("local"), F.min(place).alias("any")
    )
    case = lambda a, b, c, d, other: F.when(F.col("n_imported") == 1, a).when(F.col("n_imported") > 1, b).when(F.col("local").isNotNull(), c).when(F.col("n") == 1, d).otherwise(other)
    field = lambda f: case(F.col("imported")[f], F.col("imported")[f], F.col("local")[f], F.col("any")[f], F.lit(""))
    picked = picked.select("call_id", field("sym_file").alias("to_file"), field("sym_name").alias("to_symbol"), case(*map(F.lit, (IMPORTED, IMPORTED_MANY, LOCAL, UNIQUE)), F.lit(AMBIGUOUS)).alias("confidence"))
    blank = {"to_file": F.coalesce("to_file", F.lit("")), "to_symbol": F.coalesce("to_symbol", F.lit("")), "confidence": F.coalesce("confidence", F.lit(UNKNOWN))}
    return calls.join(picked, "call_id", "left").withColumns(blank)


def unnest(analyzed: DataFrame, part: str) -> DataFrame:
    """file_path and language with the fields of one of imports, symbols, routes, calls, a row each."""
    return analyzed.select("file_path", "language", F.inline(part))


def build_graph(analyzed: DataFrame, extra_files: DataFrame | None = None, extra_symbols: DataFrame | None = None, resolve_aliases: bool = False) -> dict[str, DataFrame]:
    """files, symbols and edges of analysed files.

    extra_files and extra_symbols (as of the symbols table) take part in resolution without coming out: the
    unchanged rest of a repository in an incremental run.
    """
    is_test = paths.is_test_path(F.col("file_path"))
    known = analyzed.select("file_path") if extra_files is None else analyzed.select("file_path").unionByName(extra_files.select("file_path"))
    imports = resolve_imports(unnest(analyzed, "imports"), known, resolve_aliases)
    raw = unnest(analyzed, "symbols")
    noise = lambda c: c.isin(NOISE_CALLS)
    symbols = raw.withColumns({"is_test": is_test, "calls": F.slice(F.filter("calls", lambda c: ~noise(c)), 1, MOST_CALLS)})
    pool = raw.select("name", "qualified_name", "file_path", "start_line")
    index = symbol_index(pool if extra_symbols is None else pool.unionByName(extra_symbols.select("name", "qualified_name", "file_path", "start_line")))
    found = imports.filter("resolved <> ''").select("file_path", "resolved").distinct()

    calls = unnest(analyzed, "calls").filter((F.col("to") != "") & ~noise(F.col("to")))
    routes = unnest(analyzed, "routes").withColumn("handler", F.trim(F.split_part("handler", F.lit(","), F.lit(1)))).filter("handler <> ''")
    asked = calls.select("file_path", "to").unionByName(routes.select("file_path", F.substring_index("handler", ".", -1).alias("to"))).distinct()
    asked = asked.withColumn("call_id", F.struct("file_path", "to"))
    answers = resolve_calls(asked, index, found).select("file_path", "to", F.col("to_file"), F.col("to_symbol"), "confidence")

    edge = lambda **c: [c[n].alias(n) if n in c else F.lit("").alias(n) for n in EDGE]
    import_edges = imports.select(*edge(type=F.lit("imports"), from_file=F.col("file_path"), to_file=F.col("resolved"), to_name=F.col("raw"), line=F.col("line"), external=F.col("is_external"), confidence=F.when(F.col("resolved") != "", IMPORT_FOUND).otherwise(IMPORT_EXTERNAL)))
    define_edges = symbols.select(*edge(type=F.lit("defines"), from_file=F.col("file_path"), to_file=F.col("file_path"), to_symbol=F.col("qualified_name"), to_name=F.col("name"), line=F.col("start_line"), external=F.lit(False), confidence=F.lit(1.0)))
    called = calls.join(answers, ["file_path", "to"])
    tests = is_test & (F.col("to_file") != "") & (F.col("to_file") != F.col("file_path"))
    call_edges = called.select(*edge(type=F.when(tests, "tests").otherwise("calls"), from_file=F.col("file_path"), from_symbol=F.col("from"), to_file=F.col("to_file"), to_symbol=F.col("to_symbol"), to_name=F.col("to"), line=F.col("line"), external=F.col("to_file") == "", confidence=F.col("confidence")))
    routed = routes.withColumn("to", F.substring_index("handler", ".", -1)).join(answers, ["file_path", "to"])
    symbol = F.when(F.col("to_symbol") != "", F.col("to_symbol")).otherwise(F.col("handler"))
    route_edges = routed.select(*edge(type=F.lit("routes"), from_file=F.col("file_path"), from_symbol=F.concat_ws(" ", "method", "path"), to_file=F.col("to_file"), to_symbol=symbol, to_name=F.col("handler"), line=F.col("line"), external=F.lit(False), confidence=F.col("confidence")))
    edges = import_edges.unionByName(define_edges).unionByName(call_edges).unionByName(route_edges)

    resolved = imports.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("line", "raw", "resolved", "is_external", "specifiers"))).alias("imports"))
    content = F.col("content")
    files = analyzed.select(
        "file_path", "language", F.size(F.split(content, "\n")).alias("lines"), F.octet_length(content).alias("bytes"), is_test.alias("is_test"), "parse_ok", "exports", "routes", F.size("symbols").alias("symbol_count"), F.substring(F.sha2(content, 256), 1, 40).alias("content_sha")
    ).join(resolved, "file_path", "left")
    return {"files": files, "symbols": symbols, "edges": edges}


def latest_edges(old: DataFrame, new: DataFrame, changed: DataFrame, column: str) -> DataFrame:
    """A table in which the rows of changed paths give way to new ones."""
    return old.join(changed.select(F.col("file_path").alias(column)).distinct(), column, "left_anti").unionByName(new, allowMissingColumns=True)


def degree_layers(links: DataFrame, top: int = 12) -> DataFrame:
    """node, n_in, n_out, layer, place: sources (0), sinks (2) and the rest (1) of weighted links, the heaviest `top` of each."""
    out = links.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("n_out"))
    into = links.groupBy(F.col("target").alias("node")).agg(F.sum("weight").alias("n_in"))
    both = out.join(into, "node", "full").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    layer: Column = F.when((F.col("n_in") == 0) & (F.col("n_out") > 0), 0).when(F.col("n_out") == 0, 2).otherwise(1)
    ranked = both.withColumn("layer", layer).withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc(F.col("n_in") + F.col("n_out")), "node")))
    return ranked.filter(F.col("place") <= top)
