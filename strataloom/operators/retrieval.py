"""Hybrid retrieval: chunks by symbol, by similarity and by one hop of the graph, packed into a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.impact import first_each
from strataloom.operators.packing import greedy
from strataloom.operators.shuffles import Scratch, maybe_in

# Weights of the origins, and limits.
WEIGHT = {"structural": 3, "semantic": 2, "graph": 1, "fallback": 0}
SYMBOLS, STRUCTURAL_FILES, STRUCTURAL, FOCUS, EDGES, NEIGHBOURS, GRAPH_READ, GRAPH, NOTED, NOTES, FALLBACK = 12, 40, 60, 3, 60, 6, 24, 6, 12, 14, 20
RANK = {"graph": 0.2, "fallback": 0.05}
CITATIONS = 12


def chunks_of_files(chunks: DataFrame, files: DataFrame, most: int, most_files: int = STRUCTURAL_FILES) -> DataFrame:
    first = files.select("file_path").distinct().orderBy("file_path").limit(most_files)
    return chunks.join(first, "file_path", "left_semi").orderBy("file_path", "start_line").limit(most)


def covering_chunk(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each symbol the first chunk of its file that begins at most two lines below its start and reaches it."""
    c = chunks.withColumnsRenamed({x: f"c_{x}" for x in chunks.columns})
    inside = (F.col("file_path") == F.col("c_file_path")) & (F.col("c_start_line") <= F.col("start_line") + 2) & (F.col("c_end_line") >= F.col("start_line"))
    first = F.row_number().over(Window.partitionBy("file_path", "name", "start_line").orderBy("c_start_line", "c_end_line"))
    return symbols.join(c, inside).withColumn("__n", first).filter("__n = 1").drop("__n")


def neighbours_each(edges: DataFrame, focus: DataFrame, scratch: Scratch, most_edges: int = EDGES, most: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """(edges at the focus files of each question, file_path of the first files at their other ends); focus: asked, file_path.

    Repeated edges count once. Edges far from all questions are left out by a bitmap, and each file gives as many as a
    question may have, so a file with very many edges costs no more than others. The edges are written: several parts read them.
    """
    order = ["from_file", "line", "to_name", "to_file"]
    keys = scratch.write(focus.select("asked", "file_path").distinct().withColumn("__hash", F.xxhash64("file_path")), "focus")

    def at(end: str, kinds: str) -> DataFrame:
        near = maybe_in(edges.filter(kinds).withColumn("__hash", F.xxhash64(end)), keys.select("__hash"), "__hash").drop("__hash")
        few = first_each(near.dropDuplicates(), [end], [*order, *sorted(set(edges.columns) - {*order})], most_edges)
        return few.join(keys.select("asked", F.col("file_path").alias(end)), end).select("asked", *edges.columns)

    both = at("to_file", "type IN ('calls', 'imports')").unionByName(at("from_file", "type = 'calls'")).dropDuplicates()
    near = scratch.write(first_each(both, ["asked"], [*order, *sorted(set(edges.columns) - {*order})], most_edges), "near")
    ends = near.select("asked", "from_file", "line", F.posexplode(F.array("from_file", "to_file")).alias("k", "file_path")).filter("file_path <> ''").join(keys, ["asked", "file_path"], "left_anti")
    files = ends.groupBy("asked", "file_path").agg(F.min(F.struct("from_file", "line", "k")).alias("o"))
    return near, first_each(files, ["asked"], ["o"], most).select("asked", "file_path")


def neighbour_files(edges: DataFrame, focus: DataFrame, most_edges: int = EDGES, most: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """neighbours_each for one question: (edges, file_path)."""
    near, files = neighbours_each(edges, focus.select(F.lit(0).alias("asked"), "file_path"), Scratch(edges.sparkSession, "neighbours"), most_edges, most)
    return near.drop("asked"), files.drop("asked")


def graph_notes(near: DataFrame) -> DataFrame:
    first = near.orderBy("from_file", "line", "to_name", "to_file").limit(NOTED)
    module = F.when(F.col("from_symbol") == "", "<module>").otherwise(F.col("from_symbol"))
    target = F.when(F.col("to_file") == "", "external").otherwise(F.col("to_file"))
    call = F.concat("from_file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), module, F.lit(" -> "), "to_symbol", F.lit(" ("), target, F.lit(")"))
    note = F.when((F.col("type") == "calls") & (F.col("to_symbol") != ""), call).when((F.col("type") == "imports") & (F.col("to_file") != ""), F.concat("from_file", F.lit(" imports "), "to_file"))
    return first.select("from_file", "line", note.alias("note")).filter("note IS NOT NULL").groupBy("note").agg(F.min(F.struct("from_file", "line")).alias("o")).orderBy("o").limit(NOTES).select("note")


@dataclass
class Retrieval:
    """chunks: what fits, in order, with origin and rank; notes: how the graph touches it."""

    chunks: DataFrame
    notes: DataFrame
    symbols: DataFrame


def retrieve(chunks: DataFrame, symbols: DataFrame, edges: DataFrame, semantic: DataFrame, names: DataFrame, max_chars: int = 16_000, include_graph: bool = True) -> Retrieval:
    """Context for a question.

    semantic: its similar chunks with score, best first; names: the identifiers in it. Of several ways to one chunk
    (file and first line) the strongest origin counts. Nothing found: the first chunks of the repository. What the
    limits bound to some hundred rows is written, as several parts read it.
    """
    scratch = Scratch(chunks.sparkSession, "retrieval")
    semantic = scratch.write(semantic, "semantic")
    matched = scratch.write(symbols.join(names.select("name").distinct(), "name", "left_semi").orderBy("file_path", "start_line").limit(SYMBOLS), "matched")
    keep = ["file_path", "start_line", "end_line", "symbol_name", "symbol_type", "code"]
    structural = covering_chunk(matched, chunks_of_files(chunks, matched, STRUCTURAL)).select(*[F.col(f"c_{k}").alias(k) for k in keep])
    origin = lambda df, name, rank: df.select(*keep, F.lit(name).alias("origin"), F.lit(WEIGHT[name]).alias("weight"), rank.cast("double").alias("rank"))
    found = origin(structural, "structural", F.lit(1.0)).unionByName(origin(semantic, "semantic", F.col("score")))
    notes = symbols.sparkSession.createDataFrame([], "note string")
    if include_graph:
        best = semantic.orderBy(F.desc("score"), "file_path", "start_line").limit(FOCUS)
        near, files = neighbour_files(edges, matched.select("file_path").unionByName(best.select("file_path")))
        hop = chunks_of_files(chunks, files, GRAPH_READ).orderBy("file_path", "start_line").limit(GRAPH)
        found = found.unionByName(origin(hop, "graph", F.lit(RANK["graph"])))
        notes = graph_notes(near)
    found = scratch.write(found, "found")
    any_ = found.limit(1).agg(F.count("*").alias("n"))
    rest = chunks.orderBy("file_path", "start_line").limit(FALLBACK).join(any_).filter("n = 0")
    found = found.unionByName(origin(rest, "fallback", F.lit(RANK["fallback"])))
    once = found.groupBy("file_path", "start_line").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("file_path", "start_line")]), F.struct("weight", "rank", "end_line")).alias("c")).select("file_path", "start_line", "c.*")
    once = scratch.write(once, "once")
    return Retrieval(_packed(once, max_chars), notes, matched)


def _packed(found: DataFrame, max_chars: int) -> DataFrame:
    """found has a row for each of at most some hundred chunks, by the limits above: its order may be gathered."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), (-F.col("rank")).alias("r"), "file_path", "start_line", F.length("code").alias("n"))))
    lists = found.agg(order.alias("l"))
    taken = lists.select("l", F.posexplode(greedy(F.transform("l", lambda x: x["n"]), max_chars)).alias("place", "take")).filter("take")
    return found.join(taken.select("place", F.get("l", F.col("place")).alias("x")).select("place", "x.file_path", "x.start_line"), ["file_path", "start_line"]).orderBy("place")


def citations(chunks: DataFrame) -> DataFrame:
    """file_path, start_line, end_line, symbol_name, score of the first chunks, each place once."""
    name = F.when(F.col("symbol_name") == "<module>", "").otherwise(F.col("symbol_name"))
    once = chunks.groupBy("file_path", "start_line").agg(F.min_by(F.struct("place", "end_line", name.alias("symbol_name"), F.coalesce("rank", F.lit(0.0)).alias("score")), "place").alias("c"))
    return once.select("c.place", "file_path", "start_line", "c.end_line", "c.symbol_name", "c.score").orderBy("place").limit(CITATIONS)


def chunk_reference(n: Column) -> Column:
    """`[n] path:first-last (kind name)`."""
    return F.format_string("[%d] %s:%d-%d (%s %s)", n, F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_type"), F.col("symbol_name"))


def grounding(n_chunks: Column, n_files: Column, n_symbols: Column) -> Column:
    """The answer where nothing was retrieved: a refusal with what the index holds; null otherwise."""
    return F.when(n_chunks == 0, F.format_string("Nothing in the index supports an answer: %d files and %d symbols were searched.", n_files, n_symbols))
