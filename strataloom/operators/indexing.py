"""A repository's index as one job: selection, analysis, chunks, vectors and graph; whole, or for a push."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.functions.rules import MAX_FILE_SIZE, MAX_FILES
from strataloom.operators import chunking, graph, selection, upserts, vectors
from strataloom.operators.extract.analyze import analyze_files
from strataloom.operators.shuffles import Scratch
from strataloom.streaming.ledger import Store

# Chunks of a repository, and changed files that a push may bring.
MAX_CHUNKS, MAX_CHANGED = 6000, 120

#: The column that names the file of a row, for each table of an index.
FILE_OF = {"files": "file_path", "symbols": "file_path", "edges": "from_file", "chunks": "file_path"}


def _tables(sources: DataFrame, most_chunks: int | None, provider, extra_files: DataFrame | None = None, extra_symbols: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, symbols, edges and chunks of sources (file_path, content)."""
    return _parts(analyze_files(sources), most_chunks, provider, extra_files, extra_symbols)


def _parts(analyzed: DataFrame, most_chunks: int | None, provider, extra_files: DataFrame | None = None, extra_symbols: DataFrame | None = None) -> dict[str, DataFrame]:
    chunks = chunking.chunk_files(analyzed)
    if most_chunks is not None:
        chunks = chunking.cap_chunks(chunks, most_chunks)
    return graph.build_graph(analyzed, extra_files, extra_symbols) | {"chunks": vectors.embed(chunks, provider=provider)}


def index_full(tree: DataFrame, max_files: int = MAX_FILES, max_file_size: int = MAX_FILE_SIZE, max_chunks: int = MAX_CHUNKS, provider=vectors.hashed_embedding) -> dict[str, DataFrame]:
    """The index of one repository: files, symbols, edges, chunks and a one-row `status`.

    tree: path, size, content (null where it is binary). Only selected files with content are analysed. The status is
    `partial` where files or chunks were left out, and otherwise `indexed`. The tables replace those of the
    repository as a whole (upserts.replace_partitions); nothing is collected.
    """
    chosen = selection.select_files(tree.select("path", "size"), max_files=max_files, max_file_size=max_file_size)
    sources = tree.join(chosen.filter("selected").select("path"), "path", "left_semi").filter("content IS NOT NULL AND content <> ''")
    out = _tables(sources.select(F.col("path").alias("file_path"), "content"), max_chunks, provider)
    counts = selection.selection_summary(chosen, []).join(out["chunks"].agg(F.count("*").alias("chunk_count")))
    partial = F.col("truncated") | (F.col("chunk_count") >= max_chunks)
    return out | {"status": counts.withColumn("status", F.when(partial, "partial").otherwise("indexed"))}


def sync_refusal(branch: Column, indexed_branch: Column, status: Column) -> Column:
    """Why a push isn't synced (another branch than the indexed one, or nothing indexed yet); null where it is."""
    other = (F.coalesce(indexed_branch, F.lit("")) != "") & ~branch.eqNullSafe(indexed_branch)
    return F.when(other, "other-branch").when(status == "not_indexed", "not-indexed")


def changed_files(changes: DataFrame, most: int = MAX_CHANGED) -> tuple[DataFrame, DataFrame]:
    """(file_path of what is read again, file_path of what goes) of a push's changes (place, file_path, kind).

    Read again are added and modified paths that the selection rules include whatever their size, each once, the first
    `most` in the order of place: the cap is the feature.
    """
    live = changes.filter("kind IN ('added', 'modified')").filter(paths.exclusion(F.col("file_path"), F.lit(1), MAX_FILE_SIZE).isNull())
    first = live.groupBy("file_path").agg(F.min("place").alias("place")).orderBy("place", "file_path").limit(most)
    return first.select("file_path"), changes.filter("kind = 'removed'").select("file_path").distinct()


def index_incremental(old: dict[str, DataFrame], changes: DataFrame, contents: DataFrame, max_file_size: int = MAX_FILE_SIZE, provider=vectors.hashed_embedding) -> dict[str, DataFrame]:
    """The tables of `old` after a push: rows of removed and changed files go, changed files are analysed again.

    contents: path, size, content at the pushed commit; of the changed files those with content that the rules still
    include at their real size come back. The unchanged rest takes part in resolution. Edges of unchanged files stay
    as they are.
    """
    changed, removed = changed_files(changes)
    gone = changed.unionByName(removed).distinct()
    rest = {name: upserts.drop_keys(old[name], gone.withColumnRenamed("file_path", column), [column]) for name, column in FILE_OF.items()}
    now = contents.filter(paths.exclusion(F.col("path"), F.col("size"), max_file_size).isNull() & F.col("content").isNotNull() & (F.col("content") != ""))
    sources = now.select(F.col("path").alias("file_path"), "content").join(changed, "file_path", "left_semi")
    new = _tables(sources, None, provider, rest["files"].select("file_path"), rest["symbols"])
    return {name: graph.latest_edges(old[name], new[name], gone, column) for name, column in FILE_OF.items()}


STATUS = "repository string, status string, files long, symbols long, edges long, chunks long, excluded long, truncated boolean"


def index_store(spark: SparkSession, path: str, like: dict[str, DataFrame]) -> Store:
    """A store for the tables of many repositories and their status; like: the tables of any index, for their schemas."""
    schemas = {name: "repository string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like[name].schema) for name in FILE_OF}
    return Store(spark, path, {name: (schema, ["repository"]) for name, schema in (schemas | {"status": STATUS}).items()})


def index_repository(store: Store, batch: int, repository: str, tree: DataFrame, max_files: int = MAX_FILES, max_file_size: int = MAX_FILE_SIZE, max_chunks: int = MAX_CHUNKS, provider=vectors.hashed_embedding) -> bool:
    """Index a repository's tree (path, size, content) into the store, with its status; False where the batch is a replay.

    The counts of the status are observed on the rows while they are written: nothing is read again to count it.
    """
    spark, scratch = store.spark, Scratch(store.spark, "index")
    seen = {name: Observation(name) for name in ("selected", *FILE_OF)}
    chosen = selection.select_files(tree.select("path", "size"), max_files=max_files, max_file_size=max_file_size)
    chosen = chosen.observe(seen["selected"], F.count_if(~F.col("selected")).alias("excluded"), F.count_if(F.col("reason") == "over-max-files").alias("over"))
    chosen = scratch.write(chosen, "chosen")
    sources = tree.join(chosen.filter("selected").select("path"), "path", "left_semi").filter("content IS NOT NULL AND content <> ''")
    analyzed = scratch.write(analyze_files(sources.select(F.col("path").alias("file_path"), "content")), "analyzed")
    index = {name: rows.observe(seen[name], F.count(F.lit(1)).alias("n")) for name, rows in _parts(analyzed, max_chunks, provider).items()}

    def status() -> DataFrame:
        n = {name: seen[name].get["n"] for name in FILE_OF}
        over = seen["selected"].get["over"] > 0
        row = (repository, "partial" if over or n["chunks"] >= max_chunks else "indexed", n["files"], n["symbols"], n["edges"], n["chunks"], seen["selected"].get["excluded"], over)
        return spark.createDataFrame([row], STATUS)

    return _replace(store, batch, repository, {}, lambda old, changes: index, status)


def store_index(store: Store, batch: int, repository: str, index: dict[str, DataFrame]) -> bool:
    """Put a whole index in place of what is stored of the repository; False where the batch is a replay."""
    return _replace(store, batch, repository, {}, lambda old, changes: index)


def store_push(store: Store, batch: int, repository: str, changes: DataFrame, contents: DataFrame, **settings) -> bool:
    """Apply a push (see index_incremental) to the stored index of the repository; False where the batch is a replay."""
    given = {"changes": changes, "contents": contents}
    return _replace(store, batch, repository, given, lambda old, staged: index_incremental(old, staged["changes"], staged["contents"], **settings))


def _replace(store: Store, batch: int, repository: str, given: dict[str, DataFrame], make, status=None) -> bool:
    """Put what make(old, given) returns in place of the repository's rows, and of its status where there is a new one."""
    own = F.col("repository") == repository
    named = {name: rows.withColumn("repository", F.lit(repository)) for name, rows in given.items()}
    named["repository"] = store.spark.range(1).select(F.lit(repository).alias("repository"))

    def merge(old: dict[str, DataFrame], staged: dict[str, DataFrame]) -> dict:
        before = {name: old[name].filter(own).drop("repository") for name in FILE_OF}
        after = make(before, {name: rows.drop("repository") for name, rows in staged.items()})
        out: dict = {name: old[name].filter(~own).unionByName(after[name].withColumn("repository", F.lit(repository))) for name in FILE_OF}
        if status is not None:
            out["status"] = lambda: old["status"].filter(~own).unionByName(status())
        return out

    return store.update(batch, named, merge)
