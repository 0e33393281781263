"""Similarity search over an inverted file: vectors in cells around centroids, probed by an equi-join.

An index is a table of blocks: cell, block, ids and vectors of some thousand points. Queries are put into blocks of the cells that
they probe, and a block of queries meets each block of its cell, so a hot cell is as many equal tasks as it has blocks.
How many cells a query has to probe is measured: on a bounded sample of queries, against the search of all cells, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.rules import SCORE_FLOOR, TOP_K
from strataloom.operators.shuffles import Scratch
from strataloom.plans.session import ship

#: Points of a block, queries of a block, and vectors that centroids are fitted on at most (the documented bound of the fit).
BLOCK, ASKED, SAMPLE = 4096, 1024, 16_384
#: Cells at most, rounds of the fit; queries that the number of probes is measured on at most, and the recall it has to reach there.
CELLS, ROUNDS, MEASURED, RECALL = 4096, 12, 256, 0.95
#: Scores that a task has at a time when it looks for the nearest cells, and pairs whose scores it sums at a time.
SCORES, PAIRS = 1 << 20, 1 << 16


def _matrix(vectors: pd.Series, dimension: int | None = None) -> np.ndarray:
    m = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, dimension or 0))
    return m.astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_centroids(points: DataFrame, vector_col: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most `cells` cells (by default the root of the number of points, CELLS at most).

    They are fitted on `sample` vectors: those whose hashes are smallest, so that reruns and any layout agree. Copies
    count once. The sample is all that the driver holds.
    """
    if cells is None:
        cells = min(CELLS, max(1, round(points.count() ** 0.5)))
    chosen = points.filter(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v"), F.xxhash64(vector_col).alias("h")).dropDuplicates(["h"]).orderBy("h").limit(sample)
    m = _unit(_matrix(chosen.select("v").toPandas()["v"]))
    if not len(m):
        return np.zeros((1, 1))
    centers = m[:: max(1, len(m) // cells)][:cells].copy()
    for _ in range(rounds):
        near = np.argmax(m @ centers.T, axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, near, m)
        filled = np.linalg.norm(total, axis=1) > 0
        centers[filled] = _unit(total[filled])
    return centers


def _nearest(centers: np.ndarray, vector_col: str, probes: int):
    """Pandas batches with `cells`: the probes nearest cells of each vector, nearest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = max(1, SCORES // len(centers))
            for i in range(0, len(b), step):
                part = b.iloc[i : i + step]
                s = _matrix(part[vector_col]) @ centers.T
                yield part.assign(cells=list(np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return run


def _in_cells(rows: DataFrame, centers: np.ndarray | None, probes: int) -> DataFrame:
    """rows (id, vector) with cell, a row for each cell; all in cell 0 without centroids. Null vectors are left out."""
    ship(rows.sparkSession)
    rows = rows.filter(F.col("vector").isNotNull())
    if centers is None:
        return rows.withColumn("cell", F.lit(0))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(_nearest(centers, "vector", probes), f"{kinds}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def _blocks(rows: DataFrame, size: int, scratch: Scratch, name: str) -> DataFrame:
    """cell, block, ids, vectors: rows (id, vector, cell) in blocks of about `size`, dealt by a hash of the id."""
    rows = scratch.write(rows, f"{name}-rows")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    # one row a cell, and there are CELLS at most
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id", "cell"), F.col("n")).cast("int"))
    packed = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    return scratch.write(packed.select("cell", "block", F.col("rows.id").alias("ids"), F.col("rows.vector").alias("vectors")), name)


def build_index(points: DataFrame, vector_col: str, id_col: str, scratch: Scratch, centers: np.ndarray | None = None, block: int = BLOCK) -> DataFrame:
    """The written blocks of all points with a vector, each in the cell of its nearest centroid; in one cell without centroids."""
    rows = points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return _blocks(_in_cells(rows, centers, 1), block, scratch, "points")


def _best(ids: np.ndarray, m: np.ndarray, names: np.ndarray, q: np.ndarray, k: int, floor: float) -> pd.DataFrame:
    """query_id, id, score: the k points of a block that are most similar to each query; both as unit vectors."""
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    s = m @ q.T
    least = np.partition(s, -k, axis=0)[-k] if len(m) > k else np.full(s.shape[1], -np.inf)
    at, of_query = np.nonzero(s >= np.maximum(least, floor) - 1e-9)
    # a matrix product may round by place; this sum is the same in every block
    score = [np.einsum("ij,ij->i", m[at[i : i + PAIRS]], q[of_query[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)]
    found = pd.DataFrame({"query_id": names[of_query], "id": ids[at], "score": np.concatenate([np.empty(0), *score])})
    found = found[found.score >= floor].sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
    return found.groupby("query_id").head(k)


def search(index: DataFrame, queries: DataFrame, scratch: Scratch, centers: np.ndarray | None = None, probes: int | None = None, k: int = TOP_K, floor: float = SCORE_FLOOR, asked: int = ASKED) -> DataFrame:
    """query_id, id, score, place: the k most similar points of the probed cells for each of queries (query_id, vector).

    centers: those of the index, of one cell without. probes: the nearest cells that a query looks into; None: all,
    which is exact. Ties go to the smaller id; null vectors neither ask nor are found. Nothing is collected; a task
    holds a block of points and one of queries.
    """
    probes = len(centers) if centers is not None and probes is None else probes
    of = _blocks(_in_cells(queries.select(F.col("query_id").alias("id"), "vector"), centers, probes or 1), asked, scratch, "queries")
    held = index.groupBy("cell").agg(F.max("block").alias("last"))
    meet = of.join(F.broadcast(held), "cell").select("cell", F.col("ids").alias("query_ids"), F.col("vectors").alias("asked"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"))
    pairs = index.join(meet, ["cell", "block"]).select("ids", "vectors", "query_ids", "asked")
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.schema['ids'].dataType.elementType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, id_ = b.column("query_ids").type.value_type, b.column("ids").type.value_type
            for i in range(len(b)):
                # a block's vectors are read where Arrow has them, never as an object each
                ids, names = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "query_ids"))
                m, q = (b.column(c)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c, n in (("vectors", len(ids)), ("asked", len(names))))
                found = _best(ids, _unit(m.astype(np.float64)), names, _unit(q.astype(np.float64)), k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in (("query_id", name), ("id", id_), ("score", pa.float64()))], ["query_id", "id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.mapInArrow(run, kind).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def probes_for(index: DataFrame, queries: DataFrame, scratch: Scratch, centers: np.ndarray, target: float = RECALL, k: int = TOP_K, floor: float = SCORE_FLOOR, measured: int = MEASURED) -> int:
    """The fewest probes that find `target` of the exact results of `measured` queries, those whose hashes are smallest."""
    sample = scratch.write(queries.orderBy(F.xxhash64("query_id", "vector"), "query_id").limit(measured), "measured")
    exact = scratch.write(search(index, sample, scratch, centers, None, k, floor), "exact")
    order = sample.select("query_id", "vector").mapInPandas(_nearest(centers, "vector", len(centers)), "query_id " + sample.schema["query_id"].dataType.simpleString() + f", vector {sample.schema['vector'].dataType.simpleString()}, cells array<int>")
    place = order.select("query_id", F.posexplode("cells").alias("probe", "cell"))
    held = index.select("cell", F.explode("ids").alias("id"))
    # a result lies in the cell that is its query's probe-th: MEASURED * k rows at most
    needed = exact.join(held, "id").join(place, ["query_id", "cell"]).groupBy("probe").agg(F.count("*").alias("n")).orderBy("probe").collect()
    least = target * sum(r["n"] for r in needed)
    for r in needed:
        least -= r["n"]
        if least <= 1e-9:
            return r["probe"] + 1
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of a query's exact results (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
