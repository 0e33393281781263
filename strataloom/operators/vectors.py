"""Exact similarity search over stored vectors, with scope and filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.rules import SCORE_FLOOR, TOP_K
from strataloom.functions.text import embedding_text
from strataloom.operators import vector_index
from strataloom.operators.shuffles import Scratch
from strataloom.plans.session import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def scope(points: DataFrame, tenant_col: str, tenant: object, **filters) -> DataFrame:
    """Rows of one tenant, which is mandatory, under further equalities or memberships; not_<col> excludes."""
    if tenant is None:
        raise ValueError("a search needs a tenant")
    out = points.filter(F.col(tenant_col) == tenant)
    for name, value in filters.items():
        col, keep = (name[4:], False) if name.startswith("not_") else (name, True)
        test = F.col(col).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(col) == value
        out = out.filter(test if keep else ~test)
    return out


def scores(points: DataFrame, query: list[float], vector_col: str) -> DataFrame:
    """points with score: cosine by numpy over Arrow batches, each row read once; the query travels in the plan."""
    ship(points.sparkSession)
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            if not len(b):
                yield pd.Series([], dtype="float64")
                continue
            m = np.stack(b.to_numpy()).astype(np.float64)
            length = np.linalg.norm(m, axis=1)
            yield pd.Series(m @ q / np.where(length == 0, 1, length))

    return points.withColumn("score", score(vector_col))


def top_k(points: DataFrame, query: list[float], vector_col: str, id_col: str, k: int = TOP_K, floor: float = SCORE_FLOOR) -> DataFrame:
    """The k most similar points with a score of at least `floor`; each task keeps k rows before they meet."""
    return scores(points, query, vector_col).filter(F.col("score") >= floor).orderBy(F.desc("score"), id_col).limit(k)


def top_k_each(points: DataFrame, queries: DataFrame, vector_col: str, id_col: str, k: int = TOP_K, floor: float = SCORE_FLOOR) -> DataFrame:
    """query_id, id, score, place: top k of all points for each row of queries (query_id, vector), a stated query set.

    Exact: blocks of points meet blocks of queries by an equi-join; a block keeps every point that ties with its k-th score,
    so ids order ties whatever the blocks.
    """
    scratch = Scratch(points.sparkSession, "vectors")
    return vector_index.search(vector_index.build_index(points, vector_col, id_col, scratch), queries, scratch, k=k, floor=floor)


def hashed_embedding(text: str, size: int = 384) -> list[float]:
    """A deterministic stand-in for a language model: signed hashed words, scaled to length 1."""
    out = np.zeros(size)
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        out[h % size] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(out)
    return (out / n if n else out).tolist()


def embed(chunks: DataFrame, text_col: str = "text", provider=hashed_embedding, size: int = 384) -> DataFrame:
    """chunks with vector, in batches; a provider that returns another length is an error, never a made-up vector."""
    ship(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            found = [provider(t) for t in b]
            if any(len(v) != size for v in found):
                raise ValueError(f"the embedding provider must return {size} numbers")
            yield pd.Series(found)

    return chunks.withColumn("vector", run(embedding_text(F.col(text_col))))
