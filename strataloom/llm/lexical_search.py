"""Operator 13, ranked lexical search: document-at-a-time heap merge over compressed postings of document shards.

An index is a table of shards. A shard holds some neighbouring rows of the documents in the order of their ids: one row
with their ids and lengths, and one row a term with its postings (gaps of places and counts as variable-length
integers). A search reads the postings of the terms that it asks for; a shard's postings are merged by a heap, place by place, so
that each document is scored once for all items, and each item keeps a bounded heap of its best documents.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, map_arrow, maybe_in, quoted, table
from strataloom.plans.session import ship

#: Characters that part terms, as ranges of ASCII; all others, digits and letters, make terms.
_PARTS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))

#: Terms with repeats after which a shard is full, items of a search that are answered at once, best documents of an item.
SHARD, BLOCK, BEST = 2_000_000, 1024, 10
#: Postings that are scored at once, and cells of the table of scores.
_CHUNK, _CELLS = 1 << 16, 1 << 20


def terms(text: Column) -> Column:
    """The terms of a text, with repeats; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"[^{_PARTS}]+"), 0), F.array().cast("array<string>"))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of 7 bits, the lowest first, of numbers that aren't negative, and the number of bytes of each."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(int(sizes.max(initial=0))):
        more = sizes > i
        out[(ends - sizes + i)[more]] = ((values[more] >> (7 * i)) & 127) | ((sizes[more] > i + 1) << 7)
    return out, sizes


def unpack(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _binary(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _shards(kind: pa.DataType, full: int):
    """Batches of (doc_id, text) to the rows of shards: shard, term, df, postings, ids, length."""

    def shard(ids: list, each: list[np.ndarray], words: list[bytes], number: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        sizes = np.array([len(each[i]) for i in order], np.int64)
        lengths, _ = pack(sizes)
        all_ = np.concatenate([each[i] for i in order]).astype(np.int64)
        key, count = np.unique(all_ << 32 | np.repeat(np.arange(len(order)), sizes), return_counts=True)
        term, place = key >> 32, key & 0xFFFFFFFF
        first = np.flatnonzero(np.append(np.ones(min(len(term), 1), bool), term[1:] != term[:-1]))
        gap = np.diff(place, prepend=0)
        gap[first] = place[first]
        raw, size = pack(np.column_stack((gap, count)).reshape(-1))
        df = np.diff(np.append(first, len(term)))
        postings = _binary(raw, np.add.reduceat(size, 2 * first) if len(first) else size)
        names = ["shard", "term", "df", "postings", "ids", "length"]
        own = [ids[i] for i in order]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([np.count_nonzero(sizes)], pa.int64()), pa.array([lengths.tobytes()], pa.binary()), pa.array([own], pa.list_(kind)), pa.array([int(sizes.sum())], pa.int64())], names)
        found = pa.array([words[t] for t in term[first].tolist()], pa.binary()).cast(pa.string())
        for a in range(0, len(first), 1 << 16):
            n = min(1 << 16, len(first) - a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), found[a : a + n], pa.array(df[a : a + n]), postings[a : a + n], pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, each, held = TaskContext.get().partitionId() << 32, [], [], 0
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = (t or "").encode().translate(_TABLE).split()
                ids.append(d)
                each.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                held += len(found) + 1
                if held >= full:
                    yield from shard(ids, each, list(known), number)
                    known.clear()
                    number, ids, each, held = number + 1, [], [], 0
        if ids:
            yield from shard(ids, each, list(known), number)

    return run


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: int = SHARD) -> DataFrame:
    """Write an index of docs to path and read it back: shard, term, df, postings, ids, length.

    The row without a term has a shard's ids in their order (nulls last), its documents with terms (df), its terms with repeats (length)
    and the terms of each document (postings). Null texts have no term; repeated rows are documents of their own.
    A task fills one shard after the other, each up to `full` terms and one document, so memory is bounded; a frequent
    term has a row a shard. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind.simpleString())
    if arrow is None:
        raise ValueError("ids must be of type long, int or string")
    rows = map_arrow(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), _shards(arrow, full), f"shard long, term string, df long, postings binary, ids array<{kind.simpleString()}>, length long")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _best(places: np.ndarray, scores: np.ndarray, offsets: np.ndarray, uses: tuple[np.ndarray, np.ndarray, np.ndarray], items: int, best: int) -> list[list[tuple[int, int]]]:
    """The best (score, -place) of each item, in no order.

    Postings stand term by term: the places and scores of a term begin at its offset. uses: where a term's uses begin,
    their items and factors. A heap merges the terms' lists by place; postings of a place stay together.
    """
    first, of, factor = uses
    term = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = (places << 32 | np.arange(len(places))).tolist()
    merged = heapq.merge(*(iter(keys[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)))
    heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
    least = np.zeros(items, np.int64)
    rest = np.empty(0, np.int64)
    at_once = max(1, _CELLS // items)
    while True:
        new = np.fromiter(islice(merged, _CHUNK), np.int64)
        key = np.concatenate((rest, new))
        if not len(key):
            return heaps
        place = key >> 32
        whole = np.searchsorted(place, place[-1]) if len(new) else len(key)
        rest, key, place = key[whole:], key[:whole], place[:whole]
        seen, row = np.unique(place, return_inverse=True)
        for a in range(0, len(seen), at_once):
            lo, hi = np.searchsorted(row, (a, a + at_once))
            post = key[lo:hi] & 0xFFFFFFFF
            t = term[post]
            n = first[t + 1] - first[t]
            use = np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows = min(at_once, len(seen) - a)
            total = np.zeros(rows * items, np.int64)
            np.add.at(total, np.repeat(row[lo:hi] - a, n) * items + of[use], np.repeat(scores[post], n) * factor[use])
            total = total.reshape(rows, items)
            for r, i in zip(*(x.tolist() for x in np.nonzero(total > least)), strict=True):
                entry, heap = (int(total[r, i]), -int(seen[a + r])), heaps[i]
                if len(heap) < best:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == best:
                    least[i] = heap[0][0]


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", best: int = BEST, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of each item with a score above 0.

    Scores are those of `query`'s contract; equal ones rank by id, null ids last. An item asks for its terms with
    repeats; null and empty items find nothing; items that repeat in id and text are answered once. Items are taken in
    blocks by a hash of their row, so the number of items that a task holds doesn't grow; a term carries
    the items of a block that ask for it. Each shard and block gives `best` rows an item, which meet in a ranking whose
    map side keeps `best` rows an item and task. Documents that repeat under one id may both stand in a ranking.
    """
    spark = index.sparkSession
    ship(spark)
    scratch = Scratch(spark, "search")
    asked = scratch.write(items.select(quoted(id_col).alias("item_id"), quoted(text_col).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-asked.count() // block))
    uses = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "block", "term").agg(F.count("*").alias("n"))
    uses = scratch.write(uses.withColumn("hash", F.xxhash64("term")), "uses")
    heads = index.filter("term IS NULL")
    n_docs, n_terms = (x or 0 for x in heads.agg(F.sum("df"), F.sum("length")).first())
    lists = maybe_in(index.filter("term IS NOT NULL").select("shard", "term", "df", "postings", F.xxhash64("term").alias("hash")), uses.select("hash").distinct(), "hash").drop("hash")
    lists = scratch.write(lists.join(uses.select("term").distinct(), "term", "left_semi"), "lists")
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    asks = scratch.write(uses.groupBy("block", "term").agg(F.collect_list(F.struct("item", "n")).alias("uses")).join(weights, "term"), "asks")
    rows = lists.select("shard", "term", "postings").join(asks, "term").select("shard", "block", "postings", "weight", "uses", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"))
    every = heads.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "postings", F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<struct<item:bigint,n:bigint>>").alias("uses"), "ids")

    def run(group: pa.Table) -> pa.Table:
        weight = group.column("weight").to_pylist()
        raw = group.column("postings").to_pylist()
        head = weight.index(None)
        lengths, ids = unpack(np.frombuffer(raw[head], np.uint8)), group.column("ids")[head].as_py()
        own = [i for i in range(len(raw)) if i != head]
        empty = pa.table({"item": pa.array([], pa.int64()), "doc_id": pa.array([], group.schema.field("ids").type.value_type), "score": pa.array([], pa.int64())})
        if not own:
            return empty
        pairs = [unpack(np.frombuffer(raw[i], np.uint8)).reshape(-1, 2) for i in own]
        offsets = np.cumsum([0] + [len(p) for p in pairs])
        places, count = np.concatenate([np.cumsum(p[:, 0]) for p in pairs]), np.concatenate([p[:, 1] for p in pairs])
        m = 25 + (75 * lengths * n_docs) // max(n_terms, 1)
        scores = np.repeat([weight[i] for i in own], np.diff(offsets)) * ((1_000_000_000 * count) // (1000 * count + 8 * m[places]))
        used = [u for i in own for u in group.column("uses")[i].as_py()]
        first = np.cumsum([0] + [len(group.column("uses")[i]) for i in own])
        names, of = np.unique([u["item"] for u in used], return_inverse=True)
        heaps = _best(places, scores, offsets, (first, of, np.array([u["n"] for u in used], np.int64)), len(names), best)
        out = [(int(name), ids[-p], s) for name, heap in zip(names, heaps, strict=True) for s, p in heap]
        cols = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, empty.schema, strict=True)], schema=empty.schema)

    kind = index.schema["ids"].dataType.elementType.simpleString()
    found = rows.unionByName(every).groupBy("shard", "block").applyInArrow(run, f"item long, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(asked, "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lexical")
    index = build_index(table(spark, sf_dir, "documents", deal=True), f"{scratch.path}/index")
    return search(index, table(spark, sf_dir, "benchmark"))


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"

ORACLE = f"""
WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (doc_id), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS "rank", doc_id, score FROM ranked WHERE place <= 10
"""
