"""Operator 1, substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm.common import map_arrow, table, written
from strataloom.llm.shingles import _BLANK

#: Bytes that the gear hash looks back on, and bytes on either side in which a cut is the greatest hash.
LOOK_BACK, REACH = 32, 20
#: Least bytes of neighbouring repeated chunks that are reported.
LEAST = 80
#: Words of a passage that is sure to be found; word ends among which an anchor is the greatest hash; whole words before
#: an anchor's own and behind it in its window. The hash looks back on 16 words at most, so of PASSAGE words the ends 16
#: to 35 are the same ANCHORS ends wherever they stand, and the window of any of them lies in the passage.
PASSAGE, ANCHORS = 51, 20
BEFORE, BEHIND = LOOK_BACK // 2 - 1, PASSAGE - LOOK_BACK // 2 - ANCHORS + 1

_PIECE = 4 << 20


def _gear() -> np.ndarray:
    """One random number for each byte value; blanks included, so cuts may fall anywhere."""
    return np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = _gear()


def _gear_hashes(buf: np.ndarray) -> np.ndarray:
    """The rolling hash h <- (h << 1) + gear[byte] of 32 bits, at every place at once.

    Shifted out of 32 bits, a byte is forgotten after 32 steps: the hash is the sum of the last 32 gears, each
    shifted by its age, which doubling the length of the sum five times gives.
    """
    h, n = _GEAR[buf], 1
    while n < LOOK_BACK:
        before = h[:-n] << np.uint32(n)
        h = h.copy()
        h[n:] += before
        n *= 2
    return h


def _greatest(h: np.ndarray, reach: int) -> np.ndarray:
    """Maximum of h over the window of 2 * reach + 1 places around each place, by doubling."""
    padded = np.concatenate((np.zeros(reach, h.dtype), h, np.zeros(reach, h.dtype)))
    size, best = 1, padded
    width = 2 * reach + 1
    while size * 2 <= width:
        best = np.maximum(best[:-size], best[size:])
        size *= 2
    return np.maximum(best[: len(h)], best[width - size : width - size + len(h)])


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text, its own end included.

    A chunk ends behind a byte whose hash is greater than that of all REACH bytes before it and not less than that
    of all REACH behind it. That depends on the LOOK_BACK + 2 * REACH bytes around alone: an insertion moves the
    cuts behind it along with the text. Long texts are hashed in overlapping pieces with the same result.
    """
    buf, ends = np.frombuffer(raw, np.uint8), []
    around = LOOK_BACK + REACH
    for a in range(0, len(buf), _PIECE):
        lo, hi = max(0, a - around - 1), min(len(buf), a + _PIECE + REACH + 1)
        h = _gear_hashes(buf[lo:hi])
        full = np.arange(lo, hi) >= LOOK_BACK - 1  # before that the hash still misses bytes
        h = np.where(full, h, 0)
        top = (h == _greatest(h, REACH)) & (h > 0)
        at = np.flatnonzero(top)
        if len(at) > 1:  # of equal greatest hashes within reach, the first
            at = at[np.concatenate(([True], np.diff(at) > REACH))]
        at = at + lo + 1
        ends.append(at[(at > a) & (at <= a + _PIECE) & (at < len(buf))])
    return np.concatenate([*ends, [len(buf)]]).astype(np.int64) if len(buf) else np.empty(0, np.int64)


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of whole words around the anchors of a text.

    An anchor is a word's end (the blank behind it) whose hash is the greatest of some ANCHORS neighbouring ends, the last of
    equal ones. A literal repeat of PASSAGE words has an equal window in both places, however long its words are.
    """
    buf = np.frombuffer(raw, np.uint8)
    blank = np.concatenate(([True], _BLANK[buf], [True]))
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    places = ends[ends < len(buf)]
    if len(places) < ANCHORS:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = []
    for a in range(0, len(buf), _PIECE):
        lo, at = max(0, a - LOOK_BACK + 1), places[np.searchsorted(places, a) : np.searchsorted(places, a + _PIECE)]
        hashes.append(_gear_hashes(buf[lo : a + _PIECE])[at - lo])
    ranked = np.concatenate(hashes).astype(np.uint64) << np.uint64(32) | np.arange(len(places), dtype=np.uint64)
    size, best = 1, ranked
    while size * 2 <= ANCHORS:
        best, size = np.maximum(best[:-size], best[size:]), size * 2
    n = len(places) - ANCHORS + 1
    best = np.maximum(best[:n], best[ANCHORS - size : ANCHORS - size + n])
    anchor = np.unique(best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor = anchor[(anchor >= BEFORE) & (anchor + BEHIND < len(starts))]
    return starts[anchor - BEFORE], ends[anchor + BEHIND]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for b in batches:
        rows, starts, sizes, wide, keys = [], [], [], [], []
        for i, t in enumerate(b.column(2).to_pylist()):
            raw = t.encode()
            ends = cuts(raw)
            left, right = windows(raw)
            begin, end = np.concatenate((ends[:0], [0] * (len(ends) > 0), ends[:-1], left)).astype(np.int64), np.concatenate((ends, right))
            rows.append(np.full(len(end), i))
            starts.append(begin)
            sizes.append(end - begin)
            wide.append(np.arange(len(end)) >= len(ends))
            keys.append(b"".join([digest(raw[x:y]) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]))
        take = pa.array(np.concatenate(rows))
        high, low = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2).T
        cols = [pa.array(np.concatenate(x)) for x in (starts, sizes, wide)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), cols[0].cast(pa.int32()), cols[1].cast(pa.int32()), cols[2], pa.array(np.ascontiguousarray(high)), pa.array(np.ascontiguousarray(low))], ["doc_id", "row", "start", "size", "wide", "high", "low"])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of id and text), start and size in bytes, wide, high and low (128-bit digest) of every chunk and window.

    wide tells the windows, which overlap, from the chunks, which don't.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text).alias("row"), text.alias("text"))
    return map_arrow(rows, _chunks, f"doc_id {docs.schema[id_col].dataType.simpleString()}, row long, start int, size int, wide boolean, high long, low long")


def spans(pieces: list[tuple], least: int) -> list[tuple]:
    """(start, length, pieces that lie in it, first) of the spans of a document's repeated pieces (start, end, wide, first).

    Pieces that touch are a run; it counts from `least` bytes on, or with a window in it. A place has the smallest
    first of the pieces over it, and a run is parted where that changes.
    """
    rank = {f: i for i, f in enumerate(sorted({p[3] for p in pieces} - {None}) + [None])}
    names = list(rank)
    pieces = sorted(pieces, key=lambda p: p[:3])
    begins, ends = np.array([p[0] for p in pieces]), np.sort([p[1] for p in pieces])
    out, i = [], 0
    while i < len(pieces):
        begin, end, wide, j = pieces[i][0], pieces[i][1], False, i
        while j < len(pieces) and pieces[j][0] <= end:
            end, wide, j = max(end, pieces[j][1]), wide or pieces[j][2], j + 1
        if wide or end - begin >= least:
            over, k, parts = [], i, []
            edges = sorted({e for p in pieces[i:j] for e in p[:2]})
            for x, y in zip(edges, edges[1:], strict=False):
                while k < j and pieces[k][0] <= x:
                    heapq.heappush(over, (rank[pieces[k][3]], pieces[k][1]))
                    k += 1
                while over[0][1] <= x:
                    heapq.heappop(over)
                if parts and parts[-1][2] == over[0][0]:
                    parts[-1][1] = y
                else:
                    parts.append([x, y, over[0][0]])
            for x, y, r in parts:
                n = np.searchsorted(begins, y) - np.searchsorted(ends, x, "right")
                out.append((x, y - x, int(n), names[r]))
        i = j
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Spans that repeat across documents: doc_id, start, length (bytes), n_chunks, first_doc_id, kept.

    A span is a run of neighbouring chunks and windows of one document that also occur in another one, of `least`
    bytes or more together or with a window, parted where first_doc_id changes: the smallest id that holds a chunk or
    window over the place. n_chunks counts those that reach into the span. kept tells that first_doc_id is the document
    itself, so dropping the spans that aren't kept leaves one copy of each passage. Every literal repeat of PASSAGE
    words is found, if not to its very ends. Documents without such a span don't come out. Null and empty texts have
    no chunks; rows that repeat in id and text are one document, and equal texts under different ids repeat each
    other; other columns are ignored. A text without a cut (one repeated character, say) is one chunk.

    Digests are counted with partial aggregates; the join back is a plain equi-join, which is split where a digest
    is hot. Only what is repeated is gathered, by document.
    """
    all_ = chunks(docs, id_col, text_col)
    seen = all_.groupBy("high", "low").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("doc_id").alias("first_doc_id"))
    repeated, _ = written(seen.filter("a <> b").drop("a", "b"), "chunk-digests")
    found = all_.hint("merge").join(repeated.hint("merge"), ["high", "low"])
    piece = F.struct("start", (F.col("start") + F.col("size")).alias("end"), "wide", "first_doc_id")
    found = found.groupBy("doc_id", "row").agg(F.collect_set(piece).alias("pieces")).select("doc_id", "pieces")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, values = [], []
            for i, pieces in enumerate(b.column(1).to_pylist()):
                own = spans([(p["start"], p["end"], p["wide"], p["first_doc_id"]) for p in pieces], least)
                rows += [i] * len(own)
                values += own
            start, length, n, first = zip(*values, strict=True) if values else ((), (), (), ())
            cols = [pa.array(x, pa.int64()) for x in (start, length, n)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols, pa.array(first, b.column(0).type)], ["doc_id", "start", "length", "n_chunks", "first_doc_id"])

    out = map_arrow(found, run, f"doc_id {kind}, start long, length long, n_chunks long, first_doc_id {kind}")
    return out.withColumn("kept", F.col("first_doc_id").eqNullSafe(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents", deal=True))
