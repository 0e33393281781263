"""Operator 12, suffix-array dedup: every byte covered by a string of `least` bytes that also starts elsewhere goes.

Prefix doubling over runs of positions. A window is the string of `least` bytes at a position. Neighbouring windows that
share their least gram (by hash, the leftmost of equal ones) are a run: which gram that is depends on the window's bytes alone, so equal
windows lie equally far before equal grams. All windows of a run share its core, and lie in its hull. Each round
sorts the runs by the rank of their cores. A run whose core is unique has only unique windows and leaves. Where all
hulls of a rank are equal, its windows repeat: past the threshold. The others are split into shorter runs, whose
cores are longer: pairs of ranks of `half` bytes at growing offsets (0, 53, 81 and 84 for 200 bytes), until a run is one
window and its pair is the window itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, map_arrow, maybe, maybe_in, quoted, spread_join, table

LEAST = 200
#: Bytes of the gram of the first round; windows in a run of the further rounds. The last is always a single window.
GRAM, WIDTHS = 64, (32, 4, 1)

_ODD = 0x9E3779B97F4A7C15
_PIECE_BITS = 18
_PIECE = 1 << (_PIECE_BITS - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers(_ODD, 2 * _PIECE), _powers(pow(_ODD, -1, 1 << 64), 2 * _PIECE)


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place (a rolling hash by prefix sums, then mixed)."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf + np.uint64(1)) * _POWERS[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _INVERSE[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(raw: bytes, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the first window, places of the gram and hashes of the gram of a text's runs.

    A run ends before the next one starts. Long texts are read in overlapping pieces with the same result.
    """
    buf = np.frombuffer(raw, np.uint8)
    last, w, mask = len(buf) - least, least - k + 1, np.uint64((1 << _PIECE_BITS) - 1)
    starts, places, hashes = [], [], []
    for a in range(0, last + 1, _PIECE):
        n = min(_PIECE, last + 1 - a)
        h = grams(buf[a : a + n + least - 1], k)
        best, size = h & ~mask | np.arange(len(h), dtype=np.uint64), 1
        while size * 2 <= w:
            best, size = np.minimum(best[:-size], best[size:]), size * 2
        at = (np.minimum(best[:n], best[w - size : w - size + n]) & mask).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        starts.append(new + a)
        places.append(at[new] + a)
        hashes.append(h[at[new]])
    if not starts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    starts, places, hashes = map(np.concatenate, (starts, places, hashes))
    new = np.concatenate(([True], places[1:] != places[:-1]))
    return starts[new], places[new], hashes[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _all_runs(least: int, k: int):
    """Batches of (a, b, text) to runs: a, b, start, span, width, lead, gram, hull, n.

    lead: bytes from the first window to the gram. Equal runs that follow one another (a text with a period) are one row: n of them, which
    span n times their width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh3_64_intdigest
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                raw = t.encode()
                start, place, gram = runs(raw, least, k)
                if not len(start):
                    continue
                width = np.diff(np.append(start, len(raw) - least + 1))
                lead, ends = place - start, start + width - 1 + least
                hull = np.fromiter((name(raw[x:y], d) for x, y, d in zip(start.tolist(), ends.tolist(), lead.tolist(), strict=True)), np.uint64, len(start))
                same = np.concatenate(([False], (gram[1:] == gram[:-1]) & (hull[1:] == hull[:-1]) & (width[1:] == width[:-1])))
                first = np.flatnonzero(~same)
                n = np.diff(np.append(first, len(start)))
                start, width, lead, gram, hull = (x[first] for x in (start, width, lead, gram, hull))
                rows.append(np.full(len(first), i))
                out.append((start, width * n, width, lead, gram, hull, n))
            start, span, width, lead, gram, hull, n = map(np.concatenate, zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 7
            take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            small = [pa.array(x.astype(np.int32)) for x in (start, span, width, lead)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *small, _signed(gram), _signed(hull), pa.array(n.astype(np.int32))], ["a", "b", "start", "span", "width", "lead", "gram", "hull", "n"])

    return run


def _cut_pieces(least: int):
    """Batches of (a, b, text, places) to the hulls of the places, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (t, places) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                raw = t.encode()
                for p in places:
                    rows.append(i)
                    out.append((p["start"], p["width"], p["lead"], p["n"], raw[p["start"] : p["start"] + p["width"] - 1 + least]))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            take = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["a", "b", "start", "width", "lead", "n", "hull"])

    return run


def _split(least: int, half: int, width: int):
    """Batches of (piece, width, lead, n, hull, open) to runs of `width` windows: piece, first, last, n, rank, next, whole.

    A window is numbered by its distance from the gram, and a run begins at a multiple of the width: equal windows fall into runs that
    are counted alike. rank and next are the ranks of the core's first and last `half` bytes, whole is that of the
    hull with its first and last window. open: number ranges to split, null for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh3_64_intdigest
        for b in batches:
            piece, w, lead, n, hulls, open_ = (b.column(i).to_pylist() for i in range(6))
            out = []
            for q, w_, m, n_, raw, ranges in zip(piece, w, lead, n, hulls, open_, strict=True):
                for lo, hi in [(m - w_ + 1, m)] if ranges is None else [(r["first"], r["last"]) for r in ranges]:
                    for i in range(lo // width, hi // width + 1):
                        x, y = max(lo, i * width), min(hi, i * width + width - 1)
                        left, right = m - i * width, m - i * width - width + 1 + least
                        core, last = name(raw[left : left + half], i & 0xFFFFFFFF), name(raw[right - half : right])
                        whole = core ^ last if width == 1 else name(raw[m - y : m - x + least], (x - i * width) * width + y - i * width)
                        out.append((q, x, y, n_, core, last, whole))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            ints = [pa.array(c, k) for c, k in zip(cols[:4], (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*ints, *(_signed(np.array(c, np.uint64)) for c in cols[4:])], ["piece", "first", "last", "n", "rank", "next", "whole"])

    return run


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc, text, ranges of bytes) to doc, spans (merged ranges) and the bytes that are left."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for b in batches:
        spans, kept = [], []
        for t, at in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            raw = t.encode()
            ranges = at.values
            start, end = (ranges.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.ones(len(start), bool)
            new[1:] = start[1:] > end[:-1]
            start, end = start[new], end[np.append(new[1:], True)[: len(end)]]
            spans.append([{"start": x, "length": y - x} for x, y in zip(start.tolist(), end.tolist(), strict=True)])
            kept.append(b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True)))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3, b.num_columns)), pa.array(spans, kind), pa.array(kept, pa.binary())], [*b.schema.names[3:], "spans", "kept"])


def repeated_ranges(docs: DataFrame, scratch: Scratch, least: int = LEAST, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Ranges of bytes (a, b, start, end) of docs (a, b, text) that repeated windows cover; a and b name a text's rows."""
    if not 0 < gram <= least or gram > _PIECE or widths[-1] != 1 or (least + widths[0]) // 2 > least - widths[0] + 1:
        raise ValueError("gram must be within least, and widths a third of it at most, ending in 1")
    half = (least + widths[0]) // 2
    all_ = scratch.write(map_arrow(docs.select("a", "b", "text"), _all_runs(least, gram), "a long, b int, start int, span int, width int, lead int, gram long, hull long, n int"), "runs")

    # first round: ranks of the grams; of runs equal as a whole, one stands for all with their number
    shared = scratch.write(all_.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"), "grams")
    place = ("a", "b", "start", "width", "lead")
    classes = scratch.write(maybe_in(all_, shared.select("gram"), "gram").groupBy("gram", "hull").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in place)), "classes")
    copies = scratch.write(classes.filter("n > 1").select("gram", "hull", F.col("n").alias("members")), "copies")
    settled = spread_join(maybe_in(all_, copies.select("hull"), "hull"), copies, ["gram", "hull"], "members", "start")
    ranges = [settled.select("a", "b", "start", (F.col("start") + F.col("span") - 1 + least).alias("end"))]

    # what shares its gram but not its hull: one place of each class, cut out of the text
    mixed = scratch.write(classes.groupBy("gram").agg(F.count("*").alias("members"), F.min("n").alias("fewest")).filter("members > 1 AND fewest = 1"), "mixed")
    chosen = spread_join(maybe_in(classes, mixed.select("gram"), "gram"), mixed, ["gram"], "members", "hull")
    of_text = scratch.write(chosen.groupBy("a", "b").agg(F.collect_list(F.struct("start", "width", "lead", F.least("n", F.lit(2)).cast("int").alias("n"))).alias("places")), "places")
    texts = maybe_in(docs.select("a", "b", "text"), of_text.select("a"), "a").join(of_text, ["a", "b"])
    cut = map_arrow(texts.select("a", "b", "text", "places"), _cut_pieces(least), "a long, b int, start int, width int, lead int, n int, hull binary")
    pieces = scratch.write(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")

    # further rounds: shorter runs, longer cores
    whole = "array<struct<first:int,last:int>>"
    todo = pieces.withColumn("open", F.lit(None).cast(whole))
    for width in widths:
        rows = scratch.write(map_arrow(todo.select("piece", "width", "lead", "n", "hull", "open"), _split(least, half, width), "piece long, first int, last int, n int, rank long, next long, whole long"), f"runs-{width}")
        ranks = rows.groupBy("rank", "next").agg(F.sum("n").alias("n"), F.count("*").alias("members"), F.min("whole").alias("a"), F.max("whole").alias("b"))
        ranks = scratch.write(ranks.filter("n > 1").select("rank", "next", "members", (F.col("a") != F.col("b")).alias("open")), f"ranks-{width}")
        found = scratch.write(spread_join(maybe_in(rows, ranks.select("rank"), "rank"), ranks, ["rank", "next"], "members", "piece").select("piece", "first", "last", "open"), f"found-{width}")
        done = found.filter("NOT open").groupBy("piece").agg(F.collect_list(F.struct("first", "last")).alias("open"))
        at = maybe_in(pieces.select("piece", "a", "b", "start", "lead"), found.filter("NOT open").select("piece").distinct(), "piece").join(done, "piece")
        at = at.select("a", "b", (F.col("start") + F.col("lead")).alias("gram"), F.inline("open"))
        ranges.append(at.select("a", "b", (F.col("gram") - F.col("last")).alias("start"), (F.col("gram") - F.col("first") + least).alias("end")))
        if width > 1:
            open_ = scratch.write(found.filter("open").groupBy("piece").agg(F.collect_list(F.struct("first", "last")).alias("open")), f"open-{width}")
            todo = maybe_in(pieces, open_.select("piece"), "piece").join(open_, "piece")
    out = ranges[0]
    for r in ranges[1:]:
        out = out.unionByName(r)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """doc_id, n_bytes, spans (start and length in bytes of what was removed, in order) and kept (the bytes left) of each row.

    A byte goes if a string of `least` bytes over it also starts anywhere else, in the same text (overlapping or not)
    or in another row's; what is judged is the input. Null texts are empty; null ids stay null; repeated rows are
    documents of their own, so they take each other out; other columns are ignored. Texts shorter than `least` stay
    as they are. kept needn't be UTF-8: a cut may fall into a character.

    Only a run's hash, length and place are shuffled for all texts; bytes are, for runs that share a gram but
    aren't copies. Copies count with map-side sums and stand as one row in later rounds, rows of a hot rank are dealt.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(quoted(text_col), F.lit(""))
    key = quoted(id_col)
    rows = docs.select(key.alias("doc_id"), text.alias("text")).withColumns({"a": F.xxhash64("doc_id", "text"), "b": F.hash("text", "doc_id")})
    found = scratch.write(repeated_ranges(rows, scratch, least, gram, widths).groupBy("a", "b").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    held = maybe(rows, found.select("a"), "a", "held")
    some = map_arrow(held.filter("held").drop("held").hint("merge").join(found.hint("merge"), ["a", "b"], "left").select("a", "text", F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")).alias("ranges"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes")), _take_out, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
    none = held.filter("NOT held").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return some.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents", deal=True))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
