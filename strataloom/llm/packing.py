"""Operator 7, packing along a space-filling curve: neighbouring documents share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.bpe import Vocabulary, vocabulary
from strataloom.llm.common import map_arrow, table, written
from strataloom.llm.hilbert import hilbert_key

#: Ids of a full sequence, and the id that ends each document.
LENGTH, END = 2048, 1
#: Buckets of the hashed document vectors, dimensions they are projected to, bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 4, 12
#: Pieces and words, each, whose ids a worker remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED = 1_000_000
#: Bytes of text that are cut at once, if more than one text; ids whose buckets are counted at once.
PART, BLOCK = 1 << 23, 1 << 20
#: Characters that are a word of their own behind a word.
_MARKS = frozenset(".,;:!?)")


class _Words(dict):
    """Ids of words, filled on demand."""

    def __init__(self, vocabulary_: Vocabulary, coded: list[bytes]):
        self.vocabulary, self.coded = vocabulary_, coded

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = b"".join([self.coded[i] for i in self.vocabulary.ids(word)])
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder(dict):
    """Ids of whole texts as the tokenizers library gives them, from remembered ids of pieces and of their words.

    Pieces are what ASCII white space parts; the file's normaliser and pre-tokenizer don't look across it. Arrow cuts
    the texts of a batch and numbers the distinct pieces, and only these are looked up. A new piece is cut into words by
    the file's pre-tokenizer; the library merges each word once, when it is first met. Should a special string hold
    white space, a text is one piece.
    """

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.kind = np.dtype("<u2" if self.vocabulary.size <= 1 << 16 else "<u4")
        coded = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.vocabulary.size)]
        self.words = _Words(self.vocabulary, coded)
        self.special = {s: coded[i] for s, i in self.vocabulary.special_ids.items()}
        self.end = coded[END]
        self.apart = not any(s.encode().split() != [s.encode()] for s in self.special)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        mark = piece[-1:] if piece[-1:] in _MARKS else ""
        plain = piece.removesuffix(mark)
        if plain.isascii() and plain.isalpha():  # a word of letters, with at most a mark behind it
            ids = self.words[plain.lower()] + (self.words[mark] if mark else b"")
        else:
            ids = b"".join([self.special.get(special, b"") + b"".join(map(self.words.__getitem__, words)) for special, words in self.vocabulary.segments(piece)])
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Ids of each text and END, as bytes; null is an empty text."""
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(texts) if self.apart else pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        pieces, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = pa.array([*map(self.__getitem__, distinct), self.end], pa.binary())
        all_ = known.take(pa.array(np.insert(pieces.indices.to_numpy(), ends[1:], len(distinct))))
        # all_ has the ids in order, so a text is a stretch of its bytes: its pieces and one END
        places = np.frombuffer(all_.buffers()[1], np.int32)[ends + np.arange(len(ends))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), all_.buffers()[2]])

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def _projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id its bucket of the hashed vector (plus BUCKETS, if it counts down), and the buckets' directions."""
    rng = np.random.default_rng(20)
    directions = rng.normal(size=(BUCKETS, DIMENSIONS)).astype(np.float32).astype(np.float64)
    h = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    up = (h >> np.uint64(12)) & np.uint64(1)
    return (h % np.uint64(BUCKETS) + np.where(up, 0, BUCKETS).astype(np.uint64)).astype(np.int64), directions


def curve_keys(ids: pa.Array | list[bytes], kind: np.dtype, size: int) -> np.ndarray:
    """Hilbert keys of the documents' hashed vectors, projected and brought to unit length."""
    bucket, directions = _projection(size)
    ids = pa.array(ids, pa.binary())
    places = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] // kind.itemsize
    flat, counts = np.frombuffer(ids.buffers()[2], kind), np.zeros((len(ids), 2 * BUCKETS), np.int64)
    for at in range(places[0], places[-1], BLOCK):
        inside = np.clip(places, at, at + BLOCK)
        row = np.repeat(np.arange(0, counts.size, 2 * BUCKETS), np.diff(inside))
        counts += np.bincount(row + bucket[flat[inside[0] : inside[-1]]], minlength=counts.size).reshape(counts.shape)
    total = (counts[:, :BUCKETS] - counts[:, BUCKETS:]) @ directions
    unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    grid = np.minimum(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_key(grid, BITS)


def _light(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of one row or at most PART bytes of text."""
    if batch.num_rows > 1 and batch.column(1).nbytes > PART:
        yield from _light(batch.slice(0, batch.num_rows // 2))
        yield from _light(batch.slice(batch.num_rows // 2))
    else:
        yield batch


def _tail(length: int) -> Iterator[int]:
    """Powers of two that add up to length, the largest first: sequences of these lengths need no padding."""
    while length:
        part = 1 << (length.bit_length() - 1)
        yield part
        length -= part


def pack_stream(docs: Iterator[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """(doc, start, ids of the piece, ids of the document, sequence, offset) for (doc, ids) in order.

    The ids run on from document to document; every `length` of them are a sequence, and what is left at the end is
    cut into sequences of powers of two.
    """
    waiting, filled, sequence = [], 0, 0
    for doc, ids in docs:
        at = 0
        while at < len(ids):
            n = min(length - filled, len(ids) - at)
            waiting.append((doc, at, ids[at : at + n], len(ids), filled))
            at, filled = at + n, filled + n
            if filled == length:
                for d, start, part, size, offset in waiting:
                    yield d, start, part, size, sequence, offset
                waiting, filled, sequence = [], 0, sequence + 1
    room = _tail(filled)
    left, offset = next(room, 0), 0
    for d, start, part, size, _ in waiting:
        at = 0
        while at < len(part):
            n = min(left - offset, len(part) - at)
            yield d, start + at, part[at : at + n], size, sequence, offset
            at, offset = at + n, offset + n
            if offset == left:
                left, offset, sequence = next(room, 0), 0, sequence + 1


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packing(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by END; null and empty texts are END alone. Documents are range-sorted by the
    Hilbert key of their hashed vectors, equal keys (copies) by a hash of the row, so that no group is too large for
    a range; each range is packed as one stream without padding: its last sequences have lengths of powers of two.
    sequence_id is the range's number times 2 ** 32 plus a count. Null ids stay; repeated rows are packed as often
    as they occur; other columns are ignored; an empty table gives no pieces.

    Texts are encoded once and written to the shared folder; sampling the ranges reads keys from there. A range is
    streamed: a worker holds a batch of documents and one sequence.
    """
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for part in _light(b):
                ids = e.encode_all(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(ids, e.kind, e.vocabulary.size)), ids], ["doc_id", "curve", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_ = encoder(path).kind
        first = TaskContext.get().partitionId() << 32
        types: list[pa.DataType] = []

        def stream() -> Iterator[tuple]:
            for b in batches:
                types[:] = [b.schema.field(0).type]
                for d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield d, np.frombuffer(ids, kind_)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], types[0]), *(pa.array(c, pa.int64()) for c in cols[1:])], _PIECE)

        rows = []
        for d, start, part, size, sequence, offset in pack_stream(stream(), length):
            rows.append((d, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), size, first + sequence, offset))
            if len(rows) == 8192:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    name = kind.simpleString()
    rows = map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), encode, f"doc_id {name}, curve long, ids binary")
    rows, _ = written(rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "pack-ids")
    ordered = rows.repartitionByRange("curve", "tie").sortWithinPartitions("curve", "tie")
    return map_arrow(ordered.select("doc_id", "ids"), pack, f"doc_id {name}, " + ", ".join(f"{c} long" for c in _PIECE[1:]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents", deal=True), public_tokenizers.path("word_bpe_49k.json"))
