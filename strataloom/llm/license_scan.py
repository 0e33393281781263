"""Operator 3, license scans: ordered signature rules behind a keyword gate, overlaps resolved by priority."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import map_arrow, table
from strataloom.llm.license_rules import RULES, Rule

#: Phrases and labels that the contract fixes.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_WORD_BYTE = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
_FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if _WORD_BYTE[b] else 0x20 for b in range(256))
_BY_GATE: dict[str, list[tuple[int, Rule]]] = defaultdict(list)
for _i, _rule in enumerate(RULES):
    _BY_GATE[_rule.gate].append((_i, _rule))
#: The rarest-looking word of each gate; a text without any of them can't match a rule or a base phrase.
_STEMS = tuple(sorted({max(g.split(), key=len).encode() for g in _BY_GATE} | {b"cc", b"reserved", b"public"}))
#: A few of the stems hold others; only those that hold none are looked for.
_STEMS = tuple(s for s in _STEMS if not any(o != s and o in s for o in _STEMS))


class _Cover:
    """Intervals of which none lies in another one, by start; so their ends ascend too."""

    def __init__(self):
        self.start, self.end = np.empty(0, np.int64), np.empty(0, np.int64)

    def holds(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each interval lies inside one of these: the last that begins no later reaches furthest."""
        at = np.searchsorted(self.start, start, "right") - 1
        return (at >= 0) & (self.end[at] >= end) if len(self.end) else np.zeros(len(start), bool)

    def add(self, start: np.ndarray, end: np.ndarray) -> None:
        start, end = np.concatenate((self.start, start)), np.concatenate((self.end, end))
        order = np.lexsort((-end, start))
        start, end = start[order], end[order]
        outer = np.concatenate(([True], end[1:] > np.maximum.accumulate(end)[:-1]))
        self.start, self.end = start[outer], end[outer]


def detections(words: str) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) over folded words joined by single blanks.

    Rules whose gate occurs are matched in order of priority, then of the table. A match goes if it lies inside one
    that stands already: the interval of a more important rule covers it. Matches of one rule don't overlap, so each
    rule is resolved at once and n matches take n log n for each rule.
    """
    live = sorted(((-rule.priority, i, rule) for gate, rules in _BY_GATE.items() if gate in words for i, rule in rules), key=lambda x: x[:2])
    cover, kept = _Cover(), []
    for _, _, rule in live:
        places = np.array([m.span() for m in rule.pattern.finditer(words)], np.int64).reshape(-1, 2)
        places = places[~cover.holds(places[:, 0], places[:, 1])]
        if len(places):
            cover.add(places[:, 0], places[:, 1])
            kept += [(a, b, rule) for a, b in places.tolist()]
    return sorted(kept, key=lambda x: (x[0], x[1]))


def scan_text(text: str | None) -> dict:
    """Counts, base places, labels, spans (word numbers, end exclusive) and score of one text."""
    folded = (text or "").encode().translate(_FOLD)
    out = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    if not any(s in folded for s in _STEMS):
        blank = np.frombuffer(b" " + folded, np.uint8) == 0x20
        return out | {"n_words": int(np.count_nonzero(blank[:-1] & ~blank[1:]))}
    parts = folded.split()
    words = b" ".join(parts).decode()
    out["n_words"] = len(parts)
    # where the blanks are, in code points: the number of a word is the number of blanks before it
    blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 0x20)
    number = lambda at: np.searchsorted(blanks, at)
    framed, places, base = f" {words} ", [], set()
    for phrase, label in BASE:
        at = framed.find(f" {phrase} ")
        while at >= 0:
            places.append(at)
            base.add(label)
            at = framed.find(f" {phrase} ", at + 1)
    kept = detections(words)
    rest = 1.0
    for _, _, rule in kept:
        rest *= 1 - rule.priority / 101
    spans = list(zip(number([a for a, _, _ in kept]).tolist(), (number([b for _, b, _ in kept]) + 1).tolist(), [r.label for _, _, r in kept], strict=True))
    if places:
        out |= {"n_base": len(places), "first_word": int(number(min(places))), "last_word": int(number(max(places)))}
    return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {r.label for _, _, r in kept})), "score": 1 - rest, "spans": spans}


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts, base phrases, labels, score and spans for each row of docs, in one pass without a shuffle.

    Null and empty texts have no words, labels '' and score 0; a null id stays null; repeated rows come out as often
    as they went in; other columns are ignored. Texts are read whole whatever their length. Of detections that share
    an interval the higher priority stays, then the earlier rule. score is 1 minus the product of the kept rules'
    doubts, (1 - priority / 101).
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t) for t in b.column(1).to_pylist()]
            spans = pa.array([[dict(zip(("start", "end", "label"), s, strict=True)) for s in r["spans"]] for r in rows], kind)
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            cols = [pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, spans], ["doc_id", *names, "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents", deal=True))
