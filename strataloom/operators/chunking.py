"""Cutting files into chunks: by symbols, by blocks, and by size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths, text
from strataloom.plans.session import ship

# Least trimmed characters of a chunk and of a gap, most characters of a chunk, least lines and overlap of a part.
LEAST, LEAST_GAP, MOST, LEAST_LINES, OVERLAP, HEADING_AFTER = 40, 120, 1800, 12, 2, 300
_MODULE = {"symbol_name": "<module>", "exported": False, "signature": "", "doc": ""}


def block_ranges(lines: Column, most: int = MOST) -> Column:
    """array<struct<start, end>> of prose blocks: closed at `most` characters, or ahead of a heading beyond 300.

    One pass over the lines that carries the open block's length.
    """
    state = "struct<start:int,size:int,out:array<struct<start:int,end:int>>>"
    rows = F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (i + 1).cast("int").alias("at"), F.coalesce(F.get(lines, i + 1).rlike(r"^#{1,3}\s"), F.lit(False)).alias("heading")))
    begin = F.struct(F.lit(1).alias("start"), F.lit(-1).alias("size"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        size = s["size"] + 1 + x["n"]
        full = (size >= most) | (x["heading"] & (size > HEADING_AFTER))
        closed = F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), x["at"].alias("end"))))
        return F.struct(F.when(full, x["at"] + 1).otherwise(s["start"]).alias("start"), F.when(full, -1).otherwise(size).alias("size"), F.when(full, closed).otherwise(s["out"]).alias("out")).cast(state)

    last = F.size(lines)
    return F.aggregate(rows, begin, step, lambda s: F.when(s["start"] <= last, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), last.alias("end"))))).otherwise(s["out"]))


def prose_chunks(files: DataFrame, key: str, content: str, most: int = MOST) -> DataFrame:
    """key, start_line, end_line, code of the blocks with at least LEAST trimmed characters."""
    rows = files.select(key, F.split(F.coalesce(content, F.lit("")), "\n").alias("lines"))
    out = rows.select(key, "lines", F.inline(block_ranges(F.col("lines"), most))).withColumn("code", F.array_join(F.slice("lines", F.col("start"), F.col("end") - F.col("start") + 1), "\n"))
    return out.filter(F.length(text.trimmed(F.col("code"))) >= LEAST).select(key, F.col("start").alias("start_line"), F.col("end").alias("end_line"), "code")


def part_lines(n_lines: Column, n_chars: Column, most: int = MOST) -> Column:
    """Lines of one part of an oversized unit."""
    return F.greatest(F.lit(LEAST_LINES), F.ceil(n_lines / F.ceil(n_chars / most))).cast("int")


def size_parts(units: DataFrame, key: str, content: str, most: int = MOST) -> DataFrame:
    """key, part, start_line, end_line, code: units of whole texts cut at `most` characters with two lines of overlap.

    Parts below LEAST trimmed characters are left out before parts are numbered.
    """
    body, n = F.coalesce(F.col(content), F.lit("")), F.size(F.split(F.coalesce(F.col(content), F.lit("")), "\n"))
    rows = units.select(key, F.split(body, "\n").alias("lines"), n.alias("n"), F.when(F.length(body) <= most, n).otherwise(part_lines(n, F.length(body), most)).alias("step"), (F.length(body) <= most).alias("whole"))
    rows = rows.select(key, "lines", "n", "step", "whole", F.explode(F.sequence(F.lit(1), "n", "step")).alias("start_line"))
    rows = rows.withColumn("end_line", F.when(F.col("whole"), F.col("n")).otherwise(F.least("n", F.col("start_line") + F.col("step") - 1 + OVERLAP)))
    rows = rows.withColumn("code", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    kept = rows.filter(F.length(text.trimmed(F.col("code"))) >= LEAST)
    return kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("start_line")).alias("part"), "start_line", "end_line", "code")


def _cut(lines: list[str], start: int, end: int) -> str:
    return "\n".join(lines[max(0, start - 1) : end])


def _blocks(lines: list[str], most: int) -> Iterator[dict]:
    start, size = 1, -1
    for i, line in enumerate(lines, 1):
        size += 1 + len(line)
        heading = i < len(lines) and re.match(r"#{1,3}\s", lines[i])
        if size >= most or heading and size > HEADING_AFTER or i == len(lines):
            yield _MODULE | {"symbol_type": "block", "start_line": start, "end_line": i}
            start, size = i + 1, -1


def _units(lines: list[str], symbols: list[dict], most: int) -> Iterator[dict]:
    """Outermost symbols, the preamble ahead of them and what lies between; inside an oversized symbol its parts too."""
    chosen: list[dict] = []
    for s in sorted((s for s in symbols if 0 < s["start_line"] <= s["end_line"]), key=lambda s: (s["start_line"], s["end_line"])):
        around = chosen[-1] if chosen else None
        inside = around is not None and around["start_line"] <= s["start_line"] and s["end_line"] <= around["end_line"]
        if not inside or len(_cut(lines, around["start_line"], around["end_line"])) > most:
            chosen.append(s)
    module = lambda a, b: _MODULE | {"symbol_type": "module", "start_line": a, "end_line": b}
    first = chosen[0]["start_line"]
    if first > 3:
        yield module(1, first - 1)
    reached = 0
    for s in chosen:
        if 0 < reached < s["start_line"] - 1 and len(_cut(lines, reached + 1, s["start_line"] - 1).strip()) >= LEAST_GAP:
            yield module(reached + 1, s["start_line"] - 1)
        yield {"symbol_name": s["qualified_name"] or s["name"], "symbol_type": s["kind"], **{k: s[k] for k in ("start_line", "end_line", "exported", "signature", "doc")}}
        reached = max(reached, s["end_line"])
    if reached < len(lines) - 1 and len(_cut(lines, reached + 1, len(lines)).strip()) >= LEAST_GAP:
        yield module(reached + 1, len(lines))


def _parts(unit: dict, lines: list[str], most: int) -> Iterator[dict]:
    code = _cut(lines, unit["start_line"], unit["end_line"])
    if len(code.strip()) < LEAST:
        return
    total = unit["end_line"] - unit["start_line"] + 1
    step, n = max(LEAST_LINES, -(-total // -(-len(code) // most))), 0
    if len(code) > most:
        for start in range(unit["start_line"], unit["end_line"] + 1, step):
            end = min(unit["end_line"], start + step - 1 + OVERLAP)
            part = _cut(lines, start, end)
            if len(part.strip()) >= LEAST:
                n += 1
                yield unit | {"symbol_name": f"{unit['symbol_name']}#{n}", "start_line": start, "end_line": end, "code": part}
    if not n:
        yield unit | {"code": code}


def chunk_source(content: str, symbols: list[dict], most: int = MOST) -> list[dict]:
    lines = content.split("\n")
    units = _units(lines, symbols, most) if any(0 < s["start_line"] <= s["end_line"] for s in symbols) else _blocks(lines, most)
    return [p for u in units for p in _parts(u, lines, most)]


_CHUNK = ["symbol_name", "symbol_type", "start_line", "end_line", "exported", "signature", "doc", "code"]


def chunk_files(analyzed: DataFrame, most: int = MOST) -> DataFrame:
    """Chunks of analysed files: file_path, language, is_test, the chunk's symbol and lines, code and text to embed."""
    ship(analyzed.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, content, symbols in zip(b.file_path, b.language, b.content, b.symbols, strict=True):
                rows += [(path, language, i, *[c[k] for k in _CHUNK]) for i, c in enumerate(chunk_source(content, list(symbols), most))]
            yield pd.DataFrame(rows, columns=["file_path", "language", "chunk_no", *_CHUNK])

    out = analyzed.select("file_path", "language", "content", "symbols").mapInPandas(run, "file_path string, language string, chunk_no int, symbol_name string, symbol_type string, start_line int, end_line int, exported boolean, signature string, doc string, code string")
    return out.withColumn("is_test", paths.is_test_path(F.col("file_path"))).withColumn("text", text.chunk_text(*[F.col(c) for c in ("file_path", "symbol_type", "symbol_name", "start_line", "end_line", "doc", "code")]))


def cap_chunks(chunks: DataFrame, most: int = 6000) -> DataFrame:
    """The first `most` chunks in the order of path and number, the feature being the cap."""
    return chunks.orderBy("file_path", "chunk_no").limit(most)
