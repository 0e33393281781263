"""Analysis of source files as a DataFrame: one nested record a file, and its parts unnested."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators.extract.generic import analyze_generic
from strataloom.operators.extract.javascript import analyze_javascript
from strataloom.plans.session import ship

SYMBOL = "name string, qualified_name string, kind string, class_name string, signature string, params array<string>, exported boolean, is_async boolean, doc string, start_line int, end_line int, loc int, calls array<string>"
ANALYSIS = (
    "parse_ok boolean, imports array<struct<raw:string,specifiers:array<string>,is_external:boolean,line:int>>, exports array<string>, "
    f"symbols array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in SYMBOL.split(', '))}>>, routes array<struct<method:string,path:string,handler:string,line:int>>, "
    "calls array<struct<`from`:string,`to`:string,receiver:string,line:int>>"
)
_PARTS = ["parse_ok", "imports", "exports", "symbols", "routes", "calls"]


def analyze_source(file_path: str, content: str, language: str, js_family: bool) -> dict:
    """The record of one file; a JavaScript file that doesn't parse keeps its language and is empty."""
    if js_family:
        return analyze_javascript(content, jsx=not file_path.lower().endswith((".ts", ".mts", ".cts")))
    return analyze_generic(content, language)


def analyze_files(files: DataFrame) -> DataFrame:
    """files (.., file_path, content) with language and the analysis columns. Per row, without a shuffle."""
    ship(files.sparkSession)
    path = F.col("file_path")
    rows = files.withColumn("language", paths.detect_language(path)).withColumn("content", F.coalesce("content", F.lit(""))).withColumn("__js", paths.is_js_family(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [analyze_source(*x) for x in zip(b.file_path, b.content, b.language, b.pop("__js"), strict=True)]
            yield b.assign(**{p: [f[p] for f in found] for p in _PARTS})

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__js"]
    return rows.mapInPandas(run, ", ".join([*kept, ANALYSIS]))
