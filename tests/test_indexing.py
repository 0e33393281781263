"""Indexing as a job, review context, answer checks and lists."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strataloom.operators import answers, indexing, review, selection, upserts, views
from strataloom.plans import fixtures as X


def rows(df, *cols):
    return sorted(map(repr, df.select(*cols).collect()))


def tree(spark):
    return spark.createDataFrame(X.DEMO, "file_path string, content string").select(F.col("file_path").alias("path"), F.octet_length("content").alias("size"), "content")


def test_a_push_leads_to_the_tables_of_the_whole_tree(spark, tmp_path):
    whole = tree(spark)
    full = indexing.index_full(whole)
    last = max(p for p, _ in X.DEMO)
    before = whole.filter(F.col("path") != last).unionByName(spark.createDataFrame([("src/old.js", 30, "export function old() { return 1; }")], whole.schema))
    changes = spark.createDataFrame([(0, last, "added"), (1, last, "modified"), (2, "src/old.js", "removed"), (3, "logo.png", "added")], "place int, file_path string, kind string")
    after = indexing.index_incremental(indexing.index_full(before), changes, whole)
    for name, cols in {"files": ["file_path", "symbol_count", "content_sha"], "symbols": ["file_path", "qualified_name", "start_line"], "edges": ["type", "from_file", "to_name", "line"], "chunks": ["file_path", "symbol_name", "start_line", "code"]}.items():
        assert rows(after[name], *cols) == rows(full[name], *cols), name
    status = full["status"].first()
    assert (status["status"], status["truncated"]) == ("indexed", False) and status["chunk_count"] == full["chunks"].count()
    assert indexing.index_full(whole, max_files=2)["status"].first()["status"] == "partial"
    at = str(tmp_path / "chunks")
    upserts.replace_partitions(full["chunks"].select(F.lit("r").alias("repository"), "file_path"), at, ["repository"])
    upserts.replace_partitions(full["chunks"].limit(1).select(F.lit("s").alias("repository"), "file_path"), at, ["repository"])
    assert spark.read.parquet(at).groupBy("repository").count().count() == 2


def test_a_push_brings_a_bounded_number_of_files(spark):
    changes = spark.createDataFrame([(i, f"src/f{i:03}.js", "added") for i in range(150)] + [(200, "node_modules/x.js", "added")], "place int, file_path string, kind string")
    changed, removed = indexing.changed_files(changes)
    assert sorted(r["file_path"] for r in changed.collect()) == [f"src/f{i:03}.js" for i in range(120)] and removed.count() == 0


def test_selection_without_keys_equals_that_of_one_key(spark):
    entries = spark.createDataFrame(X.TREE, X.TREE_SCHEMA).withColumn("r", F.lit(1))
    for most in (0, 3, 500):
        one, other = (selection.select_files(entries, keys, max_files=most) for keys in (None, ["r"]))
        assert rows(one, "path", "selected", "reason", "score") == rows(other, "path", "selected", "reason", "score")


def test_change_and_overview_formats(spark):
    good = {"summary": "s", "files": [{"path": "a.js", "edits": [{"startLine": 1, "endLine": 2, "replacement": ""}]}]}
    cases = [(good, None), (good | {"files": good["files"] * 7}, "files"), (good | {"files": [{"path": ""}]}, "files"), (good | {"files": [{"path": "a", "action": "delete"}]}, "files"), (good | {"files": [{"path": "a", "edits": [{"startLine": 0, "endLine": 1, "replacement": "x"}]}]}, "files"), (good | {"warnings": ["w" * 301]}, "warnings"), (good | {"files": []}, None)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "n int, a string")
    got = df.orderBy("n").select(answers.change_fault(answers.parsed(F.col("a"), answers.CHANGE)).alias("f")).collect()
    assert [r["f"] for r in got] == [f for _, f in cases]
    views_ = [({"summary": "s"}, None), ({"summary": None}, "summary"), ({"summary": "s", "frameworks": ["x"] * 21}, "frameworks"), ({"summary": "s", "importantDirectories": [{"path": "p"}]}, None)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(views_)], "n int, a string")
    assert [r["f"] for r in df.orderBy("n").select(answers.overview_fault(answers.parsed(F.col("a"), answers.OVERVIEW)).alias("f")).collect()] == [f for _, f in views_]
    filled = df.sparkSession.createDataFrame([(X._review(testGaps=None),)], "a string").select(answers.review_defaults(answers.parsed(F.col("a"), answers.REVIEW)).alias("r")).first()["r"]
    assert filled["testGaps"] == [] and filled["findings"][0]["category"] == "correctness" and filled["findings"][0]["line"] == 0


def test_lists(spark):
    repos = spark.createDataFrame([("o/Alpha", "indexed", True, False), ("o/beta", "not_indexed", True, True), ("p/alpha", "partial", False, False)], "full_name string, status string, can_write boolean, private boolean")
    names = lambda **f: sorted(r["full_name"] for r in views.matching(repos, **f).collect())
    assert names() == ["o/Alpha", "o/beta", "p/alpha"] and names(search="ALPHA", writable=True) == ["o/Alpha"] and names(private=True) == ["o/beta"] and names(indexed=True) == ["o/Alpha", "p/alpha"]
    jobs = spark.createDataFrame([("a", i % 3, i) for i in range(40)], "owner string, at int, id int")
    assert [(r["at"], r["id"]) for r in views.newest(jobs, "owner", "at", views.LISTS["jobs"], "id").orderBy("place").collect()] == sorted(((i % 3, i) for i in range(40)), key=lambda x: (-x[0], x[1]))[:15]


def test_targets_follow_the_input_budget(spark):
    wanted = spark.createDataFrame([(i, f"src/{i}.js") for i in range(9)], "place int, path string")
    none = wanted.limit(0)
    assert [review.ranked_targets(wanted, none, n).count() for n in (0, 4999, 10_000, 100_000)] == [1, 1, 2, 4]
