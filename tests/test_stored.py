"""Stored indexes, scans of hot keys, ledgers of streams and questions asked at once, against brute force."""

from __future__ import annotations


import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import grams, impact, indexing, packing, review, rollups, vector_index, vectors, views, windows
from strataloom.operators.scan import Segments
from strataloom.operators.shuffles import Scratch
from strataloom.plans import fixtures as X
from strataloom.plans.stored import ORACLES, QUERIES
from strataloom.sources.tables import bucketed
from strataloom.streaming.events import rate_windows
from strataloom.streaming.ledger import Store, into
from tests.test_oracle import SF, plain

# -- vectors ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    """Vectors around eight directions, a third of them copies of one, some null or zero."""
    rng = np.random.default_rng(3)
    around = rng.normal(size=(8, 12))
    rows = [(i, (around[i % 8] * 3 + rng.normal(size=12)).tolist() if i % 3 else around[0].tolist()) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 12)]
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(3).cache()


def exact_search(rows, queries, k, floor):
    m = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
    out = []
    for q, v in queries:
        if v is not None:
            s = sorted(((-round(float(unit(m[i]) @ unit(np.array(v, np.float32).astype(float))), 9), i) for i in m))
            out += [(q, i, n + 1) for n, (score, i) in enumerate([x for x in s if -x[0] >= floor][:k])]
    return sorted(out)


def test_blocks_find_what_brute_force_finds(points):
    rows = [(r["id"], r["v"]) for r in points.collect()]
    queries = points.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    found = vectors.top_k_each(points, queries, "v", "id", k=7, floor=0.2).collect()
    assert sorted((r["query_id"], r["id"], r["place"]) for r in found) == exact_search(rows, [r for r in rows if r[0] % 20 == 0], 7, 0.2)


def test_memory_of_a_task_is_bounded():
    """The nearest of many cells for a batch of rows, and a block of copies that all tie for each query."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    rows, centers = pd.DataFrame({"id": range(8000), "v": list(rng.normal(size=(8000, 4)))}), rng.normal(size=(2000, 4))
    tracemalloc.start()
    near = pd.concat([b for b in vector_index._nearest(centers, "v", 2)(iter([rows]))])
    cells = np.argsort(-(np.stack(rows["v"][:50]) @ centers.T), axis=1)[:, :2]
    del rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(near["id"]) == list(range(8000)) and (np.stack(near["cells"])[:50] == cells).all()
    assert peak < 200 << 20
    same = np.ones((3000, 256)) / 16
    tracemalloc.start()
    found = vector_index._best(np.arange(3000), same, np.arange(40), same[:40], 3, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [tuple(x) for x in found[["query_id", "id"]].to_numpy()] == [(q, i) for q in range(40) for i in range(3)]
    assert peak < 350 << 20


def test_index_reaches_its_recall(spark, points):
    scratch = Scratch(spark, "test")
    centers = vector_index.fit_centroids(points, "v", cells=16)
    index = vector_index.build_index(points, "v", "id", scratch, centers, block=50)
    sizes = [len(r["ids"]) for r in index.collect()]
    assert sum(sizes) == 601 and max(sizes) < 110  # the copies' cell is several blocks
    queries = points.filter("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    exact = scratch.write(vector_index.search(index, queries, scratch, centers, asked=20), "exact")
    one = vectors.top_k_each(points, queries, "v", "id")
    ids = lambda df: sorted((r["query_id"], r["id"]) for r in df.collect())
    assert ids(exact) == ids(one)
    probes = vector_index.probes_for(index, queries, scratch, centers)
    found = vector_index.search(index, queries, scratch, centers, probes)
    assert probes < len(centers) and vector_index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.94


def test_index_of_nothing(spark):
    none, scratch = spark.createDataFrame([], "id long, v array<float>"), Scratch(spark, "test")
    centers = vector_index.fit_centroids(none, "v")
    index = vector_index.build_index(none, "v", "id", scratch, centers)
    queries = none.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    assert vector_index.probes_for(index, queries, scratch, centers) == 1 and vector_index.search(index, queries, scratch, centers).count() == 0


# -- scans of hot keys ------------------------------------------------------------


@pytest.fixture(scope="module")
def hot(spark):
    """Most events under one user, some under a null one, ties in time, null values and times."""
    rng = random.Random(7)
    rows = [(i, rng.choice([1] * 8 + [2, None]), rng.choice([None, *range(1000)]), rng.choice(["a", "a", "b", None]), rng.choice([None, 1.5, 2.25, 100.125])) for i in range(700)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, second int, status string, value double")
    return df.withColumn("ts", F.timestamp_seconds("second")).repartition(4).cache()


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_scans_in_parts_equal_plain_windows(hot):
    both = lambda f: (rows_of(f(10**9)), rows_of(f(60)))
    whole, split = both(lambda n: windows.sliding_sum(hot, ["user_id"], "ts", "value", 60, whole=n).select("event_id", "used"))
    assert whole == split and len(whole) == 700
    whole, split = both(lambda n: windows.status_changes(hot, ["user_id"], ["ts", "event_id"], F.col("status"), whole=n).select("event_id", "status"))
    assert whole == split and 100 < len(whole) < 700
    whole, split = both(lambda n: packing.pack_prefix(hot, ["user_id"], ["ts", "event_id"], F.col("value"), 5000, whole=n).select("event_id", "used"))
    assert whole == split and 100 < len(whole) < 700
    ranges = hot.filter("second IS NOT NULL").select("user_id", (F.col("second") * 7).alias("start"), (F.col("second") * 7 + F.col("event_id") % 9).alias("end"))
    whole, split = both(lambda n: windows.merge_windows(ranges, ["user_id"], F.lit(9000), padding=1, gap=2, most=1000, whole=n))
    assert whole == split and len(whole) > 50


def test_parts_of_a_hot_key_are_many_and_alike(spark, hot):
    cut = Segments(hot.filter("user_id = 1"), ["user_id"], ["ts"], Scratch(spark, "test"))
    sizes = [r["count"] for r in cut.rows.groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.45 * sum(sizes)


def test_scans_of_nothing(hot):
    none = hot.limit(0)
    assert windows.sliding_sum(none, ["user_id"], "ts", "value", whole=0).count() == 0
    assert windows.status_changes(none, ["user_id"], ["ts"], F.col("status"), whole=0).count() == 0


def test_plain_queries_on_hot_keys_equal_their_sql(spark, monkeypatch):
    """The registered queries with a bound so low that every key is scanned in parts, as if it were hot."""
    import duckdb

    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    for module, name, query in ((windows, "merge_windows", "merge_windows"), (windows, "sliding_sum", "sliding_tokens"), (windows, "status_changes", "status_changes"), (packing, "pack_prefix", "diff_pack_prefix")):
        monkeypatch.setattr(module, name, functools.partial(getattr(module, name), whole=2))
        df = QUERIES[query](spark, SF)
        cols = sorted(df.columns)
        ran = con.execute(ORACLES[query])
        at = [[d[0] for d in ran.description].index(c) for c in cols]
        assert sorted(tuple(map(plain, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in ran.fetchall())


# -- batches applied once ---------------------------------------------------------


def _counts(old, new):
    return {"t": old["t"].unionByName(new["t"]).groupBy("k").agg(F.sum("n").alias("n"))}


def test_a_batch_counts_once_whatever_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), {"t": ("k string, n bigint", ["k"])}, buckets=4)
    rows = lambda *k: {"t": spark.createDataFrame([(x, 1) for x in k], "k string, n bigint")}
    held = lambda: {r["k"]: r["n"] for r in store.read("t").collect()}
    assert held() == {} and store.update(0, rows("a", "b", None), _counts) and held() == {"a": 1, "b": 1, None: 1}
    assert not store.update(0, rows("a"), _counts) and held()["a"] == 1  # a replay

    def broken(old, new):
        raise OSError("an executor was lost")

    before = store.manifest()
    with pytest.raises(OSError, match="lost"):
        store.update(1, rows("a"), broken)
    swap, store._swap = store._swap, lambda _: broken(0, 0)  # lost between the write and the swap
    with pytest.raises(OSError, match="lost"):
        store.update(1, rows("a"), _counts)
    store._swap = swap
    assert store.manifest() == before and held()["a"] == 1
    assert store.update(1, rows("a", "c"), _counts) and held() == {"a": 2, "b": 1, None: 1, "c": 1}
    assert store.update(2, rows(), _counts) and held()["a"] == 2  # an empty batch is a batch
    assert store.sweep() > 0 and held() == {"a": 2, "b": 1, None: 1, "c": 1} and store.sweep() == 0
    untouched = {b: f for b, f in before.folders["t"].items() if f in store.manifest().folders["t"].values()}
    assert untouched  # buckets without a change keep their files
    other = Store(spark, store.path, store.tables, buckets=4)
    with pytest.raises(RuntimeError, match="another writer"):
        other._swap(store.manifest())
    with pytest.raises(ValueError, match="doesn't touch"):
        store.update(3, rows("a"), lambda old, new: {"t": spark.createDataFrame([(x, 1) for x in "abcdefgh"], "k string, n bigint")})


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    landed, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"), {"t": ("k string, n bigint", ["k"])})
    for turn in range(2):
        spark.createDataFrame([("a", 1), ("b", turn)], "k string, n bigint").coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema("k string, n bigint").parquet(landed)
        into(stream, store, lambda df: {"t": df}, _counts, str(tmp_path / "offsets")).awaitTermination()
    assert {r["k"]: r["n"] for r in store.read("t").collect()} == {"a": 2, "b": 1} and store.manifest().batch == 1


def test_a_push_changes_the_stored_index_once(spark, tmp_path):
    tree = spark.createDataFrame(X.DEMO, "file_path string, content string").select(F.col("file_path").alias("path"), F.octet_length("content").alias("size"), "content").cache()
    last = max(p for p, _ in X.DEMO)
    first = indexing.index_full(tree.filter(F.col("path") != last))
    store = indexing.index_store(spark, str(tmp_path / "index"), first)
    assert indexing.store_index(store, 0, "o/r", first) and indexing.store_index(store, 1, "o/s", first)
    push = spark.createDataFrame([(0, last, "added")], "place int, file_path string, kind string")
    assert indexing.store_push(store, 2, "o/r", push, tree) and not indexing.store_push(store, 2, "o/r", push, tree)
    whole = indexing.index_full(tree)
    for name, cols in {"files": ["file_path", "symbol_count"], "symbols": ["file_path", "qualified_name", "start_line"], "edges": ["type", "from_file", "to_name", "line"], "chunks": ["file_path", "start_line", "code"]}.items():
        held = store.read(name)
        assert rows_of(held.filter("repository = 'o/r'").select(*cols)) == rows_of(whole[name].select(*cols)), name
        assert rows_of(held.filter("repository = 'o/s'").select(*cols)) == rows_of(first[name].select(*cols)), name


# -- gram postings ----------------------------------------------------------------


def _found(df):
    return sorted((r["needle"], r["id"]) for r in df.collect())


@pytest.mark.parametrize("stored", [False, True])
def test_needles_are_found_as_by_contains(spark, tmp_path, stored):
    """Short, empty, null, absent and repeated needles; characters beyond the basic plane; a gram that every text holds."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcé😀\n ", k=rng.randint(0, 60))) + "the" for _ in range(300)] + [None, "", "ab", "the"]
    needles = ["", None, "a", "é", "😀", "ab", "a\n", "the", "thee", "abcabcabc", "zzz", "the"] + ["".join(rng.choices("abcé😀\n ", k=rng.randint(1, 7))) for _ in range(150)]
    needles += [t[4:19] for t in texts[:60] if t]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").repartition(3)
    scratch = Scratch(spark, "test")
    index = grams.GramIndex.write(rows, "n", "t", str(tmp_path / "index")) if stored else None
    got = grams.containing(rows, spark.createDataFrame([(x,) for x in needles], "x string"), "n", "t", "x", scratch, index)
    want = sorted((x, i) for x in {*needles} - {None} for i, t in enumerate(texts) if t is not None and x in t)
    assert _found(got) == want and len(want) > 1000
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_search_reads_only_its_grams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i:06}") for i in range(3000)], "n long, t string")
    index = grams.GramIndex.write(rows, "n", "t", str(tmp_path / "index"))
    wanted = spark.createDataFrame([("999",)], "gram string").withColumn("hash", F.xxhash64("gram"))
    part = index.of(wanted, index.postings, Scratch(spark, "test"))
    assert part.count() == 3 and "PushedFilters: [IsNotNull(gram), EqualTo(gram,999)]" in part._jdf.queryExecution().toString()
    few = index.of(spark.createDataFrame([("999",), ("998",)], "gram string").withColumn("hash", F.xxhash64("gram")), index.postings, Scratch(spark, "test"))
    assert few.count() == 6 and "PushedFilters: [In(gram, [998,999])]" in few._jdf.queryExecution().toString()


def test_all_changed_files_count(spark):
    changed = spark.createDataFrame([(f"src/m{i:03}.js",) for i in range(200)], "file_path string")
    tests = spark.createDataFrame([(f"tests/m{i:03}.test.js",) for i in range(150, 240)], "file_path string")
    got = rollups.related_tests(tests, changed)
    assert [r["file_path"] for r in got.collect()] == [f"tests/m{i}.test.js" for i in range(150, 200)]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_symbols_by_a_stored_index(spark, tmp_path):
    symbols = spark.createDataFrame([(f"f{i % 3}", n, i % 2 == 0, i % 5, i) for i, n in enumerate(["chargeCard", "Recharge", "refund", "CHAR", "char", "c", "harbour"])], "file_path string, name string, exported boolean, loc int, start_line int")
    index = impact.name_index(symbols, str(tmp_path / "names"))
    for term in ("char", "HA", "c", " fund ", "nothing"):
        assert rows_of(impact.search_symbols(symbols, term, index=index)) == rows_of(impact.search_symbols(symbols, term))


# -- many questions at once, facts, buckets, rates ----------------------------------


def test_many_questions_are_as_many_single_ones(spark):
    """All symbols of the fixture at once, a name that nothing has, one asked twice; a hub with very many calls."""
    symbols, edges = X.frame(spark, X.SYMBOLS, X.SYMBOLS_SCHEMA), X.frame(spark, X.EDGES, X.EDGES_SCHEMA)
    hub = spark.range(3000).select(F.lit("calls").alias("type"), F.concat(F.lit("gen/f"), F.col("id") % 900, F.lit(".js")).alias("from_file"), F.concat(F.lit("s"), F.col("id") % 70).alias("from_symbol"), F.lit("src/billing.js").alias("to_file"), F.lit("refund").alias("to_symbol"), F.lit("refund").alias("to_name"), F.col("id").cast("int").alias("line"), F.lit(False).alias("external"), F.lit(0.95).alias("confidence"))
    edges = edges.unionByName(hub)
    route = F.array(F.struct(F.lit("GET").alias("method"), F.lit("/r").alias("path"), F.lit("h").alias("handler"), F.lit(1).alias("line")))
    files = X.frame(spark, X.FILES, X.FILES_SCHEMA).withColumn("routes", F.slice(route, F.lit(1), F.least(F.lit(1), F.col("n_routes"))))
    names = ["charge()", "refund", "OrderService.place", "nothing", " charge "]
    asked = spark.createDataFrame([(i, n, "src/orders.js" if n == "place" else None) for i, n in enumerate(names)], "asked int, name string, file_path string")
    many = impact.Impacts(symbols, edges, files, asked)
    got = {part: sorted(map(repr, (tuple(r) for r in getattr(many, part)().collect()))) for part in ("impacts", "counts", "call_paths")}
    want = {part: [] for part in got}
    for i, name in enumerate(names):
        one = impact.Impact(symbols, edges, files, name)
        for part in want:
            want[part] += [repr((i, *r)) for r in getattr(one, part)().collect()]
    assert got == {part: sorted(rows) for part, rows in want.items()}
    assert many.calls.filter("asked = 1").count() == impact.CALLS and many.second.filter("asked = 1").count() <= impact.SECOND_HOP


def test_facts_read_the_files_once(spark, tmp_path):
    rows = [("src/a/x.js", "javascript", 10, False, 2, 1), ("src/b.js", "javascript", None, True, None, 0), ("README.md", "markdown", 99, False, 0, None), (None, None, 1, None, 1, 1)]
    spark.createDataFrame(rows, "file_path string, language string, lines int, is_test boolean, symbol_count int, n_routes int").write.parquet(str(tmp_path / "f"))
    facts = rollups.repository_facts(spark.read.parquet(str(tmp_path / "f")))
    assert str(facts._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    record = rollups.facts_record(facts).first()
    assert (record["files"], record["test_files"], record["lines"], record["symbols"], record["routes"]) == (4, 1, 110, 3, 2)
    assert [(x["name"], x["lines"]) for x in record["languages"]] == [("markdown", 99), ("javascript", 10), (None, 1)]
    assert [(x["name"], x["files"]) for x in record["directories"]] == [("(root)", 2), ("src", 2)]  # a null path is in the root
    assert rollups.repository_facts(spark.read.parquet(str(tmp_path / "f")).limit(0)).count() == 0


def test_buckets_join_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = QUERIES["bucketed_join"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count("Relation") == 2
        scratch = Scratch(spark, "test")
        both = [bucketed(spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias(f"v{i}")), f"b{i}", f"{scratch.path}/b{i}", ["k"], buckets=4) for i in range(2)]
        out = both[0].join(both[1], "k").groupBy("k").count()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and out.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("b0", "b1"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_status_is_observed_while_writing(spark, tmp_path):
    tree = spark.createDataFrame(X.DEMO, "file_path string, content string").select(F.col("file_path").alias("path"), F.octet_length("content").alias("size"), "content")
    full = indexing.index_full(tree)
    store = indexing.index_store(spark, str(tmp_path / "index"), full)
    assert indexing.index_repository(store, 0, "o/r", tree) and indexing.index_repository(store, 1, "o/s", tree, max_files=2) and not indexing.index_repository(store, 1, "o/s", tree)
    status = {r["repository"]: r for r in store.read("status").collect()}
    for name in indexing.FILE_OF:
        assert status["o/r"][name] == full[name].count() == store.read(name).filter("repository = 'o/r'").count()
    assert (status["o/r"]["status"], status["o/r"]["truncated"]) == ("indexed", False)
    assert (status["o/s"]["status"], status["o/s"]["truncated"], status["o/s"]["files"]) == ("partial", True, 2)


def test_late_requests_of_closed_windows_are_dropped(spark, tmp_path):
    schema, landed, out = "user string, ts timestamp", str(tmp_path / "in"), []
    stream = lambda: rate_windows(spark.readStream.schema(schema).parquet(landed), ["user"], "ts", 60, 1, late="2 minutes")
    for seconds in ([0, 10, 70], [600], [30, 500]):  # 30 is late for its window by then, 500 isn't
        spark.createDataFrame([("u", s) for s in seconds], "user string, s long").select("user", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(landed)
        stream().writeStream.option("checkpointLocation", str(tmp_path / "offsets")).outputMode("update").foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("u", 0, 2, 1), ("u", 60, 1, 0), ("u", 480, 1, 0), ("u", 600, 1, 0)]
    batch = rate_windows(spark.read.schema(schema).parquet(landed), ["user"], "ts", 60, 1)
    assert sorted(map(tuple, batch.collect())) == [("u", 0, 3, 2), ("u", 60, 1, 0), ("u", 480, 1, 0), ("u", 600, 1, 0)]


# -- requested changes ------------------------------------------------------------


def test_files_of_a_change_share_its_budget(spark):
    """A long file in windows, one that no longer fits whole, one that is cut, one that finds no room; merged windows."""
    line = lambda n, w=20: "\n".join(f"{i:03} " + "x" * w for i in range(1, n + 1))
    files = {"long.js": line(300, 4), "mid.js": line(100), "big.js": line(200, 60), "late.js": "short", "none.js": None, "small.js": "a\nb"}
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    targets = spark.createDataFrame([("r", "long.js", 1), ("r", "mid.js", 2), ("r", "big.js", 3), ("r", "late.js", 4), ("s", "none.js", 1), ("s", "small.js", 2)], "request string, path string, place int")
    ranges = spark.createDataFrame([("r", "long.js", 100, 101), ("r", "long.js", 120, 122), ("r", "long.js", 290, 299), ("s", "long.js", 1, 2)], "request string, path string, start int, end int")
    got = {(r["request"], r["path"]): r for r in review.change_files(targets, df, ranges, 10_000).collect()}
    assert got.keys() == {("r", "long.js"), ("r", "mid.js"), ("r", "big.js"), ("s", "small.js")}
    long, mid, big, small = (got[k] for k in (("r", "long.js"), ("r", "mid.js"), ("r", "big.js"), ("s", "small.js")))
    assert long["windowed"] and [x for x in long["rendered"].split("\n") if x.startswith("---")] == ["--- lines 85-137 of 300 ---", "--- lines 275-300 of 300 ---"]
    assert not mid["windowed"] and mid["rendered"].startswith("   1| 001 x") and small["rendered"] == "   1| a\n   2| b"
    room = 6500 - len(long["rendered"]) - len(mid["rendered"])
    assert big["windowed"] and big["rendered"].startswith("--- lines 1-95 of 200 ---") and big["rendered"].endswith(review.CUT) and len(big["rendered"]) == room + len(review.CUT) > 900
    edges = spark.createDataFrame([("imports" if i % 2 else "calls", f"f{i:03}.js", "" if i % 3 else "go", "mid.js", "mid", i) for i in range(40)] + [("tests", "t.js", "", "mid.js", "mid", 1)], "type string, from_file string, from_symbol string, to_file string, to_name string, line int")
    said = review.change_importers(edges, review.change_files(targets, df, ranges, 10_000)).orderBy("place").collect()
    assert len(said) == 14 and said[0]["importer"] == "- f000.js:0 go calls mid" and said[1]["importer"] == "- f001.js:1 <module> imports mid"
    assert [r["path"] for r in review.known_paths(df, 3).orderBy("place").collect()] == ["big.js", "late.js", "long.js"]


# -- lists ------------------------------------------------------------------------


def test_lists_of_conversations_and_reviews(spark):
    turns = spark.createDataFrame([("o", c, t, "user" if t % 2 else "assistant", "x" * 800 if t == 5 else None if t == 4 else f"t{t}") for c in range(30) for t in range(1, 7 - c % 2)], "owner string, conv int, turn int, role string, text string")
    listed = views.conversations(turns, "owner", "conv", "turn").orderBy("place").collect()
    assert [(r["conv"], r["messages"]) for r in listed] == [(c, 6) for c in range(0, 30, 2)] + [(c, 5) for c in (1, 3, 5, 7, 9)]
    block = views.history(turns, "conv", "turn", assistant="Helper").filter("conv = 1").first()["block"].split("\n")
    assert block == ["Earlier turns:", "Helper: t2", "User: t3", "Helper: ", "User: " + "x" * 700]
    pulls = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "number int, head_sha string")
    reviews = spark.createDataFrame([(1, "z", "approve", 1, 1), (1, "a", "comment", 2, 1), (2, "b", "old", 5, 1), (2, "x", "new", 5, 2), (4, None, "none", 1, 1)], "number int, head_sha string, verdict string, created_at int, id int")
    assert [(r["number"], r["verdict"], r["stale"]) for r in views.with_reviews(pulls, reviews).orderBy("number").collect()] == [(1, "comment", False), (2, "new", True), (3, None, None), (4, "none", False)]

def test_impacts_place_the_edges_of_many_keys_once(spark, monkeypatch):
    """Questions with several files each: the places are one number, so no text is sorted for each question."""
    edges = [("imports", f"f{(i * 7) % 40:02}", "", "x", f"m{i % 6}", "x", i, 1.0) for i in range(240)]
    edges = spark.createDataFrame(edges, "type string, from_file string, from_symbol string, to_name string, to_file string, to_symbol string, line long, confidence double")
    asked = spark.createDataFrame([(a, "n", f"m{m}") for a in range(3) for m in (a, a + 1, a + 3)], "asked long, name string, to_file string")
    of = impact.Impacts.__new__(impact.Impacts)
    of._scratch, kept = Scratch(spark, "test"), []
    monkeypatch.setattr(of, "_keep", lambda rows, name: kept.append(name) or of._scratch.write(rows, name), raising=False)
    got = of._edges(edges, "to_file", asked.select("asked", "to_file"), 50)
    key = lambda r: (r["from_file"], r["line"])
    rows = [r.asDict() for r in edges.collect()]
    want = {(a, *key(r)) for a in range(3) for r in sorted((r for r in rows if r["to_file"] in {f"m{a}", f"m{a + 1}", f"m{a + 3}"}), key=key)[:50]}
    assert {(r["asked"], *key(r)) for r in got.collect()} == want
    assert "first-to_file" in kept


def test_related_tests_need_no_pairs(spark, monkeypatch):
    """Names that many paths share meet the pieces of the paths, and nothing else."""
    monkeypatch.setattr(grams, "candidates", None)
    names = ["a.b", "doc1", "doc12", "x\U0001f600y", "?y", "(", "none"]
    files = [f"t/{i}/doc{i}.md" for i in range(90)] + ["t/x\U0001f600y.js", "t/a.b", "t/axb", "t/(.py", None]
    tests = spark.createDataFrame([(p,) for p in files], "file_path string")
    changed = spark.createDataFrame([(f"src/{n}.md",) for n in [*names, names[0]]] + [(None,)], "file_path string")
    want = sorted(p for p in files if p and any(n in p for n in names))
    assert [r["file_path"] for r in rollups.related_tests(tests, changed).collect()] == want
    assert rollups.related_tests(tests, changed.limit(0)).count() == 0
    assert rollups.related_tests(tests, spark.createDataFrame([("src/.md",)], "file_path string"), 200).count() == 94


def test_postings_of_one_pass(spark):
    """The shorter grams that come from the longer ones are those of passes of their own."""
    texts = ["", None, "a", "ab", "abc", "aé\n", "x\U0001f600y\U0001f600", "\U0001f600", "aaaa", "zäß "]
    texts = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for sizes in ((1, 2, 3), (3,), (1, 3)):
        rows = [sorted(map(tuple, f(texts, "id", "text", sizes).collect())) for f in (grams.postings, grams.nested_postings)]
        assert rows[0] == rows[1]


# -- texts --------------------------------------------------------------------------


def test_commit_subjects_on_letters_without_one_capital(spark, tmp_path):
    import duckdb

    texts = [f"{c}bc" for c in "ßŉǰΐևẖᾀᾈᾳῒﬁﬓǆɤ𐵰éя"] + ["  ß x　", "\tß \r", "ß  ", "ß" * 70, "", "\nx", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {tuple(r) for r in QUERIES["commit_subjects"](spark, str(tmp_path)).collect()} == set(con.execute(ORACLES["commit_subjects"]).fetchall())
