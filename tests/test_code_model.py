"""Extraction, chunking, the graph, impact, changes and events on inline fixtures."""

from __future__ import annotations

import hashlib
import hmac
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import paths, text
from strataloom.operators import chunking, graph, jobs, packing, patches, upserts, vectors, windows
from strataloom.operators.extract.analyze import analyze_files
from strataloom.operators.extract.generic import analyze_generic
from strataloom.operators.extract.javascript import analyze_javascript
from strataloom.plans import fixtures as X
from strataloom.plans.queries import QUERIES, _fixture_impact
from strataloom.sources import tables
from strataloom.streaming import events

SERVICE = """import db from 'pg';
import { pay } from './pay.js';

/**
 * Books a ticket.
 */
export async function book(user, { seat, ...rest }, ...more) {
  await pay(user);
  return db.tickets.insert({ seat });
}

export class Desk extends Base {
  async open(hours = 8) { return this.staff.call(hours); }
}
const useSeats = (id) => load(id);
export const Seat = ({ n }) => <p>It's {label(n)}</p>;
router.get('/seats/:id', auth, desk.show);
router.post('/seats', handle);
"""


def by_name(found: dict) -> dict:
    return {s["qualified_name"]: s for s in found["symbols"]}


def test_modules_with_import_and_export():
    a = analyze_javascript(SERVICE)
    s = by_name(a)
    assert a["parse_ok"] and [(i["raw"], i["is_external"], i["specifiers"]) for i in a["imports"]] == [("pg", True, ["db"]), ("./pay.js", False, ["pay"])]
    assert set(a["exports"]) == {"book", "Desk", "Seat"}
    assert {n: x["kind"] for n, x in s.items()} == {"book": "function", "Desk": "class", "Desk.open": "method", "useSeats": "hook", "Seat": "component", "GET /seats/:id": "route", "POST /seats": "route"}
    assert s["book"]["is_async"] and s["book"]["exported"] and s["book"]["doc"] == "Books a ticket." and s["book"]["params"] == ["user", "{ seat, ... }", "...more"]
    assert s["book"]["end_line"] > s["book"]["start_line"] and s["Desk"]["signature"] == "class Desk extends Base"
    assert {(c["from"], c["to"], c["receiver"]) for c in a["calls"]} >= {("book", "pay", ""), ("book", "insert", "db.tickets"), ("Desk.open", "call", "this.staff"), ("useSeats", "load", ""), ("Seat", "label", "")}
    assert [(r["method"], r["path"], r["handler"]) for r in a["routes"]] == [("GET", "/seats/:id", "auth, desk.show"), ("POST", "/seats", "handle")]


def test_modules_with_require():
    a = analyze_javascript("const { a } = require('./a');\nconst run = wrap(async (req) => { a(req); });\nmodel.statics.find = async function (x) { return go(x); };\nmodule.exports = { run, other: 1 };\n")
    s = by_name(a)
    assert [i["raw"] for i in a["imports"]] == ["./a"] and a["exports"] == ["run", "other"]
    assert s["run"]["signature"] == "async run(req) via wrap" and s["run"]["exported"] and s["run"]["calls"] == ["wrap", "a"]
    assert s["model.statics.find"]["name"] == "find" and s["model.statics.find"]["class_name"] == "model.statics"


TYPED = """export class Repo<T> {
  async load<K extends keyof T>(key: K): Promise<T[K]> { return fetchOne<T[K]>(key); }
  all() { return this.db.query<Array<T>>('x', new Map<string, number>()); }
}
export const pick = <T,>(xs: T[]) => first<T>(xs);
export const run = async <A, B>(a: A) => { await go<{ a: A; b: B }>(a); };
export const useIt = wrap<Req, Res>(async (req) => done(req));
function cmp(a, b, c, d) { if (a < b && c > (d)) return x > (y); return f(a < b); }
let z = a < b
c > (d)
"""


def test_type_arguments():
    a = analyze_javascript(TYPED, jsx=False)
    assert [(s["kind"], s["qualified_name"], s["params"], s["calls"]) for s in a["symbols"]] == [
        ("class", "Repo", [], []), ("method", "Repo.load", ["key"], ["fetchOne"]), ("method", "Repo.all", [], ["query"]), ("function", "pick", ["xs"], ["first"]),
        ("function", "run", ["a"], ["go"]), ("hook", "useIt", ["req"], ["wrap", "done"]), ("function", "cmp", ["a", "b", "c", "d"], ["f"]),
    ]
    assert a["exports"] == ["Repo", "pick", "run", "useIt"] and {c["to"] for c in a["calls"]} == {"fetchOne", "query", "first", "go", "wrap", "done", "f"}
    assert next(c for c in a["calls"] if c["to"] == "query")["receiver"] == "this.db"


def test_broken_and_typed_files():
    assert analyze_javascript("function x( {{ if")["parse_ok"] is False
    a = analyze_javascript("export const add = (a: number, b: number): number => a + b;\nexport async function load<T>(id: string): Promise<T> { return get(id); }\n", jsx=False)
    assert by_name(a)["add"]["params"] == ["a", "b"] and by_name(a)["load"]["params"] == ["id"] and a["exports"] == ["add", "load"]


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab(){}[]<>/'\"`$=;,. \n", max_size=60))
def test_no_text_breaks_the_reader(code):
    assert set(analyze_javascript(code)) >= {"parse_ok", "symbols", "calls"}


def test_other_languages():
    py = analyze_generic("import os\nfrom a.b import c\n\n\nclass Box:\n    def put(self, x): pass\n\nasync def go(a, b):\n    pass\n", "python")
    assert [i["raw"] for i in py["imports"]] == ["os", "a.b"]
    assert {(s["name"], s["kind"], s["exported"]) for s in py["symbols"]} == {("Box", "class", True), ("put", "function", True), ("go", "function", True)}
    # a symbol begins on the first of the blank lines before it, and ends where the next begins
    assert {s["name"]: (s["start_line"], s["end_line"]) for s in py["symbols"]} == {"Box": (3, 5), "put": (6, 6), "go": (7, 10)}
    go = analyze_generic('import "fmt"\nfunc (s *Server) Start(port int) {\n}\nfunc stop() {\n}\ntype Server struct {\n}\n', "go")
    assert {(s["name"], s["exported"]) for s in go["symbols"]} == {("Start", True), ("stop", False), ("Server", True)} and go["imports"][0]["raw"] == "fmt"
    assert analyze_generic("public class A {\n  public void run(int a) {\n  }\n}\n", "java")["symbols"][1]["params"] == ["int a"]
    assert analyze_generic("x", "unknown")["symbols"] == []


def test_chunks_of_symbols_blocks_and_oversize():
    found = analyze_javascript(SERVICE)["symbols"]
    names = [c["symbol_name"] for c in chunking.chunk_source(SERVICE, found)]
    assert "book" in names and "Desk" in names and "<module>" in names
    long = "function big() {\n" + "  call(one, two);\n" * 400 + "}\n"
    parts = chunking.chunk_source(long, analyze_javascript(long)["symbols"], 800)
    assert len(parts) > 1 and all(len(p["code"]) < 2000 for p in parts) and [p["symbol_name"] for p in parts[:2]] == ["big#1", "big#2"]
    # an oversized class comes out with its methods besides
    cls = "class Wide {\n" + "".join(f"  m{i}() {{ return this.part({i}); /* {'x' * 60} */ }}\n" for i in range(40)) + "}\n"
    kinds = {c["symbol_type"] for c in chunking.chunk_source(cls, analyze_javascript(cls)["symbols"], 1800)}
    assert kinds == {"class", "method"}
    prose = "# A\n" + "words and words\n" * 30 + "# B\n" + "more of the words\n" * 200
    blocks = chunking.chunk_source(prose, [])
    assert len(blocks) > 2 and all(b["symbol_type"] == "block" for b in blocks) and blocks[1]["code"].startswith("# B")


@pytest.fixture(scope="module")
def demo(spark):
    return analyze_files(X.frame(spark, X.DEMO, "file_path string, content string")).cache()


def edges_of(frame):
    return {(e["type"], e["from_file"], e["from_symbol"], e["to_file"], e["to_symbol"], e["to_name"]): e for e in frame.collect()}


def test_graph_of_a_repository(demo):
    g = graph.build_graph(demo)
    edges = edges_of(g["edges"])
    call = edges["calls", "src/controllers/orders.js", "createOrder", "src/services/orders.js", "placeOrder", "placeOrder"]
    assert call["confidence"] == 0.95 and not call["external"]
    assert ("tests", "tests/orders.test.js", "<module>", "src/services/orders.js", "placeOrder", "placeOrder") in edges
    outside = next(e for k, e in edges.items() if k[0] == "imports" and k[5] == "express")
    assert outside["external"] and outside["to_file"] == "" and outside["confidence"] == 0.5
    assert edges["imports", "src/controllers/orders.js", "", "src/services/orders.js", "", "../services/orders.js"]["confidence"] == 0.95
    files = {r["file_path"] for r in demo.collect()}
    assert {e["to_file"] for e in edges.values()} <= files | {""}
    symbols = g["symbols"].collect()
    assert sum(e["type"] == "defines" for e in edges.values()) == len(symbols) and not any("json" in s["calls"] for s in symbols)
    route = next(e for e in edges.values() if e["type"] == "routes" and e["from_symbol"] == "POST /")
    assert route["to_name"] == "requireUser" and route["to_file"] == "src/middleware/auth.js"
    assert g["files"].count() == demo.count()


def test_incremental_resolves_against_the_rest(demo):
    whole = graph.build_graph(demo)
    part = demo.filter("file_path = 'src/controllers/orders.js'")
    rest = demo.filter("file_path <> 'src/controllers/orders.js'")
    alone = graph.build_graph(part, extra_files=rest, extra_symbols=whole["symbols"].filter("file_path <> 'src/controllers/orders.js'"))
    want = {k for k in edges_of(whole["edges"]) if k[1] == "src/controllers/orders.js"}
    assert set(edges_of(alone["edges"])) == want


def test_impact_follows_the_graph(spark):
    i = _fixture_impact(spark)
    got = {r["file_path"]: r for r in i.impacts().collect()}
    assert "src/billing.js" not in got  # the defining file is never listed
    assert got["src/orders.js"]["severity"] == "HIGH" and got["src/orders.js"]["reasons"] == ["Calls charge()", "Imports src/billing.js"]
    assert got["tests/billing.test.js"]["severity"] == "LOW" and got["src/routes.js"]["severity"] == "HIGH"
    # a hop through a method is lost by name, and found by target
    assert "src/admin.js" not in got
    counts = i.counts().first()
    assert (counts["definitions"], counts["direct_callers"], counts["importers"], counts["second_hop"], counts["tests"]) == (1, 3, 2, 2, 1)
    assert i.tests().count() == 1
    assert "src/app.js:boot → src/routes.js:checkout → charge" in {r[0] for r in i.call_paths().collect()}


def test_patch_reasons_and_counts(spark):
    rows = QUERIES["line_diff"](spark, "").collect()
    assert [r["reason"] for r in rows] == [None, None, "overlap", "inverted", "out-of-range", "not-in-context", "path:segment", "missing", "exists", None, "empty", "shrunk", None, "no-content", None]
    assert [(r["additions"], r["deletions"]) for r in rows if r["additions"] is not None] == [(3, 2), (0, 1), (1, 0), (1, 1)]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_length_is_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert patches.common_length(a, b) == best[-1][-1]


@settings(deadline=None, max_examples=50)
@given(st.permutations([(1, 1, "x"), (3, 4, "y\nz"), (6, 6, "")]))
def test_edits_apply_in_any_order(edits):
    assert patches.apply_edits("1\n2\n3\n4\n5\n6\n7", edits) == "x\n2\ny\nz\n5\n7"


def test_greedy_packing_skips_but_does_not_stop(spark):
    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.randint(0, 900) for _ in range(12)]
        used, taken = 0, []
        for s in sizes:
            fits = not (used + s + 120 > 2000 and sum(taken) >= 4)
            taken.append(fits)
            used += fits * (s + 120)
        got = spark.range(1).select(packing.greedy(F.array(*map(F.lit, sizes)), 2000)).first()[0]
        assert got == taken


def test_packing_reads_a_key_to_its_end(spark):
    sizes = [3000] * 5 + [5000] * 20_000 + [400, 10, 5000, 2]
    rows = spark.createDataFrame([("hot", i, s) for i, s in enumerate(sizes)] + [("b", 7, 9)], "source string, doc_id long, n_chars long")
    got = packing.pack_context(rows, ["source"], ["doc_id"], "n_chars", 16_000).collect()
    assert sorted((r["source"], r["doc_id"]) for r in got) == [("b", 7), *(("hot", i) for i in (0, 1, 2, 3, 4, 20_006, 20_008))]


def test_many_copies_of_a_vector_are_ordered_by_id(spark):
    rng = random.Random(12)
    one = [rng.gauss(0, 1) for _ in range(64)]
    ids = rng.sample(range(1500), 1500)
    rows = [(i, one if i % 3 else [rng.gauss(0, 1) for _ in range(64)]) for i in ids]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(0, one)], "query_id long, vector array<double>")
    got = vectors.top_k_each(points, asked, "embedding", "vec_id").orderBy("place").collect()
    assert [r["id"] for r in got] == [i for i in range(18) if i % 3]


def test_windows_are_disjoint(spark):
    rows = [("f", random.Random(i).randint(1, 300), 0) for i in range(30)]
    df = spark.createDataFrame([(f, a, a + 3) for f, a, _ in rows], "f string, start int, end int")
    got = sorted((r["start"], r["end"]) for r in windows.merge_windows(df, ["f"], F.lit(310), most=99).collect())
    assert all(b[0] > a[1] + 6 for a, b in zip(got, got[1:], strict=False)) and got[0][0] >= 1 and got[-1][1] <= 310


def test_governor_never_exceeds_its_window(spark):
    rng = random.Random(7)
    rows = [(1, i, rng.uniform(0, 300), rng.randint(50, 400)) for i in range(200)]
    out = jobs.admit(spark.createDataFrame(rows, "k int, request_id int, at double, tokens int"), "k", 1000, 45.0).filter("started IS NOT NULL").collect()
    for r in out:
        assert r["waited"] <= 45
        assert sum(o["tokens"] for o in out if 0 <= r["started"] - o["started"] < 60) <= 1000


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, born string")
    new = spark.createDataFrame([(2, "c", "z"), (3, "d", "w")], "id int, v string, born string")
    assert sorted(map(tuple, upserts.upsert(old, new, ["id"]).collect())) == [(1, "a", "x"), (2, "c", "z"), (3, "d", "w")]
    assert sorted(map(tuple, upserts.upsert_defaults(old, new, ["id"], ["born"]).collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "w")]
    assert upserts.drop_generation(old, F.lit(True), "v", "").count() == 2 and upserts.drop_generation(old, F.lit(True), "v", "a").count() == 1
    got = spark.range(1).select(upserts.append_bounded(F.array(*[F.lit(i) for i in range(5)]), F.lit(9), 3)).first()[0]
    assert got == [3, 4, 9]


def test_event_rules(spark):
    got = {r["delivery_id"]: r for r in QUERIES["event_routing"](spark, "").collect()}
    assert len(got) == 17  # one delivery came twice
    assert {k: r["outcome"] for k, r in got.items() if r["outcome"] != "ignored"} == {"d01": "processed", "d04": "queued", "d09": "queued", "d11": "queued", "d13": "queued", "d15": "processed", "d17": "processed"}
    assert (got["d04"]["n_added"], got["d04"]["n_modified"], got["d04"]["n_removed"]) == (1, 1, 2)
    assert got["d02"]["reason"] == "push to other, indexed main" and got["d10"]["reason"] == "draft" and got["d14"]["reason"] == "unhandled event star"


def test_signatures(spark):
    sign = lambda b: "sha256=" + hmac.new(b"k", b.encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("1", "{}", sign("{}")), ("2", "{}", "sha256=bad"), ("3", "{}", None)], "id string, payload string, signature string")
    assert [r["id"] for r in events.verified(rows, "k").collect()] == ["1"]


def test_streams(spark, tmp_path):
    schema = "delivery_id string, event string, payload string, received_at timestamp"
    rows = spark.createDataFrame(X.DELIVERIES, "delivery_id string, event string, payload string, received_at string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    rows.write.json(str(tmp_path / "in"))
    repos = X.frame(spark, X.REPOSITORIES, "full_name string, indexing_status string, indexed_branch string, default_branch string")
    stream = events.route(events.once(spark.readStream.schema(schema).json(str(tmp_path / "in"))), repos)
    seen = []
    q = events.sync(stream, lambda df, n: seen.extend(r["delivery_id"] for r in df.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(seen) == ["d04", "d09"]


def test_status_stream(spark, tmp_path):
    rows = [("a", "queued"), ("a", "queued"), ("a", "running"), ("a", "running"), ("a", "done")]
    spark.createDataFrame(rows, "job string, status string").coalesce(1).write.json(str(tmp_path / "in"))
    changed = events.status_stream(spark.readStream.schema("job string, status string").json(str(tmp_path / "in")), "job", "status")
    q = changed.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["status"] for r in spark.table("changes").collect()] == ["queued", "running", "done"]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    now = F.lit("2024-03-05 12:00:00").cast("timestamp")
    ago = lambda t: one(text.relative_time(F.lit(t).cast("timestamp"), now))
    assert [ago(t) for t in ("2024-03-05 11:59:30", "2024-03-05 11:00:00", "2024-03-02 12:00:00", "2023-03-01 00:00:00")] == ["just now", "1h ago", "3d ago", "1y ago"]
    assert [one(text.compact_number(F.lit(n))) for n in (9999, 12345, 2_000_000)] == ["9999", "12.3K", "2M"]
    assert one(text.branch_slug(F.lit("Fix the Login, please! for all users now"), F.lit("ab12"))) == "change/fix-the-login-please-for-all-ab12"
    assert one(text.branch_slug(F.lit("!!!"), F.lit("z"))) == "change/ai-change-z"
    assert one(text.doc_comment(F.lit("*\n * One.\n *\n * Two.\n "))) == "One. Two."
    assert one(text.embedding_text(F.lit("  "))) == " " and one(text.path_list(F.lit("a, b,,a "))) == ["a", "b"]
    assert one(text.numbered_windows(F.lit("a\nb\nc"), F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end"))))) == "--- lines 2-3 of 3 ---\n   2| b\n   3| c"
    assert one(paths.normalize(F.lit("a/./b/../../../c"))) == "../c" and one(paths.dirname(F.lit("x"))) == "."
    assert [one(paths.looks_binary(F.lit(s))) for s in ("plain\n", "a\0b", "\x01\x02\x03abc")] == [False, True, True]
    assert one(text.envelope(F.lit(" a "), F.lit(None).cast("string"), F.lit("b"))) == "a\n\nb"
    ids = [one(text.point_id(F.lit("r"), F.lit(x))) for x in ("a", "a", "b")]
    assert ids[0] == ids[1] != ids[2] and ids[0][14] == "5" and ids[0][19] in "89ab"


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.js").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    got = {r["path"]: r for r in tables.checkout(spark, str(tmp_path)).collect()}
    assert got["src/a.js"]["content"] == "x = 1\n" and got["b.bin"]["content"] is None
    pages = spark.createDataFrame([("r", 1, list(range(100))), ("r", 2, [1, 2]), ("r", 3, [9])], "repo string, page int, items array<int>")
    assert tables.landed_pages(pages, ["repo"]).count() == 102
    entries = spark.createDataFrame([("a", "s1", "YQpi\n")], "path string, sha string, c string")
    assert tables.blobs(entries.drop("c"), entries.select("sha", F.col("c").alias("content"))).first()["lines"] == 2


def test_fallback_pauses_after_a_refusal():
    class Failed(Exception):
        def __init__(self, code):
            self.code = code

    now, tries = [0.0], []

    def fail(code):
        def run():
            tries.append(code)
            raise Failed(code)

        return run

    f = tables.Fallback(clock=lambda: now[0])
    assert f.read(lambda: 1, fail("X")) == 1 and f.read(fail("NOT_FOUND"), lambda: 2) == 2
    for first, anonymous, expect in (("UPSTREAM", "NOT_FOUND", ["UPSTREAM"]), ("FORBIDDEN", "NOT_FOUND", ["FORBIDDEN", "NOT_FOUND"]), ("FORBIDDEN", "RATE_LIMIT", ["FORBIDDEN", "RATE_LIMIT"]), ("FORBIDDEN", "RATE_LIMIT", ["FORBIDDEN"])):
        tries.clear()
        with pytest.raises(Failed) as raised:
            f.read(fail(first), fail(anonymous))
        assert raised.value.code == first and tries == expect
    now[0] = 61
    assert f.read(fail("FORBIDDEN"), lambda: 3) == 3
