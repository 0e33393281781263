"""The query catalogue: each operator over the shared tables or an inline fixture, with the SQL that says the same.

Roles of the shared tables: documents are files (lang their language, source their directory), embeddings are chunk
vectors (label the tenant), page links are imports, events are deliveries and heartbeats, conversations are threads,
and the sales tables are a weighted graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import paths, text
from strataloom.functions import rules as R
from strataloom.operators import access, answers, chunking, grams, graph, impact, indexing, jobs, manifests, packing, patches, retrieval, review, rollups, selection, upserts, vectors, views, windows
from strataloom.operators.extract import analyze
from strataloom.operators.shuffles import Scratch
from strataloom.plans import fixtures as X
from strataloom.sources.tables import compare_trees, table
from strataloom.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return ", ".join(X._literal(w) for w in words)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the shape of the files table."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _docs(spark, sf_dir).select(path.alias("file_path"), F.col("lang").alias("language"), F.size(F.split("text", "\n")).alias("lines"), (F.col("doc_id") % 10 == 0).alias("is_test"))


_SQL_FILES = "(SELECT source || '/' || lang || '/doc' || doc_id || '.md' AS file_path, lang AS language, len(string_split(text, chr(10))) AS lines, doc_id % 10 = 0 AS is_test FROM documents)"

def _of_documents(spark: SparkSession, sf_dir: str, rows: X.Rows, schema: str) -> DataFrame:
    """Every document with one of the cases in turn: doc_id, source, lang, body and the case's columns."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.col("text").alias("body"))
    cases = X.frame(spark, [(i, *r) for i, r in enumerate(rows)], f"__k int, {schema}")
    return docs.withColumn("__k", F.pmod("doc_id", F.lit(len(rows))).cast("int")).join(F.broadcast(cases), "__k").drop("__k")


def _of_documents_sql(rows: X.Rows, schema: str) -> str:
    return f"(SELECT d.doc_id, d.source, d.lang, d.text AS body, t.* EXCLUDE (k_) FROM documents d JOIN (SELECT * FROM {X.values([(i, *r) for i, r in enumerate(rows)], 'k_ int, ' + schema)}) t ON t.k_ = d.doc_id % {len(rows)})"


# -- similarity ---------------------------------------------------------------


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::double[], q.v) AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.15)
SELECT query_id, id, round(score, 6) AS score FROM r WHERE place <= 12""")
def vector_topk(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    queries = points.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.top_k_each(points, queries, "embedding", "vec_id").select("query_id", "id", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_cosine_similarity(embedding::double[], v), 6) AS score FROM embeddings, q
WHERE label = 3 AND vec_id <> 0 AND list_cosine_similarity(embedding::double[], v) >= -1 ORDER BY list_cosine_similarity(embedding::double[], v) DESC, vec_id LIMIT 12""")
def vector_topk_tenant(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    asked = points.filter("vec_id = 0").first()
    others = vectors.scope(points, "label", 3, not_vec_id=0)
    if asked is None:  # nothing is asked for
        return others.filter(F.lit(False)).select("vec_id", "label", F.lit(0.0).alias("score"))
    return vectors.top_k(others, asked["embedding"], "embedding", "vec_id", floor=-1.0).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS norm, round(list_cosine_similarity(embedding::double[], embedding[2:] :: double[] || [0.0::double]), 6) AS shifted FROM embeddings")
def vector_math(spark, sf_dir):
    v = F.col("embedding")
    moved = F.concat(F.slice(v, F.lit(2), F.size(v) - 1), F.array(F.lit(0.0).cast("float")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.cosine(v, moved), 6).alias("shifted"))


# -- roll-ups -----------------------------------------------------------------


@query(f"SELECT language, count(*) AS files, sum(lines)::bigint AS lines FROM {_SQL_FILES} GROUP BY language")
def language_rollup(spark, sf_dir):
    return rollups.by_language(_files(spark, sf_dir))


@query(f"SELECT split_part(file_path, '/', 1) AS directory, count(*) AS files, sum(lines)::bigint AS lines FROM {_SQL_FILES} GROUP BY 1 ORDER BY files DESC, directory LIMIT 12")
def directory_rollup(spark, sf_dir):
    return rollups.by_directory(_files(spark, sf_dir))


@query(f"SELECT count(*) AS files, count_if(is_test) AS test_files, sum(lines)::bigint AS lines, 0::bigint AS routes FROM {_SQL_FILES}")
def facts_overview(spark, sf_dir):
    return rollups.totals(_files(spark, sf_dir).withColumn("routes", F.array()))


@query(f"""
WITH f AS (SELECT *, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS module FROM {_SQL_FILES})
SELECT module, count(*) AS files, sum(lines)::bigint AS lines, count(DISTINCT language) AS n_languages FROM f GROUP BY module ORDER BY files DESC, module LIMIT 40""")
def module_nodes(spark, sf_dir):
    files = _files(spark, sf_dir).withColumns({"symbol_count": F.lit(0), "routes": F.array()})
    return rollups.modules(files).select("module", "files", "lines", F.size("languages").cast("long").alias("n_languages"))


@query(r"""
WITH l AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS target FROM pages)
SELECT site AS source, target, count(*) AS weight FROM l WHERE site <> target GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 120""")
def module_links(spark, sf_dir):
    site = F.regexp_extract("url", "^https?://([^/]+)", 1)
    links = table(spark, sf_dir, "pages").select(site.alias("site"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1))).alias("target"))
    file = lambda c: F.concat(c, F.lit("/page"))
    return rollups.module_links(links.select(F.lit("imports").alias("type"), F.lit(False).alias("external"), file("site").alias("from_file"), file("target").alias("to_file")))


@query("""
WITH l AS (SELECT 'c' || c.c_nationkey AS source, 's' || s.s_nationkey AS target, count(*) AS weight FROM lineitem i JOIN orders o ON i.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON i.l_suppkey = s.s_suppkey GROUP BY ALL),
o AS (SELECT source AS node, sum(weight)::bigint AS n_out FROM l GROUP BY 1), i AS (SELECT target AS node, sum(weight)::bigint AS n_in FROM l GROUP BY 1),
b AS (SELECT coalesce(o.node, i.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM o FULL JOIN i ON o.node = i.node),
r AS (SELECT *, CASE WHEN n_in = 0 AND n_out > 0 THEN 0 WHEN n_out = 0 THEN 2 ELSE 1 END AS layer FROM b)
SELECT node, n_in, n_out, layer, place FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n_in + n_out DESC, node) AS place FROM r) WHERE place <= 12""")
def layered_degree(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    links = lines.groupBy(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("target")).agg(F.count("*").alias("weight"))
    return graph.degree_layers(links)


@query(r"""
WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS u FROM pages),
x AS (SELECT u, string_split(u, '/') AS s, unnest(range(1, len(string_split(u, '/')) + 1)) AS n FROM p)
SELECT array_to_string(s[1:n], '/') AS path, s[n] AS name, array_to_string(s[1:n - 1], '/') AS parent, bool_or(n = len(s)) AS is_file FROM x GROUP BY 1, 2, 3""")
def url_prefix_tree(spark, sf_dir):
    return rollups.path_tree(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("file_path")))


@query(f"""
WITH f AS (SELECT path FROM (SELECT 'd' || doc_id || '/' || path AS path FROM {_of_documents_sql(X.TREE, X.TREE_SCHEMA)}))
SELECT path AS file_path FROM f WHERE regexp_matches(path, '(?i)(^|/)(server|app|main|index)\\.(js|jsx|mjs|cjs|ts|tsx)$') OR regexp_matches(path, '(?i)(^|/)main\\.(py|go|rs|java|kt)$') OR regexp_matches(path, '(?i)(^|/)manage\\.py$') OR regexp_matches(path, '(?i)(^|/)cmd/[^/]+/main\\.go$')
ORDER BY len(string_split(path, '/')), path LIMIT 8""")
def entry_points(spark, sf_dir):
    return rollups.entry_points(_trees(spark, sf_dir).withColumnRenamed("path", "file_path"))


# -- joins and sets -----------------------------------------------------------


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END, 'unlabelled') AS state, l.doc_id IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""".replace("coalesce(CASE", "coalesce(CASE WHEN l.doc_id IS NULL THEN 'unlabelled'"))
def enrich_left(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    out = _docs(spark, sf_dir).select("doc_id").join(labels, "doc_id", "left")
    state = F.when(F.col("labelled").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), state.alias("state"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("SELECT source, count(*) AS unlabelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source")
def neighbours_anti(spark, sf_dir):
    return upserts.drop_keys(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("unlabelled"))


@query("""
WITH f AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1), n AS (SELECT DISTINCT l_suppkey FROM lineitem SEMI JOIN f USING (l_partkey) WHERE l_suppkey <> 1)
SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS parts FROM lineitem SEMI JOIN f USING (l_partkey) WHERE l_suppkey <> 1 GROUP BY 1""")
def two_hop_neighbours(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    focus = lines.filter("l_suppkey = 1").select("l_partkey").distinct()
    near = lines.join(focus, "l_partkey", "left_semi").filter("l_suppkey <> 1")
    return near.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passage_contains(spark, sf_dir):
    scratch = Scratch(spark, "passages")
    return grams.containing(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text", scratch, size=16).select(F.col("id").alias("doc_id")).distinct()


@query("""
WITH s AS (SELECT conv_id::varchar AS file_path, role || turn AS name, (turn * 9 + 1)::int AS start_line FROM conversations), m AS (SELECT file_path, max(start_line) AS last FROM s GROUP BY 1),
c AS (SELECT file_path, unnest(range(1, last + 1, 10)) AS a FROM m),
j AS (SELECT s.file_path, s.name, s.start_line, c.a AS chunk_start, c.a + 14 AS chunk_end, row_number() OVER (PARTITION BY s.file_path, s.name, s.start_line ORDER BY c.a) AS n FROM s JOIN c ON s.file_path = c.file_path AND c.a <= s.start_line + 2 AND c.a + 14 >= s.start_line)
SELECT file_path, name, start_line, chunk_start::int AS chunk_start, chunk_end::int AS chunk_end FROM j WHERE n = 1""")
def containment_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    symbols = turns.select(F.col("conv_id").cast("string").alias("file_path"), F.concat("role", F.col("turn").cast("string")).alias("name"), (F.col("turn") * 9 + 1).cast("int").alias("start_line"))
    last = symbols.groupBy("file_path").agg(F.max("start_line").alias("last"))
    chunks = last.select("file_path", F.explode(F.sequence(F.lit(1), "last", F.lit(10))).alias("start_line")).withColumn("end_line", F.col("start_line") + 14)
    out = retrieval.covering_chunk(symbols, chunks)
    return out.select("file_path", "name", "start_line", F.col("c_start_line").alias("chunk_start"), F.col("c_end_line").alias("chunk_end"))


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 35 = 0)
SELECT coalesce(a.doc_id, b.doc_id)::varchar AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.sha IS DISTINCT FROM b.sha""")
def tree_compare(spark, sf_dir):
    docs, path = _docs(spark, sf_dir), F.col("doc_id").cast("string").alias("path")
    base = docs.filter("doc_id % 7 <> 0").select(path, F.sha2("text", 256).alias("sha"))
    head = docs.filter("doc_id % 5 <> 0 OR doc_id % 35 = 0").select(path, F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return compare_trees(base, head)


# -- packing ------------------------------------------------------------------


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT source, 0::bigint AS n, 0::bigint AS used, 0 AS taken, NULL::bigint AS doc_id, false AS take FROM (SELECT DISTINCT source FROM d)
UNION ALL SELECT d.source, d.n, used + CASE WHEN used + n_chars + 120 > 16000 AND taken >= 4 THEN 0 ELSE n_chars + 120 END, taken + CASE WHEN used + n_chars + 120 > 16000 AND taken >= 4 THEN 0 ELSE 1 END, d.doc_id, NOT (used + n_chars + 120 > 16000 AND taken >= 4) FROM f JOIN d ON d.source = f.source AND d.n = f.n + 1)
SELECT source, doc_id, n_chars FROM f JOIN documents USING (source, doc_id) WHERE take""")
def budget_pack(spark, sf_dir):
    return packing.pack_context(_docs(spark, sf_dir).select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 16_000)


@query("""
SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::bigint AS used FROM documents) WHERE used <= 20000""")
def diff_pack_prefix(spark, sf_dir):
    return packing.pack_prefix(_docs(spark, sf_dir).select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), 20_000).select("source", "doc_id", "used")


# -- file selection -----------------------------------------------------------

#: The tree of each source: a file a document.
_T = f"(SELECT source, 'd' || doc_id || '/' || path AS path, size FROM {_of_documents_sql(X.TREE, X.TREE_SCHEMA)}) AS t"


def _trees(spark, sf_dir) -> DataFrame:
    own = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), "path")
    return _of_documents(spark, sf_dir, X.TREE, X.TREE_SCHEMA).select("source", own.alias("path"), "size")


_BASE = "regexp_extract(path, '[^/]*$')"
_EXT_SQL = "regexp_extract(regexp_extract(lower(path), '[^/]*$'), '[^.].*?(\\.[^.]*)$', 1)"
_MAP = lambda m: "MAP {" + ", ".join(f"{X._literal(k)}: {X._literal(v)}" for k, v in m.items()) + "}"
_LANG = f"coalesce({_MAP(R.NAME_LANGUAGE)}[lower({_BASE})], {_MAP(R.EXT_LANGUAGE)}[{_EXT_SQL}], 'text')"
_BAD = f"list_filter(string_split(path, '/')[1:-2], lambda s: s IN ({_in(R.IGNORED_DIRS)}) OR (starts_with(s, '.') AND s <> '.github'))"
_REASON = f"""CASE WHEN len({_BAD}) > 0 THEN 'ignored-dir:' || {_BAD}[1] WHEN {_BASE} IN ({_in(R.LOCK_FILES)}) THEN 'lock-file' WHEN regexp_matches(lower(path), '\\.min\\.(js|css)$|\\.d\\.ts$|\\.(map|snap)$') THEN 'generated'
 WHEN {_EXT_SQL} IN ({_in(R.IGNORED_EXTS)}) THEN 'binary:' || {_EXT_SQL} WHEN starts_with({_BASE}, '.') AND {_BASE} NOT IN ({_in(R.DOTFILES)}) THEN 'dotfile' WHEN size > 180000 THEN 'too-large' WHEN size = 0 THEN 'empty'
 WHEN {_LANG} = 'text' AND NOT regexp_matches(lower(path), '\\.(txt|md)$') THEN 'unknown-language' END"""
_TEST = " OR ".join(f"regexp_matches(path, {X._literal(p)})" for p in R.TEST_PATHS)
_SCORE = f"""(CASE WHEN {_BASE} IN ({_in(R.MANIFEST_NAMES)}) THEN 55 ELSE 0 END + CASE WHEN regexp_matches(path, {X._literal(R.ENTRY_NAMES)}) THEN 45 ELSE 0 END + CASE WHEN regexp_matches(path, {X._literal(R.VALUABLE_DIRS)}) THEN 35 ELSE 0 END
 + CASE WHEN {_LANG} IN ({_in(R.SOURCE_LANGUAGES)}) THEN 70 WHEN {_LANG} IN ({_in(R.MARKUP_LANGUAGES)}) THEN 40 WHEN {_LANG} = 'markdown' THEN 6 WHEN {_LANG} IN ({_in(R.CONFIG_LANGUAGES)}) THEN 3 ELSE 0 END - CASE WHEN {_TEST} THEN 12 ELSE 0 END
 - CASE WHEN regexp_matches(path, {X._literal(R.SIDE_DIRS)}) THEN 30 ELSE 0 END - CASE WHEN regexp_matches({_BASE}, {X._literal(R.SIDE_NAMES)}) THEN 25 ELSE 0 END - least(20, 2 * len(string_split(path, '/'))) - CASE WHEN size > 60000 THEN 15 ELSE 0 END)"""


@query(f"""
WITH t AS (SELECT t.* FROM {_T}), c AS (SELECT source, path, {_REASON} AS reason, {_LANG} AS lang, {_SCORE} AS score, {_TEST} AS is_test FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source, reason IS NULL ORDER BY score DESC, path) AS n FROM c)
SELECT source, path, CASE WHEN reason IS NULL AND n > 9 THEN 'over-max-files' ELSE reason END AS reason, CASE WHEN reason IS NULL THEN lang END AS language, CASE WHEN reason IS NULL THEN score END AS score, is_test, reason IS NULL AND n <= 9 AS selected FROM r""")
def file_select(spark, sf_dir):
    rows = selection.select_files(_trees(spark, sf_dir), ["source"], max_files=9)
    return rows.select("source", "path", "reason", "language", "score", paths.is_test_path(F.col("path")).alias("is_test"), "selected")


# -- windows and event logic ----------------------------------------------------


@query("""
WITH r AS (SELECT DISTINCT user_id, greatest(1, hour(ts) * 60 - 15) AS a, least(1440, hour(ts) * 60 + 15) AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT user_id, min(a)::int AS "start", max(b)::int AS "end" FROM g GROUP BY user_id, n HAVING n <= 4""")
def merge_windows(spark, sf_dir):
    minute = F.hour("ts") * 60
    ranges = table(spark, sf_dir, "events").select("user_id", minute.alias("start"), minute.alias("end")).distinct()
    return windows.merge_windows(ranges, ["user_id"], F.lit(1440)).select("user_id", "start", "end")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return windows.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT conv_id, turn, role, substr(text, 1, 700) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def history_last4(spark, sf_dir):
    rows = windows.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 4)
    return rows.select("conv_id", "turn", "role", F.substring("text", 1, 700).alias("text"))


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 4) AS used FROM events""")
def sliding_tokens(spark, sf_dir):
    return windows.sliding_sum(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 3600).select("event_id", F.round("used", 4).alias("used"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY ALL")
def first_wins_dedup(spark, sf_dir):
    return windows.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def status_changes(spark, sf_dir):
    return windows.status_changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("event_id", "user_id", "event_type")


@query("SELECT user_id, (floor(epoch_us(ts) / 600000000) * 600)::bigint AS window_start, count(*) AS n, greatest(0, count(*) - 2) AS rejected FROM events GROUP BY 1, 2")
def fixed_rate_limit(spark, sf_dir):
    return windows.fixed_rate(table(spark, sf_dir, "events"), ["user_id"], "ts", 600, 2)


@query("""
WITH h AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, beat < now - INTERVAL 10 MINUTE AS stuck, beat < now - INTERVAL 14 DAY AS forgotten, CASE WHEN epoch(now) - epoch(beat) >= 86400 THEN 'days' WHEN epoch(now) - epoch(beat) >= 3600 THEN 'hours' ELSE 'minutes' END AS age FROM h, n""")
def stale_heartbeat(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    beats = events.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("beat"))
    rows = beats.join(F.broadcast(events.agg(F.max("ts").cast("timestamp").alias("now"))))
    ago = text.relative_time(F.col("beat"), F.col("now"))
    age = F.when(ago.rlike("(y|mo|w|d) ago$"), "days").when(ago.rlike("h ago$"), "hours").otherwise("minutes")
    return rows.select("user_id", windows.stale(F.col("beat"), F.col("now"), 10).alias("stuck"), windows.stale(F.col("beat"), F.col("now"), 14 * 1440).alias("forgotten"), age.alias("age"))


@query("""
WITH o AS (SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT e.user_id, e.event_id AS job_id, e.event_type AS status FROM events e SEMI JOIN (SELECT event_id FROM events WHERE event_type IN ('click', 'view') ORDER BY ts, event_id LIMIT 1) q ON e.event_id = q.event_id""")
def claim_oldest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type IN ('click', 'view')").select("user_id", F.col("event_id").alias("job_id"), "event_type", F.col("ts").cast("timestamp").alias("created_at"))
    queue = rows.withColumns({"status": F.lit("queued"), "attempts": F.lit(0), "locked_by": F.lit(""), "heartbeat_at": F.col("created_at")})
    return jobs.claim(queue, F.lit("2030-01-01").cast("timestamp"), "w").filter("status = 'running'").select("user_id", "job_id", F.col("event_type").alias("status"))


# -- text functions -----------------------------------------------------------


@query("SELECT substr(sha256(text), 1, 40) AS content_sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dups(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", text.content_sha(F.col("text")).alias("content_sha"))
    return docs.groupBy("content_sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""
WITH h AS (SELECT doc_id, sha1(source || '|' || lang || '|' || doc_id || '|' || n_chars) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.point_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("point_id"))


@query(f"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x) NOT IN ({_in(R.QUESTION_WORDS)})) AS x FROM documents),
k AS (SELECT doc_id, x, list_transform(x, lambda y: lower(y)) AS k FROM t),
f AS (SELECT doc_id, list_filter(x, lambda y, i: list_position(k, lower(y)) = i) AS x FROM k)
SELECT doc_id, array_to_string(list_filter(x, lambda y: regexp_matches(substr(y, 2), '[A-Z]') OR contains(y, '_') OR length(y) > 5)[1:8], ',') AS names FROM f""")
def identifiers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.identifiers(F.col("text")), ",").alias("names"))


@query("SELECT doc_id, ceil(length(text) / 3.6::double)::bigint AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("""
WITH l AS (SELECT DISTINCT n_chars AS tpm FROM documents), b AS (SELECT tpm, greatest(2000, tpm) AS lim, greatest(1200, greatest(2000, tpm) - 400) AS usable FROM l), o AS (SELECT *, least(4096, floor(usable * 0.35::double + 0.5::double)::bigint) AS out FROM b)
SELECT tpm, lim AS "limit", usable - out AS input_tokens, out AS output_tokens, floor((usable - out) * 3.6::double + 0.5::double)::bigint AS input_chars, greatest(1000, floor(tpm * 0.95::double + 0.5::double)::bigint) AS window_limit FROM o""")
def token_budgets(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("n_chars").alias("tpm")).distinct()
    return rows.select("tpm", F.inline(F.array(text.token_budget(F.col("tpm")))), jobs.token_limit(F.col("tpm")).alias("window_limit"))


@query("SELECT event_id, (props->>'$.k')::bigint AS k, CASE WHEN json_valid(props) THEN 'ok' ELSE 'broken' END AS state FROM events")
def json_props(spark, sf_dir):
    found = text.outermost_json(F.concat(F.lit("noise "), F.col("props"), F.lit(" more")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"), F.when(found.isNotNull(), "ok").otherwise("broken").alias("state"))


@query(f"""
WITH t AS (SELECT doc_id, body || ' ' || t AS t FROM {_of_documents_sql(X.PROSE, X.TEXTS_SCHEMA)}), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z0-9_./@-]+\\.[A-Za-z0-9]+:\\d+(?:-\\d+)?')) AS x FROM t)
SELECT doc_id, regexp_extract(x, '^(.*?):', 1) AS path, regexp_extract(x, ':(\\d+)', 1)::int AS first, nullif(regexp_extract(x, '-(\\d+)$', 1), '')::int AS last FROM m""")
def citations_regex(spark, sf_dir):
    rows = _of_documents(spark, sf_dir, X.PROSE, X.TEXTS_SCHEMA)
    return rows.select("doc_id", F.inline(text.mentions(F.concat("body", F.lit(" "), "t"))))


def _scrub_sql() -> str:
    out = "t || ' ' || body"
    for p in R.SECRETS:
        out = f"regexp_replace({out}, {X._literal(p)}, '[redacted]', 'g')"
    return f"SELECT doc_id, {out} AS scrubbed FROM {_of_documents_sql(X.LOGS, X.TEXTS_SCHEMA)}"


@query(_scrub_sql())
def secret_scrub(spark, sf_dir):
    rows = _of_documents(spark, sf_dir, X.LOGS, X.TEXTS_SCHEMA)
    return rows.select("doc_id", text.scrub_secrets(F.concat("t", F.lit(" "), "body")).alias("scrubbed"))


@query("""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x, i: lpad(i::varchar, 4, ' ') || '| ' || x), chr(10)) AS numbered, array_to_string(l[3:7], chr(10)) AS part FROM t""")
def numbered_lines(spark, sf_dir):
    body = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.numbered(body).alias("numbered"), text.line_slice(body, F.lit(3), F.lit(7)).alias("part"))


@query(f"""
WITH b AS (SELECT * FROM {_of_documents_sql(X.BRANCHES, X.TEXTS_SCHEMA)}), p AS (SELECT * FROM {_of_documents_sql(X.PATHS, X.TEXTS_SCHEMA)}), q AS (SELECT doc_id, regexp_replace(trim(t), '^\\./', '') AS v FROM p)
SELECT 'branch' AS kind, doc_id, (length(t) BETWEEN 1 AND 240 AND NOT regexp_matches(t, '^\\.|\\.\\.|[~^:?*\\[\\\\\\s]|//|/$|\\.lock$|@\\{{'))::varchar AS verdict FROM b
UNION ALL SELECT 'path', doc_id, CASE WHEN v = '' THEN 'missing' WHEN starts_with(v, '/') OR regexp_matches(v, '^[A-Za-z]:') THEN 'absolute' WHEN contains(v, '\\') THEN 'backslash' WHEN len(list_filter(string_split(v, '/'), lambda x: x IN ('..', '.', ''))) > 0 THEN 'segment' WHEN split_part(v, '/', 1) = '.git' THEN 'internals' WHEN length(v) > 400 THEN 'too-long' ELSE 'ok' END FROM q""")
def name_checks(spark, sf_dir):
    branches = _of_documents(spark, sf_dir, X.BRANCHES, X.TEXTS_SCHEMA).select(F.lit("branch").alias("kind"), "doc_id", text.safe_branch(F.col("t")).cast("string").alias("verdict"))
    checked = _of_documents(spark, sf_dir, X.PATHS, X.TEXTS_SCHEMA).select(F.lit("path").alias("kind"), "doc_id", F.coalesce(paths.unsafe_path(F.col("t")), F.lit("ok")).alias("verdict"))
    return branches.unionByName(checked)


@query(f"""
WITH a AS (SELECT doc_id, regexp_replace(trim(t), '^git\\+', '') AS v, t FROM {_of_documents_sql(X.REPOS, X.TEXTS_SCHEMA)}), b AS (SELECT doc_id, t, regexp_replace(regexp_replace(v, '^git@github\\.com:', 'https://github.com/'), '(?i)^github\\.com/', 'https://github.com/') AS v FROM a),
c AS (SELECT doc_id, v, regexp_matches(v, '(?i)^https?://') AS url, lower(regexp_extract(v, '(?i)^https?://([^/:?#]*)', 1)) AS site, list_filter(string_split(CASE WHEN regexp_matches(v, '(?i)^https?://') THEN regexp_extract(v, '(?i)^https?://[^/?#]*([^?#]*)', 1) ELSE v END, '/'), lambda x: x <> '') AS p FROM b),
d AS (SELECT *, coalesce(p[1], '') AS o, regexp_replace(coalesce(p[2], ''), '(?i)\\.git$', '') AS r FROM c),
e AS (SELECT *, CASE WHEN v = '' THEN 'empty' WHEN url AND site NOT IN ('github.com', 'www.github.com') THEN 'host' WHEN url AND len(p) < 2 THEN 'incomplete' WHEN NOT url AND len(p) <> 2 THEN 'format' WHEN NOT regexp_matches(o, '^[A-Za-z0-9][A-Za-z0-9-]{{0,38}}$') THEN 'owner' WHEN NOT regexp_matches(r, '^[A-Za-z0-9._-]{{1,100}}$') THEN 'name' END AS error FROM d)
SELECT doc_id, CASE WHEN error IS NULL THEN o END AS owner, CASE WHEN error IS NULL THEN r END AS repo, CASE WHEN error IS NULL AND url AND p[3] IN ('tree', 'blob') THEN p[4] END AS branch, error FROM e""")
def repo_identity(spark, sf_dir):
    return _of_documents(spark, sf_dir, X.REPOS, X.TEXTS_SCHEMA).select("doc_id", F.inline(F.array(text.repo_identity(F.col("t")))))


@query(f"""
WITH a AS (SELECT event_id, trim(CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done' WHEN 2 THEN replace(props, '}}', ',}}') WHEN 3 THEN 'text ' || props || ' more' WHEN 4 THEN replace(props, '}}', '') ELSE event_type END) AS t FROM events), b AS (SELECT event_id, CASE WHEN regexp_matches(t, '```(json)?\\s*[\\s\\S]*?```') THEN regexp_extract(t, '```(?:json)?\\s*([\\s\\S]*?)```', 1) ELSE t END AS t FROM a),
c AS (SELECT event_id, regexp_extract(t, '(\\{{[\\s\\S]*\\}})', 1) AS whole FROM b), d AS (SELECT *, regexp_replace(whole, ',\\s*([}}\\]])', '\\1', 'g') AS mended FROM c)
SELECT event_id, CASE WHEN whole <> '' AND whole = mended AND json_valid(whole) THEN whole WHEN mended <> '' AND json_valid(mended) THEN mended END AS json FROM d""")
def noisy_json(spark, sf_dir):
    props, kind = F.col("props"), F.col("event_id") % 6
    fenced = F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```\nDone"))
    said = F.when(kind == 0, props).when(kind == 1, fenced).when(kind == 2, F.replace(props, F.lit("}"), F.lit(",}"))).when(kind == 3, F.concat(F.lit("text "), props, F.lit(" more"))).when(kind == 4, F.replace(props, F.lit("}"), F.lit(""))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.outermost_json(said).alias("json"))


@query("""
SELECT doc_id, upper(substr(s, 1, 1)) || substr(s, 2) AS subject FROM (SELECT doc_id, CASE WHEN length(f) > 68 THEN substr(f, 1, 65) || '...' ELSE f END AS s FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS f FROM documents))""")
def commit_subjects(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.commit_subject(F.col("text")).alias("subject"))


# -- chunking -----------------------------------------------------------------


@query("""
WITH u AS (SELECT doc_id, string_split(text, chr(10)) AS l, length(text) AS c FROM documents),
s AS (SELECT doc_id, l, len(l) AS n, CASE WHEN c <= 1800 THEN len(l) ELSE greatest(12, ceil(len(l)::double / ceil(c / 1800.0::double)))::int END AS step, c <= 1800 AS whole FROM u),
r AS (SELECT *, unnest(range(1, n + 1, step)) AS a FROM s), e AS (SELECT *, CASE WHEN whole THEN n ELSE least(n, a + step - 1 + 2) END AS b FROM r), k AS (SELECT doc_id, a, b, array_to_string(l[a:b], chr(10)) AS code FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS part, a AS start_line, b AS end_line, length(code) AS n_chars FROM k WHERE length(trim(code, ' ' || chr(9) || chr(10) || chr(13))) >= 40""")
def line_split_chunks(spark, sf_dir):
    return chunking.size_parts(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "part", "start_line", "end_line", F.length("code").alias("n_chars"))


@query("""
WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
f AS (SELECT doc_id, 0 AS i, 1 AS a, -1 AS size, false AS done, 0 AS s, 0 AS e FROM t
UNION ALL SELECT f.doc_id, i + 1, CASE WHEN full_ THEN i + 2 ELSE a END, CASE WHEN full_ THEN -1 ELSE now END, full_ OR i + 1 = n, a, i + 1
 FROM (SELECT f.*, len(l) AS n, size + 1 + length(l[i + 1]) AS now, size + 1 + length(l[i + 1]) >= 1800 OR (coalesce(regexp_matches(l[i + 2], '^#{1,3}\\s'), false) AND size + 1 + length(l[i + 1]) > 300) AS full_ FROM f JOIN t ON f.doc_id = t.doc_id WHERE i < len(l)) AS f)
SELECT f.doc_id, s AS start_line, e AS end_line FROM f JOIN t ON f.doc_id = t.doc_id WHERE done AND length(trim(array_to_string(l[s:e], chr(10)), ' ' || chr(9) || chr(10) || chr(13))) >= 40""")
def prose_chunks(spark, sf_dir):
    return chunking.prose_chunks(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "start_line", "end_line")


# -- the graph ------------------------------------------------------------------

_EXTS = "['" + "', '".join(R.IMPORT_EXTS) + "']"


@query(f"""
WITH f AS (SELECT t.* FROM {X.values(X.IMPORT_FILES, "p string")}), c AS (SELECT t.* FROM {X.values(X.IMPORT_CASES, X.IMPORT_CASES_SCHEMA)}),
d AS (SELECT *, CASE WHEN starts_with(raw, '/') THEN ltrim(raw, '/') ELSE regexp_replace(file_path, '[^/]*$', '') || raw END AS joined FROM c),
n1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(joined, '/\\./', '/', 'g'), '[^/]+/\\.\\./', ''), '^\\./', '') AS j1 FROM d),
n2 AS (SELECT *, regexp_replace(j1, '[^/]+/\\.\\./', '') AS base FROM n1),
k AS (SELECT *, [base] || list_transform({_EXTS}, lambda e: base || e) || list_transform({_EXTS}, lambda e: regexp_replace(base, '\\.(js|jsx|mjs|cjs)$', '') || e) || list_transform({_EXTS}, lambda e: base || '/index' || e) AS tries FROM n2),
t AS (SELECT file_path, raw, unnest(tries) AS t, unnest(range(len(tries))) AS i FROM k WHERE NOT is_external), m AS (SELECT file_path, raw, min_by(t, i) AS resolved FROM t JOIN f ON t.t = f.p GROUP BY ALL)
SELECT c.file_path, c.raw, coalesce(resolved, '') AS resolved, resolved IS NULL AS is_external FROM c LEFT JOIN m ON c.file_path = m.file_path AND c.raw = m.raw""")
def import_resolution(spark, sf_dir):
    files = X.frame(spark, X.IMPORT_FILES, "file_path string")
    return graph.resolve_imports(X.frame(spark, X.IMPORT_CASES, X.IMPORT_CASES_SCHEMA), files).select("file_path", "raw", "resolved", "is_external")


@query(f"""
WITH s AS (SELECT t.* FROM {X.values(X.SYMBOLS, X.SYMBOLS_SCHEMA)}), c AS (SELECT t.* FROM {X.values(X.CALLS, X.CALLS_SCHEMA.replace("to string", "callee string"))}), i AS (SELECT t.* FROM {X.values(X.IMPORTED, "file_path string, resolved string")}),
x AS (SELECT DISTINCT k, file_path AS f, qualified_name AS q, start_line FROM (SELECT *, unnest([name, qualified_name]) AS k FROM s)),
h AS (SELECT c.call_id, c.file_path, x.*, EXISTS (SELECT 1 FROM i WHERE i.file_path = c.file_path AND i.resolved = x.f) AS imp FROM c JOIN x ON x.k = c.callee),
a AS (SELECT call_id, count(*) AS n, count_if(imp) AS m, min(CASE WHEN imp THEN {{'f': f, 'l': start_line, 'q': q}} END) AS im, min(CASE WHEN f = file_path THEN {{'f': f, 'l': start_line, 'q': q}} END) AS lo, min({{'f': f, 'l': start_line, 'q': q}}) AS an FROM h GROUP BY call_id),
p AS (SELECT call_id, CASE WHEN m > 0 THEN im WHEN lo IS NOT NULL THEN lo WHEN n = 1 THEN an END AS t, CASE WHEN m = 1 THEN 0.95 WHEN m > 1 THEN 0.6 WHEN lo IS NOT NULL THEN 0.85 WHEN n = 1 THEN 0.7 ELSE 0.35 END::double AS confidence FROM a)
SELECT c.call_id, coalesce(t.f, '') AS to_file, coalesce(t.q, '') AS to_symbol, coalesce(confidence, 0.3::double) AS confidence FROM c LEFT JOIN p ON c.call_id = p.call_id""")
def resolve_calls(spark, sf_dir):
    index = graph.symbol_index(X.frame(spark, X.SYMBOLS, X.SYMBOLS_SCHEMA))
    out = graph.resolve_calls(X.frame(spark, X.CALLS, X.CALLS_SCHEMA), index, X.frame(spark, X.IMPORTED, "file_path string, resolved string"))
    return out.select("call_id", "to_file", "to_symbol", "confidence")


def _fixture_impact(spark) -> impact.Impact:
    route = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/r"), i.cast("string")).alias("path"), F.lit("h").alias("handler"), i.alias("line")))
    files = X.frame(spark, X.FILES, X.FILES_SCHEMA).withColumn("routes", F.slice(route, F.lit(1), F.col("n_routes")))
    return impact.Impact(X.frame(spark, X.SYMBOLS, X.SYMBOLS_SCHEMA), X.frame(spark, X.EDGES, X.EDGES_SCHEMA), files, "charge()")


_IMPACT_SQL = f"""
WITH e AS (SELECT t.* FROM {X.values(X.EDGES, X.EDGES_SCHEMA)}), f AS (SELECT t.* FROM {X.values(X.FILES, X.FILES_SCHEMA)}),
c AS (SELECT e.*, coalesce(f.is_test, false) AS is_test FROM e LEFT JOIN f ON e.from_file = f.file_path WHERE type IN ('calls', 'tests') AND to_name = 'charge'),
r AS (SELECT from_file AS file_path, CASE WHEN is_test OR type = 'tests' THEN 1 WHEN confidence >= 0.7 THEN 3 ELSE 2 END AS rank, CASE WHEN is_test OR type = 'tests' THEN 'Tests charge' ELSE 'Calls charge()' END AS reason FROM c
UNION ALL SELECT from_file, 2, 'Imports ' || to_file FROM e WHERE type = 'imports' AND to_file = 'src/billing.js'
UNION ALL SELECT from_file, 2, 'Indirectly reaches charge' FROM e WHERE type = 'calls' AND to_name IN (SELECT from_symbol FROM c WHERE from_symbol NOT IN ('', '<module>'))
UNION ALL SELECT file_path, 3, 'Exposes an API route in the affected path' FROM (SELECT *, unnest(range(n_routes)) FROM f WHERE file_path = 'src/billing.js' OR file_path IN (SELECT from_file FROM c)))"""


@query(f"{_IMPACT_SQL} SELECT file_path, CASE max(rank) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS n_details, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM r WHERE file_path <> 'src/billing.js' GROUP BY file_path")
def impact_fixture(spark, sf_dir):
    return _fixture_impact(spark).impacts().select("file_path", "severity", F.size("details").cast("long").alias("n_details"), F.array_join(F.sort_array("reasons"), "|").alias("reasons"))


@query(f"""{_IMPACT_SQL},
s AS (SELECT file_path, max(rank) AS rank FROM r WHERE file_path <> 'src/billing.js' GROUP BY file_path)
SELECT (SELECT count(*) FROM (SELECT t.* FROM {X.values(X.SYMBOLS, X.SYMBOLS_SCHEMA)}) WHERE name = 'charge' OR qualified_name = 'charge') AS definitions, (SELECT count(*) FROM c WHERE type = 'calls') AS direct_callers, (SELECT count(*) FROM r WHERE starts_with(reason, 'Imports ')) AS importers,
 (SELECT count(*) FROM r WHERE starts_with(reason, 'Indirectly ')) AS second_hop, (SELECT count(DISTINCT from_file) FROM c WHERE is_test) AS tests, (SELECT count(*) FROM r WHERE starts_with(reason, 'Exposes ')) AS routes,
 (SELECT count(*) FROM s WHERE rank = 3) AS high, (SELECT count(*) FROM s WHERE rank = 2) AS medium, (SELECT count(*) FROM s WHERE rank = 1) AS low""")
def impact_counts(spark, sf_dir):
    return _fixture_impact(spark).counts()


@query(f"""{_IMPACT_SQL},
h AS (SELECT from_file, line, from_symbol AS caller FROM c WHERE type = 'calls' ORDER BY from_file, line, from_symbol LIMIT 12),
u AS (SELECT to_name AS caller, from_file AS up_file, CASE WHEN from_symbol = '' THEN '<module>' ELSE from_symbol END AS up, row_number() OVER (PARTITION BY to_name ORDER BY from_file, line, from_symbol) AS k FROM e WHERE type = 'calls' AND to_name IN (SELECT caller FROM h WHERE caller <> '')),
p AS (SELECT h.*, k, coalesce(up_file || ':' || up || ' → ', '') || from_file || ':' || CASE WHEN h.caller = '' THEN '<module>' ELSE h.caller END || ' → charge' AS call_path FROM h LEFT JOIN u ON u.caller = h.caller AND k <= 2)
SELECT call_path FROM p GROUP BY call_path ORDER BY min((from_file, line, k)) LIMIT 14""")
def impact_call_paths(spark, sf_dir):
    return _fixture_impact(spark).call_paths()


@query("""
WITH d AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1), s AS (SELECT l_suppkey, count(*) AS n, max(l_quantity) AS q FROM lineitem SEMI JOIN d USING (l_partkey) WHERE l_suppkey <> 1 GROUP BY 1),
h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM s)), r AS (SELECT l_suppkey, 3 AS rank, n FROM s WHERE q >= 50 UNION ALL SELECT l_suppkey, 2, n FROM s WHERE q < 50 UNION ALL SELECT l_suppkey, 1, count(*) FROM lineitem SEMI JOIN h USING (l_partkey) WHERE l_suppkey <> 1 GROUP BY 1)
SELECT l_suppkey AS supplier, CASE max(rank) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, sum(n)::bigint AS details FROM r GROUP BY 1 ORDER BY max(rank) DESC, details DESC, supplier LIMIT 40""")
def two_hop_impact(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = lines.filter("l_suppkey = 1").select("l_partkey").distinct()
    near = lines.join(parts, "l_partkey", "left_semi").filter("l_suppkey <> 1").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    hop = lines.join(near.select("l_suppkey"), "l_suppkey", "left_semi").select("l_partkey").distinct()
    second = lines.join(hop, "l_partkey", "left_semi").filter("l_suppkey <> 1").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    records = near.select("l_suppkey", F.when(F.col("q") >= 50, 3).otherwise(2).alias("rank"), "n").unionByName(second.select("l_suppkey", F.lit(1).alias("rank"), "n"))
    out = records.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.max("rank").alias("rank"), F.sum("n").alias("details"))
    return out.orderBy(F.desc("rank"), F.desc("details"), "supplier").limit(40).select("supplier", impact.severity_name(F.col("rank")).alias("severity"), "details")


@query("SELECT p_name AS name, p_brand AS file_path, p_partkey AS start_line FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_size > 25 DESC, p_size DESC, p_name, p_brand, p_partkey LIMIT 25")
def symbol_search(spark, sf_dir):
    symbols = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("start_line"), F.col("p_size").alias("loc"), (F.col("p_size") > 25).alias("exported"))
    return impact.search_symbols(symbols, "AN").select("name", "file_path", "start_line")


# -- indexing, review and lists ---------------------------------------------------


def _tree(spark):
    return demo_files(spark).select(F.col("file_path").alias("path"), F.octet_length("content").alias("size"), "content")


@query()
def index_full(spark, sf_dir):
    out = indexing.index_full(_tree(spark))
    parts = [out[name].groupBy(F.col(column).alias("file_path")).agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, column in indexing.FILE_OF.items()]
    return reduce(DataFrame.unionByName, parts)


@query()
def index_incremental(spark, sf_dir):
    """The last file of the tree arrives by a push: the tables equal those of the whole tree."""
    tree = _tree(spark)
    last = tree.agg(F.max("path").alias("path"))
    old = indexing.index_full(tree.join(last, "path", "left_anti"))
    changes = last.select(F.lit(0).alias("place"), F.col("path").alias("file_path"), F.lit("added").alias("kind"))
    out = indexing.index_incremental(old, changes, tree)
    parts = [out[name].groupBy(F.col(column).alias("file_path")).agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, column in indexing.FILE_OF.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""
WITH p AS (SELECT doc_id, lang AS branch, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN '' END AS indexed_branch, CASE WHEN doc_id % 4 = 0 THEN 'not_indexed' ELSE 'indexed' END AS status FROM documents)
SELECT doc_id, CASE WHEN coalesce(indexed_branch, '') <> '' AND branch IS DISTINCT FROM indexed_branch THEN 'other-branch' WHEN status = 'not_indexed' THEN 'not-indexed' END AS refusal FROM p""")
def sync_guards(spark, sf_dir):
    indexed = F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "")
    status = F.when(F.col("doc_id") % 4 == 0, "not_indexed").otherwise("indexed")
    return _docs(spark, sf_dir).select("doc_id", indexing.sync_refusal(F.col("lang"), indexed, status).alias("refusal"))


@query("""
WITH f AS (SELECT source AS pr, doc_id::varchar AS path, n_chars AS changes, text AS patch, coalesce(lang, 'removed') AS status FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY changes DESC, path) AS place FROM f WHERE patch IS NOT NULL AND patch <> '' AND status <> 'removed')
SELECT pr, path, changes, place FROM p WHERE place <= 12""")
def review_files(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.col("source").alias("pr"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("changes"), F.col("text").alias("patch"), F.coalesce("lang", F.lit("removed")).alias("status"))
    return review.review_files(files, "pr").select("pr", "path", "changes", "place")


@query(f"""
WITH RECURSIVE f AS (SELECT t.* FROM {X.values(X.PR_FILES, X.PR_FILES_SCHEMA)}), p AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY changes DESC, path) AS place FROM f WHERE patch IS NOT NULL AND patch <> '' AND status <> 'removed'),
c AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY place) AS i FROM p WHERE place <= 4 AND NOT contains(path, '.test.') AND content IS NOT NULL),
w(pr, i, path, used, take) AS (SELECT pr, 0::bigint, '', 0::bigint, false FROM (SELECT DISTINCT pr FROM c)
 UNION ALL SELECT c.pr, c.i, c.path, CASE WHEN w.used + length(c.content) <= 60 THEN w.used + length(c.content) ELSE w.used END, w.used + length(c.content) <= 60 FROM w JOIN c ON c.pr = w.pr AND c.i = w.i + 1)
SELECT pr, path FROM w WHERE take""")
def review_context(spark, sf_dir):
    files = X.frame(spark, X.PR_FILES, X.PR_FILES_SCHEMA)
    return review.file_context(review.review_files(files, "pr"), files, "pr", 60).select("pr", "path")


@query(f"""
WITH e AS (SELECT t.* FROM {X.values(X.EDGES, X.EDGES_SCHEMA)}), d AS (SELECT *, row_number() OVER (ORDER BY from_file, line, type, to_name, to_file) AS place FROM e WHERE type IN ('imports', 'calls') AND to_file IN ('src/billing.js', 'src/orders.js'))
SELECT place::int AS place, from_file || ':' || line || ' ' || CASE WHEN from_symbol = '' THEN '<module>' ELSE from_symbol END || ' ' || type || ' ' || to_name || ' (' || to_file || ')' AS dependant FROM d WHERE place <= 30""")
def review_dependants(spark, sf_dir):
    return review.dependants(X.frame(spark, X.EDGES, X.EDGES_SCHEMA), X.frame(spark, [("src/billing.js",), ("src/orders.js",)], "path string"))


@query(f"""
WITH f AS (SELECT t.* FROM {X.values(X.FINDINGS, X.FINDINGS_SCHEMA)}), k AS (SELECT * FROM f WHERE coalesce(file_path, '') = '' OR confidence = 'INSUFFICIENT_CONTEXT' OR EXISTS (SELECT 1 FROM (SELECT t.* FROM {X.values(X.PR_FILES, X.PR_FILES_SCHEMA)}) p WHERE p.pr = f.pr AND p.path = f.file_path)),
g AS (SELECT pr, severity, place, title || ' (' || coalesce(file_path, '') || CASE WHEN line > 0 THEN ':' || line ELSE '' END || ', ' || confidence || ')' AS said FROM k WHERE severity IN ('HIGH', 'MEDIUM', 'LOW'))
SELECT pr, severity, count(*) AS n, string_agg(said, chr(10) ORDER BY place) AS report FROM g GROUP BY pr, severity""")
def findings_report(spark, sf_dir):
    kept = review.kept_findings(X.frame(spark, X.FINDINGS, X.FINDINGS_SCHEMA), X.frame(spark, X.PR_FILES, X.PR_FILES_SCHEMA), "pr")
    grouped = review.by_severity(kept.withColumn("file_path", F.coalesce("file_path", F.lit(""))), "pr")
    return grouped.select("pr", "severity", "n", F.array_join(F.transform("items", review.finding_line), "\n").alias("report"))


@query(f"""
WITH t AS (SELECT t.* FROM {X.values(X.TARGETS, X.TARGETS_SCHEMA)}), e AS (SELECT path, min((kind, place)) AS o FROM t WHERE kind = 0 OR NOT contains(path, '.test.') GROUP BY path)
SELECT path, row_number() OVER (ORDER BY o, path)::int AS place FROM e ORDER BY o, path LIMIT 3""")
def change_targets(spark, sf_dir):
    rows = X.frame(spark, X.TARGETS, X.TARGETS_SCHEMA)
    return review.ranked_targets(rows.filter("kind = 0"), rows.filter("kind = 1"), 15_400)


@query(f"""
WITH a AS (SELECT doc_id, CASE WHEN json_valid(answer) AND json_type(answer) = 'OBJECT' THEN answer::json END AS j FROM {_of_documents_sql(X.REVIEWS, X.REVIEWS_SCHEMA)}),
f AS (SELECT doc_id, j, CASE WHEN json_type(j, '$.findings') = 'ARRAY' THEN from_json(j -> 'findings', '[{{"severity":"VARCHAR","confidence":"VARCHAR","title":"VARCHAR","issue":"VARCHAR","recommendation":"VARCHAR","line":"INTEGER"}}]') END AS l FROM a)
SELECT doc_id, CASE WHEN j IS NULL THEN 'json' WHEN NOT coalesce(length(j ->> 'summary') BETWEEN 1 AND 1500, false) THEN 'summary' WHEN NOT coalesce(j ->> 'verdict' IN ('approve', 'comment', 'request_changes'), false) THEN 'verdict'
 WHEN NOT coalesce(j ->> 'riskLevel' IN ('HIGH', 'MEDIUM', 'LOW'), false) THEN 'riskLevel'
 WHEN l IS NULL OR len(l) > 25 OR len(list_filter(l, lambda x: NOT coalesce(x.severity IN ('HIGH', 'MEDIUM', 'LOW') AND x.confidence IN ('CONFIRMED', 'LIKELY', 'POSSIBLE', 'INSUFFICIENT_CONTEXT') AND length(x.title) <= 160 AND length(x.issue) <= 1200 AND length(x.recommendation) <= 1200 AND coalesce(x.line, 0) >= 0, false))) > 0 THEN 'findings'
 WHEN coalesce(json_array_length(j, '$.testGaps'), 0) > 10 THEN 'testGaps' END AS fault FROM f""")
def answer_checks(spark, sf_dir):
    rows = _of_documents(spark, sf_dir, X.REVIEWS, X.REVIEWS_SCHEMA)
    return rows.select("doc_id", answers.review_fault(answers.parsed(F.col("answer"), answers.REVIEW)).alias("fault"))


@query("""
WITH p AS (SELECT 'order' AS kind, o_custkey AS owner, o_orderdate::varchar AS day, o_orderkey AS id FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY kind, owner ORDER BY day DESC, id) AS place FROM p)
SELECT kind, owner, place::int AS place, id FROM r WHERE place <= 12""")
def activity_feed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("string").alias("at"), F.col("o_orderkey").alias("id"))
    return views.feed({"order": orders}, "owner", "at", "id").select("kind", "owner", "place", "id")


@query("""
SELECT d.doc_id, coalesce('label:' || l.quality, d.source || '/' || d.lang) AS full_name FROM (SELECT doc_id, source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def record_names(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("repository_id"), F.concat(F.lit("label:"), F.col("quality").cast("string")).alias("full_name"))
    rows = _docs(spark, sf_dir).filter("source IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").alias("repository_id"), F.col("source").alias("owner"), F.col("lang").alias("repo"))
    return views.with_name(rows, known).select(F.col("repository_id").alias("doc_id"), "full_name")


@query("SELECT (SELECT count(*) FROM documents) AS repositories, (SELECT count(*) FROM documents WHERE lang IN ('en', 'fr')) AS indexed, (SELECT count(*) FROM labels WHERE toxic = 1) AS open_pulls")
def dashboard(spark, sf_dir):
    repositories = _docs(spark, sf_dir).select(F.when(F.col("lang") == "en", "indexed").when(F.col("lang") == "fr", "partial").otherwise("failed").alias("status"))
    return views.counters(repositories, table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "open").otherwise("closed").alias("state")))


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)")
def uncited_passages(spark, sf_dir):
    return views.uncited(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("file_path")), _docs(spark, sf_dir).select(F.col("text").alias("file_path"))).select("item_id")


# -- source code ------------------------------------------------------------------


def demo_files(spark: SparkSession) -> DataFrame:
    return X.frame(spark, X.DEMO, "file_path string, content string")


@query()
def extract_symbols(spark, sf_dir):
    return graph.unnest(analyze.analyze_files(demo_files(spark)), "symbols")


@query()
def extract_routes(spark, sf_dir):
    return graph.unnest(analyze.analyze_files(demo_files(spark)), "routes")


@query()
def graph_edges(spark, sf_dir):
    return graph.build_graph(analyze.analyze_files(demo_files(spark)))["edges"]


@query()
def code_chunks(spark, sf_dir):
    return chunking.chunk_files(analyze.analyze_files(demo_files(spark))).select("file_path", "symbol_name", "symbol_type", "start_line", "end_line", "is_test", "code")


@query()
def hybrid_retrieval(spark, sf_dir):
    scratch = Scratch(spark, "hybrid")
    analyzed = scratch.write(analyze.analyze_files(demo_files(spark)), "analyzed")
    chunks, parts = scratch.write(chunking.chunk_files(analyzed), "chunks"), graph.build_graph(analyzed)
    asked = "Where is chargeCard used and what does order_total do?"
    similar = vectors.top_k(vectors.embed(chunks), vectors.hashed_embedding(asked), "vector", "file_path", k=8)
    names = spark.range(1).select(F.explode(text.identifiers(F.lit(asked))).alias("name"))
    return retrieval.citations(retrieval.retrieve(chunks, parts["symbols"], parts["edges"], similar, names).chunks)


@query()
def manifest_stack(spark, sf_dir):
    found = manifests.manifests(demo_files(spark).withColumn("repository_id", F.lit("r")), ["repository_id"])
    return found.select("repository_id", "name", F.size("dependencies").alias("n_dependencies"), F.inline(F.array(manifests.detect_stack(F.col("dependencies")))))


# -- changes, access and events ------------------------------------------------------

EDIT = "array<struct<start_line:int,end_line:int,replacement:string>>"


@query()
def line_diff(spark, sf_dir):
    rows = X.frame(spark, X.CHANGES, f"path string, action string, new_content string, edits {EDIT}, original string, allowed_paths array<string>, existing_paths array<string>")
    return patches.validate_changes(rows).select("path", "action", "reason", "additions", "deletions", "diff")


_PERMS = "admin boolean, maintain boolean, push boolean, triage boolean, pull boolean, private boolean"


@query(f"""
SELECT coalesce(admin, false) AS admin, coalesce(pull, true) AS pull, CASE WHEN admin THEN 'admin' WHEN maintain THEN 'maintain' WHEN push THEN 'write' WHEN triage THEN 'triage' ELSE 'read' END AS role,
 coalesce(push, false) OR coalesce(maintain, false) OR coalesce(admin, false) AS can_write, CASE WHEN coalesce(push, false) OR coalesce(maintain, false) OR coalesce(admin, false) THEN 'read_write' ELSE 'read_only' END AS mode, count(*) AS n
FROM {_of_documents_sql(X.PERMISSIONS, _PERMS)} GROUP BY ALL""")
def permission_roles(spark, sf_dir):
    rows = _of_documents(spark, sf_dir, X.PERMISSIONS, _PERMS)
    p = access.permissions(*[F.col(c) for c in ("admin", "maintain", "push", "triage", "pull")])
    rows = rows.select("private", F.inline(F.array(p)))
    rows = rows.withColumn("mode", access.access(F.col("can_write"), F.col("private"), F.lit(None).cast("boolean"), F.lit(True))["mode"])
    return rows.groupBy("admin", "pull", "role", "can_write", "mode").agg(F.count("*").alias("n"))


_ERRORS = "n int, status int, message string, remaining string, resource string"


@query(f"""
SELECT doc_id, CASE WHEN status = 401 THEN 'AUTH_EXPIRED' WHEN status = 403 AND (coalesce(remaining, '') = '0' OR regexp_matches(message, '(?i)rate limit|secondary rate')) THEN 'RATE_LIMIT' WHEN status IN (403, 451) THEN 'FORBIDDEN' WHEN status = 404 AND resource = 'repository' THEN 'REPO_NOT_FOUND' WHEN status = 404 THEN 'NOT_FOUND'
 WHEN status = 409 OR (status = 422 AND regexp_matches(message, '(?i)already exists|no commits between')) THEN 'CONFLICT' WHEN status = 422 THEN 'BAD_REQUEST' ELSE 'UPSTREAM' END AS code FROM {_of_documents_sql(X.ERRORS, _ERRORS)}""")
def upstream_errors(spark, sf_dir):
    rows = _of_documents(spark, sf_dir, X.ERRORS, _ERRORS)
    return rows.select("doc_id", access.upstream_error(F.col("status"), F.col("message"), F.col("remaining"), F.col("resource")).alias("code"))


@query(f"""
WITH o AS (SELECT t.*, row_number() OVER (PARTITION BY delivery_id ORDER BY received_at) AS n FROM {X.values(X.DELIVERIES, "delivery_id string, event string, payload string, received_at string")}), k AS (SELECT t.* FROM {X.values(X.REPOSITORIES, "full_name string, indexing_status string, indexed_branch string, default_branch string")}),
j AS (SELECT delivery_id, event, coalesce(payload ->> '$.ref', '') AS ref, coalesce(payload ->> '$.deleted', 'false') = 'true' AS deleted, payload ->> '$.repository.full_name' AS repo, coalesce(payload ->> '$.action', '') AS act, coalesce(payload ->> '$.pull_request.draft', 'false') = 'true' AS draft, payload ->> '$.installation.id' AS inst, payload ->> '$.sender.id' AS sender,
 list_distinct(payload ->> '$.commits[*].added[*]') AS a, list_distinct(payload ->> '$.commits[*].modified[*]') AS m, list_distinct(payload ->> '$.commits[*].removed[*]') AS gone FROM o WHERE n = 1),
c AS (SELECT j.*, len(list_filter(a, lambda x: NOT list_contains(gone, x)))::int AS n_added, len(list_filter(m, lambda x: NOT list_contains(gone, x)))::int AS n_modified, len(gone)::int AS n_removed, substr(ref, 12) AS branch, k.indexing_status AS status, CASE WHEN k.indexed_branch <> '' THEN k.indexed_branch ELSE k.default_branch END AS known FROM j LEFT JOIN k ON k.full_name = j.repo),
r AS (SELECT *, CASE WHEN event = 'ping' THEN 'ping' WHEN event NOT IN ({_in(E.HANDLED)}) THEN 'unhandled event ' || event
 WHEN event = 'push' THEN CASE WHEN NOT starts_with(ref, 'refs/heads/') THEN 'non-branch ref ' || ref WHEN deleted THEN 'branch deleted' WHEN NOT regexp_matches(coalesce(repo, ''), '^[^/]+/[^/]+') THEN 'no repository' WHEN status IS NULL THEN 'untracked repository' WHEN status NOT IN ({_in(E.INDEXED)}) THEN 'index status ' || status WHEN branch <> known THEN 'push to ' || branch || ', indexed ' || known WHEN n_added + n_modified + n_removed = 0 THEN 'no file changes' END
 WHEN event = 'pull_request' THEN CASE WHEN act NOT IN ({_in(E.REVIEWED)}) THEN 'action ' || act WHEN draft AND act <> 'ready_for_review' THEN 'draft' WHEN status IS NULL THEN 'untracked repository' WHEN status NOT IN ({_in(E.INDEXED)}) THEN 'index status ' || status END
 WHEN event = 'installation' THEN CASE WHEN inst IS NULL OR sender IS NULL THEN 'incomplete' WHEN act NOT IN ('created', 'deleted', 'suspend') THEN 'action ' || act END END AS reason FROM c),
d AS (SELECT *, CASE WHEN event = 'ping' THEN 'processed' WHEN reason IS NOT NULL THEN 'ignored' WHEN event IN ('installation', 'installation_repositories') THEN 'processed' ELSE 'queued' END AS outcome FROM r)
SELECT delivery_id, event, outcome, CASE WHEN outcome = 'queued' THEN CASE WHEN event = 'push' THEN 'incremental_sync' ELSE 'pr_review' END END AS kind, reason, n_added, n_modified, n_removed FROM d""")
def event_routing(spark, sf_dir):
    deliveries = X.frame(spark, X.DELIVERIES, "delivery_id string, event string, payload string, received_at string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    repositories = X.frame(spark, X.REPOSITORIES, "full_name string, indexing_status string, indexed_branch string, default_branch string")
    out = E.route(E.once(deliveries), repositories)
    return out.select("delivery_id", "event", "outcome", "kind", "reason", F.size("changes.added").alias("n_added"), F.size("changes.modified").alias("n_modified"), F.size("changes.removed").alias("n_removed"))


@query("""
WITH n AS (SELECT user_id, event_type AS name, value, event_id FROM events WHERE event_id % 2 = 0), o AS (SELECT user_id, event_type AS name, value, event_id FROM events WHERE event_id % 2 = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY event_id DESC) AS r FROM n) WHERE r = 1), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY event_id DESC) AS r FROM o) WHERE r = 1)
SELECT user_id, name, value, event_id FROM l UNION ALL SELECT user_id, name, value, event_id FROM f ANTI JOIN l USING (user_id, name)""")
def keyed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), "value", "event_id")
    old = windows.latest_per_key(rows.filter("event_id % 2 = 1"), ["user_id", "name"], "event_id")
    return upserts.upsert(old, rows.filter("event_id % 2 = 0"), ["user_id", "name"], "event_id").select("user_id", "name", "value", "event_id")


@query("""
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT user_id, count(*) AS n, sum(event_id)::bigint AS total FROM a WHERE r <= 50 GROUP BY user_id""")
def bounded_append(spark, sf_dir):
    kept = windows.last_n(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], upserts.ISSUES)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("""
WITH RECURSIVE q AS (SELECT user_id, event_id AS request_id, epoch_us(ts) / 1000000.0::double AS came, floor(abs(value))::bigint % 900 + 100 AS tokens FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY came, request_id) AS i FROM q),
f AS (SELECT user_id, 0::bigint AS i, NULL::bigint AS request_id, []::STRUCT(t DOUBLE, n BIGINT)[] AS live, '-infinity'::double AS clock, NULL::double AS waited FROM (SELECT DISTINCT user_id FROM o)
UNION ALL SELECT user_id, i, request_id, CASE WHEN start - came > 45 THEN live ELSE list_append(list_filter(live, lambda x: start - x.t < 60), {'t': start, 'n': tokens}) END, CASE WHEN start - came > 45 THEN clock ELSE start END, CASE WHEN start - came > 45 THEN NULL ELSE start - came END
FROM (SELECT *, CASE WHEN k = 0 THEN t0 ELSE greatest(t0, live[k].t + 60) END AS start
 FROM (SELECT *, list_filter(range(0, len(live) + 1), lambda y: coalesce(list_sum(list_transform(live[y + 1:], lambda x: x.n)), 0) + tokens <= 1000)[1] AS k
 FROM (SELECT o.user_id, o.i, o.request_id, o.came, o.tokens, f.clock, greatest(o.came, f.clock) AS t0, list_filter(f.live, lambda x: greatest(o.came, f.clock) - x.t < 60) AS live FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))))
SELECT user_id, request_id, round(waited, 3) AS waited FROM f WHERE i > 0""")
def token_governor(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.floor(F.abs("value")) % 900 + 100).alias("tokens"))
    return jobs.admit(rows, "user_id", 1000, 45.0).select("user_id", "request_id", F.round("waited", 3).alias("waited"))


@query("""
WITH q AS (SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'ready' WHEN event_type = 'click' THEN 'stale' ELSE 'missing' END AS state, event_type = 'click' AS is_stale FROM q""")
def cache_states(spark, sf_dir):
    last = windows.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], "ts", "event_id")
    sha = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("")
    return last.select("user_id", "event_id", jobs.cache_state(sha, F.lit("view")).alias("state"), jobs.freshness(sha, F.lit("view")).alias("is_stale"))
