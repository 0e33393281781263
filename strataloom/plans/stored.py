"""The third part of the query catalogue: indexes and states that are stored, and operators for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators import grams, impact, retrieval, review, rollups, upserts, vector_index, views
from strataloom.operators.shuffles import Scratch
from strataloom.plans.details import ORACLES, QUERIES, query
from strataloom.sources.tables import bucketed, table
from strataloom.streaming.events import rate_windows
from strataloom.streaming.ledger import Store

__all__ = ["ORACLES", "QUERIES"]

# -- vectors in an inverted file --------------------------------------------------


def _vector_search(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(found by the index, found by searching all cells) for every twentieth vector."""
    scratch, points = Scratch(spark, "vectors"), table(spark, sf_dir, "embeddings")
    queries = points.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    centers = vector_index.fit_centroids(points, "embedding")
    index = vector_index.build_index(points, "embedding", "vec_id", scratch, centers)
    probes = vector_index.probes_for(index, queries, scratch, centers)
    return vector_index.search(index, queries, scratch, centers, probes), vector_index.search(index, queries, scratch, centers)


@query()
def vector_index_topk(spark, sf_dir):
    return _vector_search(spark, sf_dir)[0].select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query("SELECT count(*) AS queries, count(*) > 0 AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, sf_dir):
    measured = vector_index.recall(*_vector_search(spark, sf_dir))
    return measured.agg(F.count("*").alias("queries"), F.coalesce(F.avg("recall") >= 0.9, F.lit(False)).alias("enough"))

# -- a stream of batches, each applied once -----------------------------------------

_TOTALS = "user_id bigint, event_type string, n bigint, last_id bigint, total decimal(38,10)"


def _add_events(old: dict[str, DataFrame], changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Counts and sums, which applying a batch twice would spoil."""
    keys = ["user_id", "event_type"]
    new = changes["events"].groupBy(*keys).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.sum(F.col("value").cast("decimal(28,10)")).alias("total"))
    both = old["totals"].unionByName(new)
    return {"totals": both.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"), F.sum("total").cast("decimal(38,10)").alias("total"))}


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id, round(sum(value::decimal(28,10)), 4)::double AS total FROM events GROUP BY 1, 2")
def replayed_batches(spark, sf_dir):
    """events as a stream of five files; each batch is tried twice."""
    scratch, events = Scratch(spark, "replay"), table(spark, sf_dir, "events")
    landed = f"{scratch.path}/landed"
    events.repartitionByRange(5, "event_id").write.parquet(landed)
    store = Store(spark, f"{scratch.path}/store", {"totals": (_TOTALS, ["user_id", "event_type"])}, buckets=8)

    def twice(df: DataFrame, n: int) -> None:
        for _ in range(2):
            store.update(n, {"events": df}, _add_events)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    stream.writeStream.option("checkpointLocation", f"{scratch.path}/offsets").foreachBatch(twice).trigger(availableNow=True).start().awaitTermination()
    return store.read("totals").select("user_id", "event_type", "n", "last_id", F.round("total", 4).cast("double").alias("total"))

# -- substrings by gram postings -----------------------------------------------------


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)
SELECT page_id, word FROM pages JOIN w ON word <> '' AND contains(url, word)""")
def words_in_urls(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    found = grams.containing(table(spark, sf_dir, "pages"), words, "page_id", "url", "word", Scratch(spark, "words"))
    return found.select(F.col("id").alias("page_id"), F.col("needle").alias("word"))


@query("""
WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark),
l AS (SELECT item_id, word FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(word) DESC, word) AS n FROM w) WHERE n = 1)
SELECT item_id, word, doc_id FROM l JOIN documents ON contains(lower(text), word)""")
def text_index_search(spark, sf_dir):
    """The longest word of each passage, searched in a stored index of the lower-cased documents."""
    scratch = Scratch(spark, "texts")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    index = grams.GramIndex.write(docs, "doc_id", "text", f"{scratch.path}/index")
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    longest = words.groupBy("item_id").agg(F.min_by("word", F.struct(-F.length("word"), "word")).alias("word"))
    found = grams.containing(docs, longest, "doc_id", "text", "word", scratch, index)
    return longest.join(found, longest["word"] == found["needle"]).select("item_id", "word", F.col("id").alias("doc_id"))

# -- many questions to a graph at once -------------------------------------------------

_SALES_SQL = """
e AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'tests' ELSE 'calls' END AS type, 'part/' || l_partkey AS from_file, 'p' || l_partkey AS from_symbol, 's' || l_suppkey AS to_name, 'supplier/' || l_suppkey AS to_file, l_orderkey * 10 + l_linenumber AS line, 0.5::double + l_discount * 4 AS confidence FROM lineitem
UNION ALL SELECT 'calls', 'order/' || l_orderkey, 'o' || l_orderkey, 'p' || l_partkey, 'part/' || l_partkey, l_linenumber, 0.5::double FROM lineitem
UNION ALL SELECT 'imports', 'nation/' || s_nationkey, '', './' || s_suppkey, 'supplier/' || s_suppkey, s_suppkey, 1.0::double FROM supplier),
f AS (SELECT 'part/' || p_partkey AS file_path, p_size < 5 AS is_test, CASE WHEN p_size >= 45 THEN 1 ELSE 0 END AS n_routes FROM part),
a AS (SELECT s_suppkey AS asked, 's' || s_suppkey AS name, 'supplier/' || s_suppkey AS own FROM supplier)"""


def _sales(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, files): orders call parts, parts call suppliers, nations import them; large parts have a route."""
    lines, suppliers, parts = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "part"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edge = lambda type_, file, symbol, to, to_file, line, sure: [type_.alias("type"), file.alias("from_file"), symbol.alias("from_symbol"), to.alias("to_name"), to_file.alias("to_file"), to.alias("to_symbol"), line.cast("long").alias("line"), sure.alias("confidence")]
    kind = F.when(F.col("l_returnflag") == "R", "tests").otherwise("calls")
    supplied = lines.select(*edge(kind, name("part/", "l_partkey"), name("p", "l_partkey"), name("s", "l_suppkey"), name("supplier/", "l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit(0.5) + F.col("l_discount") * 4))
    ordered = lines.select(*edge(F.lit("calls"), name("order/", "l_orderkey"), name("o", "l_orderkey"), name("p", "l_partkey"), name("part/", "l_partkey"), F.col("l_linenumber"), F.lit(0.5)))
    imported = suppliers.select(*edge(F.lit("imports"), name("nation/", "s_nationkey"), F.lit(""), name("./", "s_suppkey"), name("supplier/", "s_suppkey"), F.col("s_suppkey"), F.lit(1.0)))
    route = F.array(F.struct(F.lit("GET").alias("method"), F.col("p_name").alias("path"), F.col("p_type").alias("handler"), F.lit(1).alias("line")))
    files = parts.select(name("part/", "p_partkey").alias("file_path"), (F.col("p_size") < 5).alias("is_test"), F.col("p_brand").alias("language"), F.when(F.col("p_size") >= 45, route).otherwise(F.slice(route, 1, 0)).alias("routes"))
    own = name("s", "s_suppkey")
    symbols = suppliers.select(name("supplier/", "s_suppkey").alias("file_path"), own.alias("name"), own.alias("qualified_name"), F.lit(1).alias("start_line"))
    return symbols, supplied.unionByName(ordered).unionByName(imported), files


def _asked_suppliers(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("()"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asked"), name.alias("name"), F.lit(None).cast("string").alias("file_path"))


_FIRST = "row_number() OVER (PARTITION BY asked ORDER BY from_file, line, from_symbol, to_name, to_file) AS n"
_IMPACTS_SQL = f"""
WITH {_SALES_SQL},
c AS (SELECT * FROM (SELECT a.asked, e.*, coalesce(f.is_test, false) AS is_test, {_FIRST} FROM a JOIN e ON e.to_name = a.name AND e.type IN ('calls', 'tests') LEFT JOIN f ON f.file_path = e.from_file) WHERE n <= 400),
i AS (SELECT * FROM (SELECT a.asked, e.*, {_FIRST} FROM a JOIN e ON e.to_file = a.own AND e.type = 'imports') WHERE n <= 200),
h AS (SELECT asked, from_symbol AS hop FROM (SELECT asked, from_symbol, row_number() OVER (PARTITION BY asked ORDER BY min(from_file), from_symbol) AS n FROM c WHERE from_symbol NOT IN ('', '<module>') GROUP BY 1, 2) WHERE n <= 40),
d AS (SELECT * FROM (SELECT h.asked, e.*, {_FIRST} FROM h JOIN e ON e.to_name = h.hop AND e.type = 'calls') WHERE n <= 200),
t AS (SELECT asked, from_file AS file_path FROM c UNION SELECT asked, own FROM a),
g AS (SELECT asked, file_path FROM (SELECT asked, file_path, row_number() OVER (PARTITION BY asked ORDER BY file_path) AS n FROM t JOIN f USING (file_path) WHERE n_routes > 0) WHERE n <= 40),
r AS (SELECT asked, from_file AS file_path, CASE WHEN is_test OR type = 'tests' THEN 1 WHEN confidence >= 0.7 THEN 3 ELSE 2 END AS rank, CASE WHEN is_test OR type = 'tests' THEN 't' ELSE 'c' END AS reason FROM c
UNION ALL SELECT asked, from_file, 2, 'i' FROM i UNION ALL SELECT asked, from_file, 2, 'h' FROM d UNION ALL SELECT asked, file_path, 3, 'r' FROM g),
s AS (SELECT asked, file_path, max(rank) AS rank, count(*) AS n_details, count(DISTINCT reason)::int AS n_reasons FROM r GROUP BY 1, 2)"""


@query(f"""{_IMPACTS_SQL}
SELECT asked AS supplier, file_path, CASE rank WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, n_details, n_reasons
FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY rank DESC, n_details DESC, file_path) AS n FROM s) WHERE n <= 40""")
def supplier_impacts(spark, sf_dir):
    """The impact of every supplier at once."""
    out = impact.Impacts(*_sales(spark, sf_dir), _asked_suppliers(spark, sf_dir)).impacts()
    return out.select(F.col("asked").alias("supplier"), "file_path", "severity", F.size("details").cast("long").alias("n_details"), F.size("reasons").alias("n_reasons"))


@query(f"""{_IMPACTS_SQL}
SELECT asked AS supplier, (SELECT count(*) FROM c WHERE c.asked = a.asked AND type = 'calls') AS direct_callers, (SELECT count(*) FROM i WHERE i.asked = a.asked) AS importers, (SELECT count(*) FROM d WHERE d.asked = a.asked) AS second_hop,
 (SELECT count(DISTINCT from_file) FROM c WHERE c.asked = a.asked AND is_test) AS tests, (SELECT count(*) FROM g WHERE g.asked = a.asked) AS routes, (SELECT count(*) FROM s WHERE s.asked = a.asked AND rank = 3) AS high, (SELECT count(*) FROM s WHERE s.asked = a.asked AND rank = 1) AS low FROM a""")
def supplier_impact_counts(spark, sf_dir):
    out = impact.Impacts(*_sales(spark, sf_dir), _asked_suppliers(spark, sf_dir)).counts()
    return out.select(F.col("asked").alias("supplier"), "direct_callers", "importers", "second_hop", "tests", "routes", "high", "low")


@query(f"""{_IMPACTS_SQL},
p AS (SELECT asked, from_file, line, from_symbol AS caller, n FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY from_file, line, from_symbol) AS k FROM c WHERE type = 'calls') WHERE k <= 12),
u AS (SELECT asked, to_name AS caller, from_file || ':' || from_symbol || ' → ' AS up, row_number() OVER (PARTITION BY asked, to_name ORDER BY from_file, line, from_symbol) AS k FROM d),
w AS (SELECT p.asked, coalesce(up, '') || from_file || ':' || p.caller || ' → s' || p.asked AS call_path, min((from_file, line, u.k)) AS o FROM p LEFT JOIN u ON u.asked = p.asked AND u.caller = p.caller AND u.k <= 2 GROUP BY 1, 2)
SELECT asked AS supplier, call_path FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY o) AS n FROM w) WHERE n <= 14""")
def supplier_call_paths(spark, sf_dir):
    out = impact.Impacts(*_sales(spark, sf_dir), _asked_suppliers(spark, sf_dir)).call_paths()
    return out.select(F.col("asked").alias("supplier"), "call_path")


@query(f"""
WITH {_SALES_SQL},
x AS (SELECT DISTINCT a.asked, e.* FROM a JOIN e ON (e.to_file = a.own AND e.type IN ('calls', 'imports')) OR (e.from_file = a.own AND e.type = 'calls')),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY from_file, line, to_name, to_file, confidence, from_symbol, type) AS k FROM x) WHERE k <= 60),
o AS (SELECT asked, file_path, min((from_file, line)) AS o FROM (SELECT asked, from_file, line, unnest([from_file, to_file]) AS file_path FROM n) WHERE file_path <> 'supplier/' || asked GROUP BY 1, 2)
SELECT asked AS supplier, file_path FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY o) AS r FROM o) WHERE r <= 6""")
def supplier_neighbours(spark, sf_dir):
    symbols, edges, _ = _sales(spark, sf_dir)
    focus = symbols.select(F.substring("name", 2, 20).cast("long").alias("asked"), "file_path")
    return retrieval.neighbours_each(edges, focus, Scratch(spark, "near"))[1].select(F.col("asked").alias("supplier"), "file_path")


# -- facts in one pass, tables in buckets ----------------------------------------------

_FACTS_SQL = r"""
f AS (SELECT source || '/' || lang || '/doc' || doc_id || '.md' AS file_path, lang AS language, len(string_split(text, chr(10))) AS lines, contains(text, '?') AS is_test, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS symbols, 0 AS routes FROM documents
UNION ALL SELECT regexp_replace(url, '^https?://', ''), 'html', len(string_split(html, chr(10))), false, len(regexp_extract_all(html, '<[a-z]+')), len(regexp_extract_all(html, 'href="')) FROM pages),
p AS (SELECT *, string_split(file_path, '/') AS s FROM f),
k AS (SELECT *, CASE WHEN len(s) > 1 THEN s[1] ELSE '(root)' END AS directory, CASE WHEN len(s) > 2 THEN s[1] || '/' || s[2] WHEN len(s) > 1 THEN s[1] ELSE '(root)' END AS module FROM p)"""


def _all_files(spark, sf_dir) -> DataFrame:
    """documents and pages as files: words with a capital and tags are their symbols, links their routes."""
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = table(spark, sf_dir, "documents").select(path.alias("file_path"), F.col("lang").alias("language"), F.size(F.split("text", "\n")).alias("lines"), F.contains("text", F.lit("?")).alias("is_test"), count("text", "[A-Z][a-z]+").alias("symbol_count"), F.lit(0).alias("n_routes"))
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("file_path"), F.lit("html").alias("language"), F.size(F.split("html", "\n")).alias("lines"), F.lit(False).alias("is_test"), count("html", "<[a-z]+").alias("symbol_count"), count("html", 'href="').alias("n_routes"))
    return docs.unionByName(pages)


@query(f"""
WITH {_FACTS_SQL},
g AS (SELECT CASE grouping_id(language, directory, module) WHEN 7 THEN 'total' WHEN 3 THEN 'language' WHEN 5 THEN 'directory' ELSE 'module' END AS kind, coalesce(language, directory, module) AS name, count(*) AS files, count_if(is_test) AS test_files, sum(lines)::bigint AS lines, sum(symbols)::bigint AS symbols, sum(routes)::bigint AS routes
FROM k GROUP BY GROUPING SETS ((), (language), (directory), (module))),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'language' THEN lines ELSE files END DESC, name)::int AS place FROM g)
SELECT kind, name, place, files, test_files, lines, symbols, routes FROM r WHERE place <= CASE kind WHEN 'directory' THEN 12 WHEN 'module' THEN 40 ELSE 1000000 END""")
def repository_facts(spark, sf_dir):
    return rollups.repository_facts(_all_files(spark, sf_dir)).select("kind", "name", "place", "files", "test_files", "lines", "symbols", "routes")


@query(f"""
WITH {_FACTS_SQL}, l AS (SELECT directory, language, sum(lines) AS lines FROM k GROUP BY 1, 2)
SELECT k.directory, count(*) AS files, sum(symbols)::bigint AS symbols, sum(routes)::bigint AS routes, (SELECT string_agg(language, ',' ORDER BY lines DESC, language) FROM l WHERE l.directory = k.directory) AS languages FROM k GROUP BY 1""")
def repository_records(spark, sf_dir):
    """The facts of every directory as of a repository, one row each."""
    files = _all_files(spark, sf_dir).withColumn("repository", paths.top_directory(F.col("file_path")))
    record = rollups.facts_record(rollups.repository_facts(files, ["repository"]), ["repository"])
    return record.select(F.col("repository").alias("directory"), "files", "symbols", "routes", F.array_join(F.transform("languages", lambda x: x["name"]), ",").alias("languages"))


@query("SELECT source, count(*) AS files, count(l.doc_id) AS labelled, coalesce(sum(l.toxic), 0)::bigint AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def bucketed_join(spark, sf_dir):
    """documents and labels stored in buckets by doc_id, which join without an exchange."""
    scratch = Scratch(spark, "buckets")
    stored = {}
    for name, columns in (("documents", ["doc_id", "source"]), ("labels", ["doc_id", "toxic"])):
        rows = table(spark, sf_dir, name).select(*columns)
        stored[name] = bucketed(rows, f"strataloom_{name}_{scratch.path[-32:]}", f"{scratch.path}/{name}", ["doc_id"], buckets=16)
    labels = stored["labels"].withColumn("labelled", F.lit(1))
    joined = stored["documents"].hint("merge").join(labels.hint("merge"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("files"), F.count("labelled").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))


# -- rates over event time -------------------------------------------------------------


@query("SELECT user_id, (floor(epoch_us(ts) / 3600000000) * 3600)::bigint AS window_start, count(*) AS n, greatest(0, count(*) - 2) AS rejected FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def rate_limit_stream(spark, sf_dir):
    """events as a stream in the order of time: hourly windows in the stream's state, put into a store as they grow."""
    scratch, events = Scratch(spark, "rates"), table(spark, sf_dir, "events")
    landed = f"{scratch.path}/landed"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    parts = scratch.write(events.withColumn("part", F.floor((at - F.lit(first)) * 4 / F.lit((last or 0) - (first or 0) + 1))), "parts")
    for i in range(4):  # a file after the other, so that they are read in this order
        parts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(landed)
    keys = ["user_id", "window_start"]
    store = Store(spark, f"{scratch.path}/store", {"rates": ("user_id bigint, window_start bigint, n bigint, rejected bigint", keys)}, buckets=8)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    counted = rate_windows(stream, ["user_id"], "ts", 3600, 2)
    put = lambda old, new: {"rates": upserts.upsert(old["rates"], new["rates"], keys)}

    def batch(df: DataFrame, n: int) -> None:
        store.update(n, {"rates": df}, put)

    counted.writeStream.option("checkpointLocation", f"{scratch.path}/offsets").outputMode("update").foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return store.read("rates")


# -- requested changes -----------------------------------------------------------------

_INPUT = 16_000

_CHANGE_SQL = """
w AS (SELECT source AS request, doc_id::varchar AS path, string_split(text, chr(10)) AS l, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
c AS (SELECT *, len(l) AS lines, greatest(1, least(len(l), 1 + place * 7) - 15) AS a, least(len(l), least(len(l), 1 + place * 7) + 17) AS b FROM w WHERE place <= 3 AND NOT (len(l) = 1 AND l[1] = '')),
x AS (SELECT *, list_transform(l, lambda x, i: lpad(i::varchar, 4, ' ') || '| ' || x) AS t FROM c),
y AS (SELECT *, array_to_string(t, chr(10)) AS whole, '--- lines ' || a || '-' || b || ' of ' || lines || ' ---' || chr(10) || array_to_string(t[a:b], chr(10)) AS part, row_number() OVER (PARTITION BY request ORDER BY place) AS k FROM x),
f AS (SELECT request, 0::bigint AS k, 10400::bigint AS room, NULL::bigint AS place, NULL::varchar AS path, NULL::bigint AS lines, false AS windowed, NULL::varchar AS rendered FROM (SELECT DISTINCT request FROM y)
UNION ALL SELECT request, k, room - length(rendered), place, path, lines, windowed, rendered FROM (
 SELECT y.request, y.k, f.room, y.place, y.path, y.lines, length(whole) > room OR y.lines > 260 AS windowed, CASE WHEN length(whole) > room OR y.lines > 260 THEN CASE WHEN length(part) > room THEN substr(part, 1, room) || chr(10) || '... [excerpt truncated]' ELSE part END ELSE whole END AS rendered
 FROM f JOIN y ON y.request = f.request AND y.k = f.k + 1 WHERE f.room >= 900))"""


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(edges, the files shown): each source asks to change its files, the first documents first, each around a line of its own."""
    docs = table(spark, sf_dir, "documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    files = docs.select(F.col("source").alias("request"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), place.alias("place"))
    targets = review.targets_each(files, files.limit(0), _INPUT)
    line = F.least(F.size(F.split("content", "\n")), (1 + F.col("place") * 7).cast("int"))
    ranges = files.select("request", "path", line.alias("start"), (line + 2).alias("end"))
    own = F.col("doc_id").cast("string")
    edges = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "imports").otherwise("calls").alias("type"), F.concat(F.lit("label"), F.col("quality").cast("string")).alias("from_file"), F.lit("").alias("from_symbol"), own.alias("to_file"), F.concat(F.lit("d"), own).alias("to_name"), F.col("doc_id").alias("line"))
    return edges, review.change_files(targets, files.select("path", "content"), ranges, _INPUT)


@query(f"WITH RECURSIVE {_CHANGE_SQL} SELECT request, place::int AS place, path, lines::int AS lines, windowed, rendered FROM f WHERE k > 0")
def change_context(spark, sf_dir):
    return _changes(spark, sf_dir)[1].select("request", "place", "path", "lines", "windowed", "rendered")


@query(f"""
WITH RECURSIVE {_CHANGE_SQL}, e AS (SELECT CASE WHEN toxic = 1 THEN 'imports' ELSE 'calls' END AS type, 'label' || quality AS from_file, doc_id::varchar AS to_file, 'd' || doc_id AS to_name, doc_id AS line FROM labels),
n AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY from_file, line, type, to_name, to_file)::int AS place, '- ' || from_file || ':' || line || ' <module> ' || type || ' ' || to_name AS importer FROM f JOIN e ON e.to_file = f.path WHERE k > 0)
SELECT request, place, importer FROM n WHERE place <= 14""")
def change_importers(spark, sf_dir):
    return review.change_importers(*_changes(spark, sf_dir))

# -- lists -------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT conv_id % 7 AS owner, conv_id, count(*) AS messages, max(turn) AS last FROM conversations GROUP BY 1, 2)
SELECT owner, conv_id, messages, place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY last DESC, conv_id)::int AS place FROM c) WHERE place <= 20""")
def conversation_list(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("owner", F.col("conv_id") % 7)
    return views.conversations(turns, "owner", "conv_id", "turn").select("owner", "conv_id", "messages", "place")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, 'Earlier turns:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(text, 1, 700), chr(10) ORDER BY turn) AS block FROM r WHERE n <= 4 GROUP BY conv_id""")
def history_blocks(spark, sf_dir):
    return views.history(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""
WITH l AS (SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)
SELECT doc_id, event_id % 3 AS verdict, CASE WHEN l.user_id IS NOT NULL THEN event_type <> CASE WHEN doc_id % 2 = 0 THEN 'click' ELSE 'view' END END AS stale FROM documents LEFT JOIN l ON doc_id = user_id""")
def pulls_with_reviews(spark, sf_dir):
    head = F.when(F.col("doc_id") % 2 == 0, "click").otherwise("view")
    pulls = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), head.alias("head_sha"))
    reviews = table(spark, sf_dir, "events").select(F.col("user_id").alias("number"), F.col("event_type").alias("head_sha"), (F.col("event_id") % 3).alias("verdict"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return views.with_reviews(pulls, reviews).select(F.col("number").alias("doc_id"), "verdict", "stale")
