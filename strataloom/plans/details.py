"""The second part of the query catalogue: the smaller operators, each called over a shared table or a fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import access, chunking, graph, impact, jobs, packing, patches, retrieval, rollups, selection, upserts, windows
from strataloom.plans import fixtures as X
from strataloom.plans import queries as Q
from strataloom.plans.queries import ORACLES, QUERIES, query
from strataloom.sources import tables
from strataloom.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]

# -- the graph and impact ---------------------------------------------------------

_EDGES = f"e AS (SELECT t.* FROM {X.values(X.EDGES, X.EDGES_SCHEMA)})"
_NEAR = f"""
WITH {_EDGES}, n AS (SELECT DISTINCT * FROM e WHERE (type IN ('calls', 'imports') AND to_file = 'src/orders.js') OR (type = 'calls' AND from_file = 'src/orders.js') ORDER BY from_file, line, to_name, to_file LIMIT 60)"""


def _near(spark) -> tuple[DataFrame, DataFrame]:
    focus = X.frame(spark, [("src/orders.js",)], "file_path string")
    return retrieval.neighbour_files(X.frame(spark, X.EDGES, X.EDGES_SCHEMA), focus)


@query(f"{_NEAR}, f AS (SELECT from_file, line, unnest([0, 1]) AS k, unnest([from_file, to_file]) AS file_path FROM n) SELECT file_path FROM f WHERE file_path NOT IN ('', 'src/orders.js') GROUP BY file_path ORDER BY min((from_file, line, k)) LIMIT 6")
def neighbour_files(spark, sf_dir):
    return _near(spark)[1]


@query(f"""{_NEAR}, f AS (SELECT * FROM n ORDER BY from_file, line, to_name, to_file LIMIT 12),
t AS (SELECT from_file, line, CASE WHEN type = 'calls' AND to_symbol <> '' THEN from_file || ':' || line || ' ' || CASE WHEN from_symbol = '' THEN '<module>' ELSE from_symbol END || ' -> ' || to_symbol || ' (' || CASE WHEN to_file = '' THEN 'external' ELSE to_file END || ')' WHEN type = 'imports' AND to_file <> '' THEN from_file || ' imports ' || to_file END AS note FROM f)
SELECT note FROM t WHERE note IS NOT NULL GROUP BY note ORDER BY min((from_file, line)) LIMIT 14""")
def graph_notes(spark, sf_dir):
    return retrieval.graph_notes(_near(spark)[0])


_HITS_SCHEMA = "file_path string, score double"
_HITS: X.Rows = [("README.md", 0.9), ("src/orders.js", 0.8), ("docs/a.md", 0.5), ("docs/a.md", 0.7), ("src/billing.js", 1.0), ("docs/b.md", 0.2), ("docs/c.md", 0.3), ("docs/d.md", 0.4), ("docs/e.md", 0.45), ("docs/f.md", 0.2), ("docs/g.md", None)]


@query(f"""{Q._IMPACT_SQL}, i AS (SELECT file_path, max(rank) AS rank, count(*) AS n FROM r WHERE file_path <> 'src/billing.js' GROUP BY file_path), h AS (SELECT t.* FROM {X.values(_HITS, _HITS_SCHEMA)}),
s AS (SELECT file_path, max(score) AS score FROM h WHERE file_path <> 'src/billing.js' AND file_path NOT IN (SELECT file_path FROM i) GROUP BY file_path ORDER BY score DESC NULLS LAST, file_path LIMIT 6)
SELECT file_path, CASE rank WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, n AS n_details FROM i UNION ALL SELECT file_path, 'LOW', 1 FROM s""")
def impact_semantic(spark, sf_dir):
    i = Q._fixture_impact(spark)
    out = impact.with_semantic(i.impacts(), X.frame(spark, _HITS, _HITS_SCHEMA), i.defined_in)
    return out.select("file_path", "severity", F.size("details").cast("long").alias("n_details"))


@query(f"{Q._IMPACT_SQL} SELECT CASE max(rank) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r WHERE file_path <> 'src/billing.js'")
def impact_risk(spark, sf_dir):
    return impact.overall_risk(Q._fixture_impact(spark).counts())


@query(f"""
SELECT file_path FROM {Q._SQL_FILES} t WHERE is_test AND EXISTS (SELECT 1 FROM {Q._SQL_FILES} c WHERE NOT c.is_test AND contains(t.file_path, regexp_replace(regexp_extract(c.file_path, '[^/]*$'), '(?i)\\.[a-z]+$', '')))
ORDER BY file_path LIMIT 60""")
def related_tests(spark, sf_dir):
    """Every file that isn't a test is a changed one."""
    files = Q._files(spark, sf_dir)
    return rollups.related_tests(files.filter("is_test").select("file_path"), files.filter("NOT is_test"))


@query(f"WITH l AS ({ORACLES['module_links']}), n AS (SELECT source AS node FROM l GROUP BY 1 ORDER BY sum(weight) DESC, node LIMIT 30) SELECT source, target, weight FROM l WHERE source IN (FROM n) AND target IN (FROM n) ORDER BY weight DESC, source, target LIMIT 80")
def visible_links(spark, sf_dir):
    links = QUERIES["module_links"](spark, sf_dir)
    nodes = links.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "node").limit(30)
    return rollups.visible_links(links, nodes)


_NEW_EDGES: X.Rows = [("calls", "src/orders.js", "audit", "src/billing.js", "refund", "refund", 66, False, 0.95)]


@query(f"WITH {_EDGES} SELECT type, from_file, to_name, line FROM e WHERE from_file NOT IN ('src/orders.js', 'src/cron.js') UNION ALL SELECT type, from_file, to_name, line FROM {X.values(_NEW_EDGES, X.EDGES_SCHEMA)}")
def edges_after_push(spark, sf_dir):
    changed = X.frame(spark, [("src/orders.js",), ("src/cron.js",), ("src/orders.js",)], "file_path string")
    out = graph.latest_edges(X.frame(spark, X.EDGES, X.EDGES_SCHEMA), X.frame(spark, _NEW_EDGES, X.EDGES_SCHEMA), changed, "from_file")
    return out.select("type", "from_file", "to_name", "line")


@query("SELECT conv_id::varchar AS file_path, role || turn AS name, turn AS start_line, coalesce(greatest(turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1), 1000) AS end_line FROM conversations")
def symbol_ends(spark, sf_dir):
    symbols = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.concat("role", F.col("turn").cast("string")).alias("name"), F.col("turn").alias("start_line"))
    return windows.end_by_next(symbols, ["file_path"], ["start_line"], F.lit(1000).cast("long"))


@query(f"""
WITH c AS (SELECT t.*, {Q._REASON} AS reason FROM {Q._T})
SELECT source, count(*) AS discovered, count_if(reason IS NULL) AS source_count, least(9, count_if(reason IS NULL)) AS n_selected, count_if(reason IS NULL) > 9 AS truncated FROM c GROUP BY source""")
def selection_counts(spark, sf_dir):
    return selection.selection_summary(selection.select_files(Q._trees(spark, sf_dir), ["source"], max_files=9), ["source"])


# -- tables by key, jobs and logs ---------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rollups.top_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("SELECT event_id::varchar AS sha, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, sha LIMIT 20")
def commit_log(spark, sf_dir):
    commits = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("sha"), "user_id", F.col("ts").alias("committed_at"), F.array("event_type").alias("paths"))
    return tables.commit_log(commits, "click").select("sha", "user_id")


_STATUS = "CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END"


def _jobs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS repository_id", "event_type AS kind", "event_id AS job_id", f"{_STATUS} AS status", "ts AS created_at", "CAST(ts AS timestamp) AS heartbeat_at", "'w' AS locked_by")


@query(f"""
WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE {_STATUS} <> 'done'), w AS (SELECT DISTINCT user_id, event_type, user_id % 2 = 0 AS force FROM events)
SELECT w.user_id AS repository_id, w.event_type AS kind, force, CASE WHEN NOT force THEN event_id END AS reused_id FROM w LEFT JOIN a ON a.user_id = w.user_id AND a.event_type = w.event_type AND n = 1""")
def job_reuse(spark, sf_dir):
    known = _jobs(spark, sf_dir)
    wanted = known.select("repository_id", "kind", (F.col("repository_id") % 2 == 0).alias("force")).distinct()
    return jobs.enqueue(known, wanted)


@query(f"""
WITH j AS (SELECT event_id, {_STATUS} AS status, ts < TIMESTAMP '2024-01-15' - INTERVAL 10 MINUTE AS late FROM events)
SELECT event_id AS job_id, CASE WHEN status = 'running' AND late THEN 'queued' ELSE status END AS status, CASE WHEN status = 'running' AND late THEN '' ELSE 'w' END AS locked_by FROM j""")
def job_recovery(spark, sf_dir):
    return jobs.recover(_jobs(spark, sf_dir), F.lit("2024-01-15").cast("timestamp")).select("job_id", "status", "locked_by")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id DESC) AS n FROM events), o AS (SELECT user_id, event_type, value, event_id FROM l WHERE n = 1 AND event_id % 2 = 1), w AS (SELECT user_id, event_type, value, event_id FROM l WHERE n = 1 AND event_id % 2 = 0)
SELECT w.user_id, w.event_type, CASE WHEN o.user_id IS NULL THEN w.value ELSE o.value END AS value, w.event_id FROM w LEFT JOIN o ON o.user_id = w.user_id UNION ALL SELECT * FROM o ANTI JOIN w USING (user_id)""")
def upsert_defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    old, new = (windows.latest_per_key(rows.filter(F.col("event_id") % 2 == i), ["user_id"], "event_id") for i in (1, 0))
    return upserts.upsert_defaults(old, new, ["user_id"], ["value"])


@query("SELECT event_id, user_id FROM events WHERE NOT (user_id % 2 = 0) OR event_type = 'click'")
def generation_cleanup(spark, sf_dir):
    return upserts.drop_generation(table(spark, sf_dir, "events"), F.col("user_id") % 2 == 0, "event_type", "click").select("event_id", "user_id")


@query("""
WITH w AS (SELECT doc_id, list_append(string_split(text, ' '), 'end') AS w, list_append(list_filter([{'k': source, 'v': 1}, {'k': lang, 'v': 2}, {'k': 'en', 'v': 3}], lambda x: x.k <> lang), {'k': lang, 'v': 9}) AS p FROM documents)
SELECT doc_id, array_to_string(w[greatest(1, len(w) - 49):], ' ') AS last_words, array_to_string(list_transform(p, lambda x: x.v::varchar), ',') AS versions FROM w""")
def list_updates(spark, sf_dir):
    item = lambda k, v: F.struct(k.alias("k"), F.lit(v).alias("v"))
    lang = F.col("lang")
    put = upserts.put_in_array(F.array(item(F.col("source"), 1), item(lang, 2), item(F.lit("en"), 3)), item(lang, 9), "k")
    words = upserts.append_bounded(F.split("text", " "), F.lit("end"))
    return Q._docs(spark, sf_dir).select("doc_id", F.array_join(words, " ").alias("last_words"), F.array_join(F.transform(put, lambda x: x["v"].cast("string")), ",").alias("versions"))


_PAGES_SCHEMA = "repo string, page int, items array<int>"
_PAGES: X.Rows = [("a", 1, list(range(100))), ("a", 2, list(range(100, 130))), ("a", 3, [1]), ("b", 1, list(range(100))), ("b", 2, list(range(100))), ("b", 3, list(range(100))), ("b", 4, [7]), ("c", 1, [])]


@query(f"""
WITH p AS (SELECT t.* FROM {X.values(_PAGES, _PAGES_SCHEMA)}), l AS (SELECT repo, min(page) AS last FROM p WHERE len(items) < 100 GROUP BY repo)
SELECT repo, page, unnest(range(len(items)))::int AS place, unnest(items) AS item FROM p LEFT JOIN l USING (repo) WHERE page <= least(3, coalesce(last, 3))""")
def landed_pages(spark, sf_dir):
    return tables.landed_pages(X.frame(spark, _PAGES, _PAGES_SCHEMA), ["repo"])


# -- texts and labels -----------------------------------------------------------------


@query("""
SELECT doc_id, substr(sha256(text), 1, 7) AS sha, n_chars || ' character' || CASE WHEN n_chars = 1 THEN '' ELSE 's' END AS amount, regexp_matches(upper(substr(source, 1, 1)) || substr(source, 2), '^[A-Z][A-Za-z0-9]*$') AS is_component, regexp_matches('use' || upper(source), '^use[A-Z]') AS is_hook,
 least(84, 8 + floor((doc_id % 100) / 100.0::double * 76 + 0.5::double))::int AS progress, CASE WHEN doc_id % 3 = 0 THEN 'private' WHEN coalesce(lang, '') <> '' THEN lang ELSE 'public' END AS visibility, CASE WHEN doc_id % 2 = 0 THEN 'merged' ELSE source END AS pull_state,
 doc_id % 5 = 0 OR NOT (coalesce(lang, '') IN ('indexed', 'partial') AND source = lang) AS index_needed
FROM documents""")
def labels_of_records(spark, sf_dir):
    source, lang, n = F.col("source"), F.coalesce("lang", F.lit("")), F.col("doc_id")
    return Q._docs(spark, sf_dir).select(
        "doc_id", text.short_sha(F.sha2("text", 256)).alias("sha"), text.pluralise(F.col("n_chars"), "character").alias("amount"),
        text.is_component_name(text.capitalized(source)).alias("is_component"), text.is_hook_name(F.concat(F.lit("use"), F.upper(source))).alias("is_hook"),
        text.progress((n % 100) / 100).alias("progress"), access.visibility(n % 3 == 0, lang).alias("visibility"), access.pull_state(source, F.when(n % 2 == 0, F.lit("2024-01-01"))).alias("pull_state"),
        jobs.index_needed(lang, source, lang, n % 5 == 0).alias("index_needed"),
    )


@query("""
WITH c AS (SELECT doc_id, n_chars, greatest(1200, floor(9000 / 3.0::double + 0.5::double))::bigint AS cap, sha256(source) AS a, sha256(lang) AS b, source, lang FROM documents)
SELECT doc_id, CASE WHEN n_chars > cap THEN cap + 22 ELSE n_chars END AS size, CASE WHEN doc_id % 2 = 0 AND a <> b THEN 'sha-moved' WHEN source <> lang THEN 'content-moved' END AS moved, n_chars + 1 AS additions, doc_id + 2 AS deletions FROM c""")
def patch_limits(spark, sf_dir):
    sha = lambda c: F.when(F.col("doc_id") % 2 == 0, F.sha2(c, 256)).otherwise("")
    part = lambda a, d: F.struct(a.cast("long").alias("additions"), d.cast("long").alias("deletions"))
    totals = patches.line_totals(F.array(part(F.col("n_chars"), F.col("doc_id")), part(F.lit(1), F.lit(2))))
    moved = patches.base_moved(sha("source"), sha("lang"), F.col("source"), F.col("lang"))
    return Q._docs(spark, sf_dir).select("doc_id", packing.diff_size(F.col("n_chars").cast("long"), F.lit(3), F.lit(9000)).alias("size"), moved.alias("moved"), F.inline(F.array(totals)))


@query("""
SELECT doc_id, 'file: ' || source || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' | function: ' || lang END || ' | lines: 1-' || n_chars || CASE WHEN doc_id % 2 = 0 THEN ' | doc: even' ELSE '' END || chr(10) || text AS chunk,
 substr(CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN ' ' ELSE trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) END, 1, 2400) AS embedded,
 '[' || doc_id || '] ' || source || ':1-' || n_chars || ' (function ' || lang || ')' AS reference,
 CASE WHEN doc_id % 2 = 0 THEN 'Nothing in the index supports an answer: ' || doc_id || ' files and ' || n_chars || ' symbols were searched.' END AS refusal
FROM documents""")
def chunk_headers(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    docs = Q._docs(spark, sf_dir).select("doc_id", F.col("source").alias("file_path"), F.lit("function").alias("symbol_type"), F.col("lang").alias("symbol_name"), F.lit(1).alias("start_line"), F.col("n_chars").alias("end_line"), "text")
    name = F.when(F.col("doc_id") % 4 == 0, "<module>").otherwise(F.col("symbol_name"))
    chunk = text.chunk_text(F.col("file_path"), F.col("symbol_type"), name, F.col("start_line"), F.col("end_line"), F.when(even, "even").otherwise(""), F.col("text"))
    refusal = retrieval.grounding(F.when(even, 0).otherwise(1), F.col("doc_id"), F.col("end_line"))
    return docs.select("doc_id", chunk.alias("chunk"), text.embedding_text(F.col("text")).alias("embedded"), retrieval.chunk_reference(F.col("doc_id")).alias("reference"), refusal.alias("refusal"))


_SPACES = "' ' || chr(9) || chr(10) || chr(13)"


@query(f"""
WITH w AS (SELECT doc_id, source, lang, text, trim(regexp_replace(lower(text), '[^a-z0-9\\s-]', '', 'g'), {_SPACES}) AS w FROM documents), s AS (SELECT *, regexp_replace(substr(array_to_string(regexp_split_to_array(w, '\\s+')[1:6], '-'), 1, 42), '^-+|-+$', '', 'g') AS slug FROM w)
SELECT doc_id, 'change/' || CASE WHEN slug = '' THEN 'ai-change' ELSE slug END || '-x' AS branch, trim(source, {_SPACES}) || chr(10) || chr(10) || trim(lang, {_SPACES}) AS envelope,
 array_to_string(list_filter(list_transform(string_split(source || ', a,,' || lang || ' ,a,', ','), lambda x: trim(x, {_SPACES})), lambda x, i: x <> '' AND NOT list_contains(list_transform(string_split(source || ', a,,' || lang || ' ,a,', ','), lambda y: trim(y, {_SPACES}))[1:i - 1], x)), '|') AS paths,
 substr(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*\\*?\\s?', ''), {_SPACES})), lambda x: x <> ''), ' '), 1, 400) AS doc
FROM s""")
def text_forms(spark, sf_dir):
    source, lang, body = F.col("source"), F.col("lang"), F.col("text")
    listed = text.path_list(F.concat(source, F.lit(", a,,"), lang, F.lit(" ,a,")))
    return Q._docs(spark, sf_dir).select("doc_id", text.branch_slug(body, F.lit("x")).alias("branch"), text.envelope(source, lang).alias("envelope"), F.array_join(listed, "|").alias("paths"), text.doc_comment(body).alias("doc"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), h AS (SELECT *, (len(l) + 1) // 2 AS h FROM l),
p AS (SELECT *, list_transform(l, lambda x, i: lpad(i::varchar, 4, ' ') || '| ' || x) AS x FROM h)
SELECT doc_id, '--- lines 1-' || h || ' of ' || len(l) || ' ---' || chr(10) || array_to_string(x[1:h], chr(10)) || CASE WHEN h < len(l) THEN chr(10) || chr(10) || '--- lines ' || (h + 1) || '-' || len(l) || ' of ' || len(l) || ' ---' || chr(10) || array_to_string(x[h + 1:], chr(10)) ELSE '' END AS excerpt FROM p""")
def numbered_excerpts(spark, sf_dir):
    """Both halves of every text."""
    n = F.size(F.split("text", "\n"))
    half = F.floor((n + 1) / 2).cast("int")
    both = F.array(F.struct(F.lit(1).alias("start"), half.alias("end")), F.struct((half + 1).alias("start"), n.alias("end")))
    return Q._docs(spark, sf_dir).select("doc_id", text.numbered_windows(F.col("text"), F.filter(both, lambda w: w["start"] <= w["end"])).alias("excerpt"))


@query("SELECT file_path, chunk_no FROM (SELECT source AS file_path, doc_id AS chunk_no FROM documents) ORDER BY file_path, chunk_no LIMIT 6000")
def capped_chunks(spark, sf_dir):
    return chunking.cap_chunks(Q._docs(spark, sf_dir).select(F.col("source").alias("file_path"), F.col("doc_id").alias("chunk_no")))


# -- sources and rendered texts ---------------------------------------------------------


@query("SELECT b.item_id AS path, d.sha FROM benchmark b LEFT JOIN (SELECT doc_id, substr(sha256(text), 1, 40) AS sha FROM documents) d ON d.doc_id = b.item_id")
def path_identities(spark, sf_dir):
    entries = Q._docs(spark, sf_dir).select(F.col("doc_id").alias("path"), text.content_sha(F.col("text")).alias("sha"))
    return tables.identities(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path")), entries)


@query("""
WITH b AS (SELECT DISTINCT o_custkey AS sha FROM orders WHERE o_orderkey % 3 <> 0), h AS (SELECT DISTINCT o_custkey AS sha FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 15 = 0), c AS (SELECT (SELECT count(*) FROM h ANTI JOIN b USING (sha)) AS ahead_by, (SELECT count(*) FROM b ANTI JOIN h USING (sha)) AS behind_by)
SELECT ahead_by, behind_by, CASE WHEN ahead_by > 0 AND behind_by > 0 THEN 'diverged' WHEN ahead_by > 0 THEN 'ahead' WHEN behind_by > 0 THEN 'behind' ELSE 'identical' END AS status FROM c""")
def history_compare(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha"), "o_orderkey")
    return tables.compare_commits(orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 5 <> 0 OR o_orderkey % 15 = 0"))


@query("SELECT DISTINCT e.user_id AS number, d.doc_id AS sha FROM documents d JOIN events e ON d.doc_id IN (e.event_id, e.event_id + 1)")
def pulls_of_commits(spark, sf_dir):
    pulls = table(spark, sf_dir, "events").select(F.col("user_id").alias("number"), F.array(F.col("event_id"), F.col("event_id") + 1).alias("commits"))
    return tables.pulls_of_commits(Q._docs(spark, sf_dir).select(F.col("doc_id").alias("sha")), pulls)


_LANDED: X.Rows = [
    (1, '{"name": "main", "protected": true, "commit": {"sha": "a1", "commit": {"message": "first", "author": {"name": "A", "date": "2024-01-02T03:04:05Z"}}}}', '{"id": 5, "account": {"login": "acme", "type": "Organization"}, "repository_selection": "all"}', '{"Python": 120, "C": 7}'),
    (2, '{"name": "dev", "commit": {"sha": "b2"}}', '{"id": 6}', "{}"), (3, '{"name": "x/y", "protected": false, "commit": {"sha": "c3", "commit": {"message": "third", "author": null}}}', '{"id": 7, "account": {"login": "b"}, "repository_selection": "selected"}', None),
]
_LANDED_SCHEMA = "n int, branch string, installation string, languages string"


@query(f"""
SELECT doc_id, branch ->> '$.name' AS name, branch ->> '$.commit.sha' AS sha, coalesce(branch ->> '$.commit.commit.message', '') AS message, coalesce(branch ->> '$.commit.commit.author.name', '') AS author, coalesce(branch ->> '$.protected', 'false') = 'true' AS protected,
 coalesce(installation ->> '$.account.login', '') AS account, coalesce(installation ->> '$.account.type', '') AS account_type, installation ->> '$.repository_selection' AS repository_selection, coalesce(languages ->> '$.Python', '0')::bigint AS python_bytes
FROM {Q._of_documents_sql(_LANDED, _LANDED_SCHEMA)}""")
def landed_records(spark, sf_dir):
    rows = Q._of_documents(spark, sf_dir, _LANDED, _LANDED_SCHEMA)
    b, i, found = tables.branches(F.col("branch")), tables.installations(F.col("installation")), tables.languages(F.col("languages"))
    return rows.select("doc_id", *[b[c].alias(c) for c in ("name", "sha", "message", "author", "protected")], *[i[c].alias(c) for c in ("account", "account_type", "repository_selection")], F.coalesce(F.try_element_at(found, F.lit("Python")), F.lit(0)).alias("python_bytes"))


@query(f"""
WITH j AS (SELECT event_id, {_STATUS} AS status, event_id % 4 = 1 AS over, CASE WHEN event_id % 8 = 1 THEN repeat('e', 301) END AS error FROM events)
SELECT event_id AS job_id, CASE WHEN NOT over THEN status WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, substr(error, 1, 300) AS message, over AS done FROM j""")
def job_ends(spark, sf_dir):
    known = _jobs(spark, sf_dir)
    ended = known.filter("job_id % 4 = 1").select("job_id", F.when(F.col("job_id") % 8 == 1, F.repeat(F.lit("e"), 301)).alias("error"))
    return jobs.finish(known, ended, F.lit("2024-02-01").cast("timestamp")).select("job_id", "status", "message", F.col("completed_at").isNotNull().alias("done"))


@query("""
SELECT doc_id, concat_ws(chr(10), '## Summary', nullif(lang, ''), '## Files changed', '- `' || source || '` (+' || n_chars || ' / -1)' || chr(10) || '- `b` (+2 / -3)', CASE WHEN doc_id % 2 = 0 THEN '## Why' || chr(10) || lang || chr(10) END, CASE WHEN doc_id % 3 = 0 THEN '## Review notes' || chr(10) || '- ' || source || chr(10) || '- w' || chr(10) END,
 CASE WHEN doc_id % 5 = 0 THEN '## Callers to double-check' || chr(10) || '- `' || source || '`' || chr(10) END, '## Requested change', '> ' || lang, '---', 'end') AS body,
 concat_ws(chr(10), '## Review', '**Risk:** ' || lang || ' · **Findings:** 2 · **Files reviewed:** ' || n_chars, nullif(source, ''), CASE WHEN doc_id % 2 = 0 THEN '### HIGH' || chr(10) || chr(10) || '**t** — `' || source || ':4` _(LIKELY)_' || chr(10) || chr(10) || 'i' || chr(10) || chr(10) || '> r' END,
 '### LOW' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 1 THEN '**t** — `' || source || ':4` _(LIKELY)_' || chr(10) || chr(10) || 'i' || chr(10) || chr(10) || '> r' || chr(10) || chr(10) ELSE '' END || '**u** — `b` _(POSSIBLE)_' || chr(10) || chr(10) || 'j' || chr(10) || chr(10) || '> s', CASE WHEN doc_id % 3 = 0 THEN '### Test gaps' || chr(10) || '- ' || source || chr(10) || '- w' END, '---', 'end') AS comment
FROM documents""")
def rendered_texts(spark, sf_dir):
    source, lang, even = F.col("source"), F.col("lang"), F.col("doc_id") % 2 == 0
    file = lambda path, a, d: F.struct(path.alias("path"), a.cast("long").alias("additions"), F.lit(d).alias("deletions"))
    finding = lambda **c: F.struct(*[v.alias(k) if not isinstance(v, (str, int)) else F.lit(v).alias(k) for k, v in c.items()])
    notes = F.when(F.col("doc_id") % 3 == 0, F.array(source, F.lit("w")))
    callers = F.when(F.col("doc_id") % 5 == 0, F.array(source)).otherwise(F.array().cast("array<string>"))
    found = F.array(
        finding(severity=F.when(even, "HIGH").otherwise("LOW"), title="t", file_path=source, line=4, confidence="LIKELY", issue="i", recommendation="r"), finding(severity=F.lit("LOW"), title="u", file_path=F.lit("b"), line=0, confidence="POSSIBLE", issue="j", recommendation="s")
    )
    body = text.change_body(lang, F.array(file(source, F.col("n_chars"), 1), file(F.lit("b"), F.lit(2), 3)), F.when(even, lang).otherwise(""), notes, callers, lang, F.lit("end"))
    comment = text.review_comment("Review", lang, F.col("n_chars"), source, found, notes, F.lit(None).cast("array<string>"), F.lit("end"))
    return Q._docs(spark, sf_dir).select("doc_id", body.alias("body"), comment.alias("comment"))
