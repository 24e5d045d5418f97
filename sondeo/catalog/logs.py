"""Queries on search logs: joins between calls, searches and expands, and the indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.catalog import standins as st
from sondeo.catalog.base import ctes, query, table
from sondeo.catalog.text_functions import STATE_SQL
from sondeo.functions import logs as lf
from sondeo.operators import canary
from sondeo.operators import loganalytics as la
from sondeo.operators.filters import with_version
from sondeo.operators.judging import stratified
from sondeo.sources import evalsets, transcripts

# -- shared derived tables ---------------------------------------------------------------------------------------------------

CONTENTS = """contents AS (SELECT search_id, rank, document, chunk_index, repeat('lörem ipsum ' || document, 20 * (1 + chunk_index) * rank * rank * 5)::VARCHAR AS content FROM hits WHERE rank < 4)"""
PRINTED = """printed AS (
  SELECT h.search_id, h.rank, '--- Result ' || h.rank::VARCHAR || ' (score: ' || h.score::VARCHAR || ') ---' || chr(10) || 'Collection: ' || s.collection || ' | Document: ' || h.document || ' | Chunk: ' || h.chunk_index::VARCHAR || chr(10) || c.content || chr(10) AS txt
  FROM hits h JOIN contents c USING (search_id, rank) JOIN searches s USING (search_id))"""
REGISTRY = """registry AS (SELECT DISTINCT 'fp' || (user_id % 6)::VARCHAR AS fingerprint, CASE WHEN user_id % 6 = 1 THEN '' ELSE 'rerank' END AS rr FROM searches WHERE user_id % 6 < 4)"""
STARTS = "starts AS (SELECT ts FROM errors WHERE code = 'start_initiated' AND (server LIKE 'embedding%' OR server LIKE 'reranker%'))"
COLD = "cold AS (SELECT search_id, (EXISTS (SELECT 1 FROM starts st WHERE st.ts BETWEEN s.ts - to_microseconds(s.duration_ms * 1000::BIGINT + 1000000) AND s.ts)) AS cold FROM searches s)"
ITEMS = """items AS (
  SELECT s.*, coalesce(nullif(s.code_version, ''), 'unversioned') AS version, cold.cold, coalesce(r.rr <> '', false) AS complete, coalesce(o.output_chars, 0) AS output_chars
  FROM searches s JOIN cold USING (search_id) LEFT JOIN registry r ON r.fingerprint = s.config_fingerprint
  LEFT JOIN (SELECT search_id, (sum(length(txt)) + count(*) - 1)::BIGINT AS output_chars FROM printed GROUP BY 1) o USING (search_id)),
grouped AS (SELECT 'all' AS version_group, * FROM items UNION ALL SELECT version, * FROM items)"""
ITEM_CTES = (st.LOGS, CONTENTS, PRINTED, REGISTRY, STARTS, COLD, ITEMS)
JOINED = """joined AS (SELECT s.*, coalesce(nullif(s.code_version, ''), 'unversioned') AS version, c.tool_use_id, c.session_id, c.cwd, c.result_ts, c.result_text,
  CASE WHEN c.cwd LIKE '%/alpha%' THEN 'alpha' WHEN c.cwd LIKE '%/beta/%' THEN 'beta' END AS project FROM searches s JOIN calls c ON c.origin = s.search_id),
related AS (SELECT *, CASE WHEN collection NOT LIKE '%-reference' THEN NULL WHEN project IS NULL THEN 'unknown_project' WHEN collection = project || '-reference' THEN 'own' ELSE 'foreign' END AS relation FROM joined),
rgrouped AS (SELECT 'all' AS version_group, * FROM related UNION ALL SELECT version, * FROM related)"""


def contents(spark, sf):
    h = st.hits(spark, sf).filter("rank < 4")
    times = (F.lit(20) * (1 + F.col("chunk_index")) * F.col("rank") * F.col("rank") * 5).cast("int")
    return h.select("search_id", "rank", "document", "chunk_index", F.repeat(F.concat(F.lit("lörem ipsum "), F.col("document")), times).alias("content"))


def registry(spark, sf):
    s = st.searches(spark, sf).filter("user_id % 6 < 4")
    model = lambda preset: F.struct(F.lit("p").alias("preset"), preset.alias("model_name"))
    return s.select(
        F.concat(F.lit("fp"), (F.col("user_id") % 6).cast("string")).alias("fingerprint"), F.lit("2024").alias("first_seen"),
        model(F.lit("embed")).alias("embedding"), model(F.when(F.col("user_id") % 6 == 1, "").otherwise("rerank")).alias("reranker"))


def items(spark, sf):
    s = with_version(st.searches(spark, sf))
    s = la.with_cold_start(s, la.start_events(st.errors(spark, sf)))
    s = la.with_provenance(s, registry(spark, sf))
    return s.join(la.output_sizes(s, st.hits(spark, sf), contents(spark, sf)), "search_id")


def joined(spark, sf):
    c = st.calls(spark, sf).filter("origin IS NOT NULL").select("tool_use_id", "session_id", "cwd", "result_ts", "result_text", F.col("origin").alias("search_id"))
    return with_version(st.searches(spark, sf)).join(c, "search_id")


def related(spark, sf):
    return la.with_relation(joined(spark, sf), la.known_projects(st.searches(spark, sf)))


def attributions(spark, sf):
    return la.attribute_expands(st.expands(spark, sf), st.searches(spark, sf), st.hits(spark, sf))


# -- joins -----------------------------------------------------------------------------------------------------------------

@query("j01_calls_to_searches")
def j01(spark, sf):
    return la.join_calls_to_searches(st.calls(spark, sf), st.searches(spark, sf), "event_id", "event_id")


@query("j01_unique_windows", ctes(st.LOGS) + """,
timed AS (SELECT event_id AS call_id, query, collection, document, exclude, tool_use_ts - INTERVAL 2 SECOND AS lo, result_ts + INTERVAL 2 SECOND AS hi FROM calls WHERE result_ts IS NOT NULL),
pairs AS (SELECT c.call_id, s.search_id FROM timed c JOIN searches s ON s.query IS NOT DISTINCT FROM c.query AND s.collection IS NOT DISTINCT FROM c.collection
  AND s.document IS NOT DISTINCT FROM c.document AND s.exclude IS NOT DISTINCT FROM c.exclude AND s.ts BETWEEN c.lo AND c.hi)
SELECT call_id, search_id FROM pairs WHERE call_id IN (SELECT call_id FROM pairs GROUP BY 1 HAVING count(*) = 1) AND search_id IN (SELECT search_id FROM pairs GROUP BY 1 HAVING count(*) = 1)""".replace(",\ntimed", ",\ntimed"))
def j01b(spark, sf):
    """The part of the interval join without competition, where plain SQL has the same answer."""
    calls, log = st.calls(spark, sf), st.searches(spark, sf)
    got = la.join_calls_to_searches(calls, log, "event_id", "event_id")
    k = [F.coalesce(F.col(c), F.lit("\u0000")).alias(c) for c in la.SEARCH_KEY]
    us = lf.micros
    c = calls.filter("result_ts IS NOT NULL").select(F.col("event_id").alias("call_id"), *k, (us(F.col("tool_use_ts")) - 2000000).alias("lo"), (us(F.col("result_ts")) + 2000000).alias("hi"))
    s = log.select("search_id", *k, us(F.col("ts")).alias("at"))
    pairs = c.join(s, la.SEARCH_KEY).filter("at BETWEEN lo AND hi").select("call_id", "search_id")
    one = lambda key: pairs.groupBy(key).agg(F.count("*").alias("n")).filter("n = 1").select(key)
    return got.join(one("call_id"), "call_id", "left_semi").join(one("search_id"), "search_id", "left_semi")


ATTRIBUTED = """listed AS (SELECT s.search_id, s.ts, s.collection, h.document, h.chunk_index, h.rank FROM searches s JOIN hits h USING (search_id)),
options AS (SELECT e.expand_id, l.search_id, CASE WHEN l.chunk_index = e.chunk_index THEN 'exact' ELSE 'document' END AS kind, l.ts, l.rank,
  row_number() OVER (PARTITION BY e.expand_id ORDER BY (l.chunk_index = e.chunk_index) DESC, l.ts DESC, l.search_id, l.rank) AS pick
  FROM expands e JOIN listed l ON l.collection = e.collection AND l.document = e.document AND l.ts <= e.ts AND e.ts <= l.ts + INTERVAL 60 MINUTE),
attributed AS (SELECT e.expand_id, o.search_id, o.kind, o.rank AS hit_rank FROM expands e LEFT JOIN options o ON o.expand_id = e.expand_id AND o.pick = 1)"""


@query("j02_expand_attribution", ctes(st.LOGS, ATTRIBUTED) + "SELECT * FROM attributed")
def j02(spark, sf):
    return attributions(spark, sf).select("expand_id", "search_id", "kind", "hit_rank")


@query("j03_cold_start", ctes(st.LOGS, STARTS, COLD) + "SELECT search_id, cold FROM cold")
def j03(spark, sf):
    return la.with_cold_start(st.searches(spark, sf), la.start_events(st.errors(spark, sf))).select("search_id", "cold")


@query("j04_fuzzy_commands", ctes(st.LOGS) + """,
commands AS (SELECT event_id, ts + to_seconds(event_id % 200) AS ts, 'tool search "' || query || '" ' || collection AS command FROM searches)
SELECT s.search_id, min(c.event_id) AS event_id FROM searches s JOIN commands c ON contains(c.command, s.collection) AND contains(c.command, left(s.query, 40))
 AND abs(epoch_us(s.ts) - epoch_us(c.ts)) < 120000000 GROUP BY 1""")
def j04(spark, sf):
    s = st.searches(spark, sf)
    commands = s.select("event_id", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 200 * 1000000).alias("ts"),
                        F.concat(F.lit('tool search "'), F.col("query"), F.lit('" '), F.col("collection")).alias("command"))
    return la.match_commands(s, commands, "event_id").select("search_id", "event_id")


@query("j05_hit_contents", ctes(st.LOGS, CONTENTS) + "SELECT h.search_id, h.rank, h.document, length(c.content) AS size FROM hits h JOIN contents c USING (search_id, rank)")
def j05(spark, sf):
    size = F.length("content").cast("long").alias("size")
    return la.hit_contents(st.hits(spark, sf), contents(spark, sf), [size]).select("search_id", "rank", "document", "size")


@query("j06_provenance", ctes(st.LOGS, REGISTRY) + "SELECT s.search_id, coalesce(r.rr <> '', false) AS complete FROM searches s LEFT JOIN registry r ON r.fingerprint = s.config_fingerprint")
def j06(spark, sf):
    return la.with_provenance(st.searches(spark, sf), registry(spark, sf)).select("search_id", "complete")


READBACKS = """readbacks AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'other' ELSE session_id END AS session_id, result_ts + to_seconds(CASE WHEN event_id % 4 = 0 THEN -5 ELSE 60 END) AS ts,
  'poread /tmp/u/tool-results/out' || (event_id // 10 * 10)::VARCHAR || '.txt' AS text FROM calls WHERE origin IS NOT NULL AND result_ts IS NOT NULL)"""


def readbacks(spark, sf):
    e = F.col("event_id")
    return st.calls(spark, sf).filter("origin IS NOT NULL AND result_ts IS NOT NULL").select(
        F.when(e % 3 == 0, "other").otherwise(F.col("session_id")).alias("session_id"),
        F.timestamp_micros(F.unix_micros("result_ts") + F.when(e % 4 == 0, -5).otherwise(60) * 1000000).alias("ts"),
        F.concat(F.lit("poread /tmp/u/tool-results/out"), (F.floor(e / 10) * 10).cast("string"), F.lit(".txt")).alias("text"))


COMMANDS = """commands AS (SELECT tool_use_id, first(session_id ORDER BY search_id) AS session_id, first(result_ts ORDER BY search_id) AS result_ts, first(result_text ORDER BY search_id) AS result_text, count(*) AS n FROM joined GROUP BY 1),
saved AS (SELECT tool_use_id, regexp_extract(result_text, 'saved to: (\\S+)', 1) AS path, session_id, result_ts FROM commands WHERE starts_with(result_text, '<persisted-output>')),
back AS (SELECT DISTINCT s.tool_use_id FROM saved s JOIN readbacks r ON r.session_id = s.session_id AND r.ts > s.result_ts AND contains(r.text, s.path))"""


@query("j14_read_back", ctes(st.LOGS, JOINED, READBACKS, COMMANDS) + "SELECT tool_use_id FROM back")
def j14(spark, sf):
    j = joined(spark, sf)
    commands = j.groupBy("tool_use_id").agg(F.min_by(F.struct("session_id", "result_ts", "result_text"), "search_id").alias("c")).select("tool_use_id", "c.*")
    return la.read_back_commands(commands, readbacks(spark, sf))


# -- indicators --------------------------------------------------------------------------------------------------------------

def pick_sql(value: str, q: float, where: str) -> str:
    """Element min(n - 1, int(n * q)) of the sorted values."""
    lst = f"list({value} ORDER BY {value}) FILTER ({where})"
    return f"({lst})[least(len({lst}), floor(len({lst}) * {q}::DOUBLE)::BIGINT + 1)]"


@query("a23_technical_indicators", ctes(*ITEM_CTES) + f""",
full_len AS (SELECT version_group, max(hit_count) AS full_length FROM grouped GROUP BY 1)
SELECT g.version_group, count(*) AS searches, count(*) FILTER (complete) AS provenance_complete, count(*) FILTER (hit_count = 0) AS zero_hit,
 count(*) FILTER (hit_count = 0 AND candidates = 0) AS zero_hit_no_candidates, any_value(full_length) AS full_length, count(*) FILTER (output_chars > 30000) AS output_over_threshold,
 count(*) FILTER (hit_count > 0 AND hit_count < full_length) AS partial, count(*) FILTER (cold) AS cold, {pick_sql('duration_ms', 0.5, 'cold')} AS cold_p50,
 count(*) FILTER (NOT cold) AS warm, {pick_sql('duration_ms', 0.5, 'NOT cold')} AS warm_p50, {pick_sql('duration_ms', 0.9, 'NOT cold')} AS warm_p90, max(duration_ms) FILTER (NOT cold) AS warm_max,
 {pick_sql('output_chars', 0.5, 'true')} AS output_p50, {pick_sql('output_chars', 0.9, 'true')} AS output_p90, max(output_chars) AS output_max
FROM grouped g JOIN full_len f USING (version_group) GROUP BY 1""")
def a23(spark, sf):
    return la.technical_indicators(items(spark, sf))


@query("a24_relevance_indicators", ctes(*ITEM_CTES, ATTRIBUTED) + """,
per AS (SELECT search_id, count(*) FILTER (kind = 'exact') AS ex, count(*) FILTER (kind = 'document') AS dc FROM attributed GROUP BY 1),
docs AS (SELECT search_id, count(DISTINCT document) AS d FROM hits GROUP BY 1)
SELECT version_group, count(*) AS searches, count(*) FILTER (ex > 0) AS searches_with_exact_expand, count(*) FILTER (dc > 0) AS searches_with_document_expand,
 coalesce(sum(ex), 0)::BIGINT AS exact_expands, coalesce(sum(dc), 0)::BIGINT AS document_expands, count(*) FILTER (hit_count >= 2) AS lists_considered,
 (median(d) FILTER (hit_count >= 2))::DOUBLE AS median_distinct_documents, count(*) FILTER (hit_count >= 2 AND d = 1) AS single_document_lists
FROM grouped LEFT JOIN per USING (search_id) LEFT JOIN docs USING (search_id) GROUP BY 1""")
def a24(spark, sf):
    return la.relevance_indicators(with_version(st.searches(spark, sf)), st.hits(spark, sf), attributions(spark, sf))


@query("a24_exact_rank_counts", ctes(*ITEM_CTES, ATTRIBUTED) + """
SELECT version_group, hit_rank, count(*) AS n FROM grouped JOIN attributed USING (search_id) WHERE kind = 'exact' GROUP BY ALL""")
def a24b(spark, sf):
    return la.exact_rank_counts(with_version(st.searches(spark, sf)), attributions(spark, sf))


@query("a25_score_profile", ctes(*ITEM_CTES) + """,
ranks(rank) AS (VALUES (1), (3), (6), (12)), g AS (SELECT DISTINCT version_group FROM grouped)
SELECT g.version_group, r.rank, count(h.score) AS n, round(median(h.score), 4) AS median FROM g CROSS JOIN ranks r
LEFT JOIN (SELECT version_group, rank, score FROM grouped JOIN hits USING (search_id)) h ON h.version_group = g.version_group AND h.rank = r.rank GROUP BY ALL""")
def a25(spark, sf):
    return la.score_profile(with_version(st.searches(spark, sf)), st.hits(spark, sf))


@query("a26_overflow", ctes(st.LOGS, JOINED, READBACKS, COMMANDS) + """,
counts AS (SELECT version_group, tool_use_id, count(*) AS n FROM rgrouped GROUP BY ALL)
SELECT version_group, count(*) AS commands, count(*) FILTER (s.tool_use_id IS NOT NULL) AS persisted, count(*) FILTER (b.tool_use_id IS NOT NULL) AS read_back,
 count(*) FILTER (n = 1) AS single_commands, count(*) FILTER (n = 1 AND s.tool_use_id IS NOT NULL) AS single_persisted,
 count(*) FILTER (n > 1) AS multi_commands, count(*) FILTER (n > 1 AND s.tool_use_id IS NOT NULL) AS multi_persisted
FROM counts c LEFT JOIN saved s USING (tool_use_id) LEFT JOIN back b USING (tool_use_id) GROUP BY 1""")
def a26(spark, sf):
    return la.overflow_indicators(joined(spark, sf), readbacks(spark, sf))


@query("a27_reference_reach", ctes(st.LOGS, JOINED) + """,
per AS (SELECT version_group, session_id, bool_or(relation IS NOT NULL) AS a, count(DISTINCT collection) FILTER (relation = 'foreign') AS f, coalesce(bool_or(relation = 'own'), false) AS o,
  first(project ORDER BY ts, search_id) AS p, count(*) FILTER (collection LIKE '%-reference') AS refs FROM rgrouped GROUP BY ALL)
SELECT version_group, count(*) AS sessions, count(*) FILTER (a) AS with_reference, count(*) FILTER (f > 0) AS with_foreign, count(*) FILTER (o) AS with_own,
 count(*) FILTER (f = 0) AS foreign_0, count(*) FILTER (f = 1) AS foreign_1, count(*) FILTER (f = 2) AS foreign_2, count(*) FILTER (f >= 3) AS foreign_3,
 count(*) FILTER (p IS NULL) AS unknown_project_sessions, sum(refs)::BIGINT AS reference_searches FROM per GROUP BY 1""")
def a27(spark, sf):
    return la.reference_reach(related(spark, sf))


@query("a28_reference_collections", ctes(st.LOGS, JOINED) + """
SELECT collection, count(*) FILTER (relation = 'own') AS own, count(*) FILTER (relation = 'foreign') AS foreign, count(*) FILTER (relation = 'unknown_project') AS unknown_project,
 count(DISTINCT session_id) FILTER (relation = 'own') AS own_sessions, count(DISTINCT session_id) FILTER (relation = 'foreign') AS foreign_sessions
FROM related WHERE relation IS NOT NULL GROUP BY 1""")
def a28(spark, sf):
    return la.reference_collections(related(spark, sf))


@query("a29_attempts", ctes(st.LOGS, JOINED) + f"""
SELECT (SELECT count(*) FROM calls) AS attempts, (SELECT count(*) FROM joined) AS executed_with_log_row,
 count(*) FILTER (state = 'hook_blocked') AS hook_blocked, count(*) FILTER (state <> 'hook_blocked') AS executed_without_log_row,
 (SELECT count(*) FROM searches WHERE search_id NOT IN (SELECT search_id FROM joined)) AS searches_without_call
FROM (SELECT {STATE_SQL} AS state FROM calls WHERE origin IS NULL)""")
def a29(spark, sf):
    return la.attempts(joined(spark, sf), st.calls(spark, sf).filter("origin IS NULL"), st.searches(spark, sf))


@query("a29_refusals_by_hook", ctes(st.LOGS) + f"""
SELECT regexp_extract(result_text, '([a-z0-9_]+[.]py)', 1) || ': ' || regexp_extract(result_text, 'py\\]: ([^\\n]*)', 1) AS hook, count(*) AS n
FROM calls WHERE {STATE_SQL} = 'hook_blocked' GROUP BY 1""")
def a29b(spark, sf):
    return la.refusals_by_hook(st.calls(spark, sf).filter("origin IS NULL"))


@query("a30_version_groups", ctes(st.LOGS) + """
SELECT coalesce(version, 'all') AS version_group, count(*) AS searches, sum(hit_count)::BIGINT AS hits FROM (SELECT *, coalesce(nullif(code_version, ''), 'unversioned') AS version FROM searches) GROUP BY GROUPING SETS ((version), ())""")
def a30(spark, sf):
    g = la.by_version(with_version(st.searches(spark, sf)))
    return g.groupBy("version_group").agg(F.count("*").alias("searches"), F.sum("hit_count").alias("hits"))


@query("a31_error_summary", ctes(st.LOGS) + "SELECT server, code, count(*) AS n FROM errors GROUP BY GROUPING SETS ((code), (server), (server, code))")
def a31(spark, sf):
    return la.error_summary(st.errors(spark, sf))


@query("a31_log_failures", ctes(st.LOGS) + """
SELECT c.code, count(e.code) AS n FROM (VALUES ('log_write_failed'), ('log_config_resolve_failed')) c(code) LEFT JOIN errors e USING (code) GROUP BY 1""")
def a31b(spark, sf):
    return la.log_failures(st.errors(spark, sf))


@query("a33_latency_stats", f"""
SELECT event_type, count(*) AS n, avg(value) AS mean, {pick_sql('value', 0.5, 'true')} AS p50, {pick_sql('value', 0.95, 'true')} AS p95, {pick_sql('value', 0.99, 'true')} AS p99, max(value) AS max,
 first(value ORDER BY ts, event_id) AS cold, (sum(value) - first(value ORDER BY ts, event_id)) / (count(*) - 1) AS mean_warm FROM events GROUP BY 1""")
def a33(spark, sf):
    return la.latency_stats(table(spark, sf, "events"), ["event_type"], "value", ["ts", "event_id"])


SIZES = """sizes AS (SELECT search_id, rank, length(t) AS chars, strlen(t) AS bytes FROM (
  SELECT search_id, rank, regexp_replace(txt, '^--- Result \\d+', '--- Result 1') AS t FROM printed))"""


def _sizes(spark, sf):
    return la.printed_sizes(st.hits(spark, sf), st.searches(spark, sf), contents(spark, sf))


@query("a34_output_sizes", ctes(st.LOGS, CONTENTS, PRINTED, SIZES) + f"""
SELECT unit, count(*) AS n, {pick_sql('size', 0.5, 'true')} AS median, {pick_sql('size', 0.9, 'true')} AS p90, max(size) AS max_value
FROM (SELECT 'chars' AS unit, chars AS size FROM sizes UNION ALL SELECT 'bytes', bytes FROM sizes) GROUP BY 1""")
def a34(spark, sf):
    return la.size_summary(_sizes(spark, sf))


@query("a35_overflow_probability", ctes(st.LOGS, CONTENTS, PRINTED, SIZES) + f""",
upto AS (SELECT chars, bytes, sum(c) OVER (ORDER BY chars, bytes) - c AS lo FROM (SELECT chars, bytes, count(*) AS c FROM sizes GROUP BY ALL)),
slots AS (SELECT k, chain, draw, slot FROM (VALUES (3), (4), (5), (6), (12)) a(k), (VALUES (1), (2), (3)) b(chain), range(20000) d(draw), range(1, 37) s(slot) WHERE slot <= k * chain),
picks AS (SELECT k, chain, draw, ('0x' || left(md5('20261015|' || k::VARCHAR || '|' || chain::VARCHAR || '|' || draw::VARCHAR || '|' || slot::VARCHAR), 12))::BIGINT % (SELECT count(*) FROM sizes) AS pick FROM slots),
sums AS (SELECT k, chain, draw, sum(chars)::BIGINT AS chars, sum(bytes)::BIGINT AS bytes FROM picks ASOF JOIN upto ON pick >= lo GROUP BY ALL)
SELECT k, chain, count(*) FILTER (chars > 30000) / count(*) AS p_over_chars, count(*) FILTER (bytes > 30000) / count(*) AS p_over_bytes, {pick_sql('bytes', 0.5, 'true')} AS median_bytes FROM sums GROUP BY ALL""")
def a35(spark, sf):
    return la.overflow_probability(_sizes(spark, sf), [3, 4, 5, 6, 12], [1, 2, 3], 20000, 30000, 20261015)


# -- windows and limits ------------------------------------------------------------------------------------------------------

GAPS = """gaps AS (SELECT search_id, (epoch_us((SELECT min(b.ts) FROM joined b WHERE b.session_id = a.session_id AND b.ts > a.ts)) - epoch_us(a.ts)) / 1e6 AS next_gap_s FROM joined a)"""


@query("w02_seconds_to_next", ctes(st.LOGS, JOINED, GAPS) + "SELECT * FROM gaps")
def w02(spark, sf):
    return la.seconds_to_next(joined(spark, sf)).select("search_id", "next_gap_s")


@query("w03_first_per_session", ctes(st.LOGS, JOINED) + "SELECT session_id, first(search_id ORDER BY ts, search_id) AS search_id, first(collection ORDER BY ts, search_id) AS collection FROM joined GROUP BY 1")
def w03(spark, sf):
    return la.first_per_session(joined(spark, sf)).select("session_id", "search_id", "collection")


@query("l01_slowest_warm", ctes(*ITEM_CTES) + "SELECT search_id, version, duration_ms, collection FROM items WHERE NOT cold ORDER BY duration_ms DESC, search_id LIMIT 5")
def l01(spark, sf):
    return la.slowest_warm(items(spark, sf)).select("search_id", "version", "duration_ms", "collection")


@query("l02_zero_hit_rows", ctes(st.LOGS, JOINED, GAPS) + """
SELECT s.search_id, coalesce(nullif(s.code_version, ''), 'unversioned') AS version, s.candidates, left(s.query, 60) AS query,
 CASE WHEN g.search_id IS NULL THEN NULL WHEN g.next_gap_s IS NULL THEN 'none' ELSE round(next_gap_s)::BIGINT::VARCHAR END AS next_gap FROM searches s LEFT JOIN gaps g USING (search_id) WHERE s.hit_count = 0""")
def l02(spark, sf):
    rows = la.zero_hit_rows(with_version(st.searches(spark, sf)), joined(spark, sf))
    return rows.select("search_id", "version", "candidates", "query", F.when(F.col("next_gap") == "none", "none").otherwise(
        F.round(F.expr("try_cast(next_gap AS DOUBLE)")).cast("long").cast("string")).alias("next_gap"))


@query("l03_last_errors", ctes(st.LOGS) + "SELECT msg, server, code FROM errors ORDER BY ts DESC, msg DESC LIMIT 20")
def l03(spark, sf):
    return la.last_errors(st.errors(spark, sf), 20).select("msg", "server", "code")


@query("l04_stratified_order", ctes(st.LOGS) + """
SELECT search_id, CASE WHEN collection LIKE '%-reference' THEN 'reference' WHEN collection LIKE '%-docs' THEN 'docs' ELSE 'other' END AS stratum,
 md5('20261014|' || search_id) AS position FROM searches WHERE hit_count > 0""")
def l04(spark, sf):
    return stratified(st.searches(spark, sf).filter("hit_count > 0"), "20261014").select("search_id", "stratum", "position")


# -- canary ------------------------------------------------------------------------------------------------------------------

CASES = """cases AS (SELECT search_id AS name, CASE WHEN event_id % 5 = 0 THEN 'zero' ELSE 'hit' END AS kind, event_id FROM searches),
targets AS (SELECT name, 'd' || (event_id % 20 + t)::VARCHAR AS document, c::INT AS chunk_index FROM cases, unnest([0, 1, 2]) AS a(t), unnest([0, 1]) AS b(c) WHERE kind = 'hit'),
records AS (SELECT search_id AS name, * FROM searches WHERE event_id % 8 <> 0),
best AS (SELECT t.name, min(h.rank) AS rank FROM targets t JOIN records r USING (name) JOIN hits h ON h.search_id = r.search_id AND h.document = t.document AND h.chunk_index = t.chunk_index GROUP BY 1),
results AS (SELECT c.name, c.kind, CASE WHEN r.search_id IS NULL THEN 'ERROR' WHEN (c.kind = 'zero' AND r.hit_count = 0) OR (c.kind = 'hit' AND b.rank IS NOT NULL) THEN 'PASS' ELSE 'FAIL' END AS status,
 b.rank, r.hit_count AS result_count, r.candidates, f.top_score, r.duration_ms, CASE WHEN r.search_id IS NOT NULL THEN coalesce(o.output_chars, 0) END AS output_chars, r.code_version, r.config_fingerprint AS fingerprint,
 CASE WHEN r.search_id IS NULL THEN 'no search record written' END AS error
 FROM cases c LEFT JOIN records r USING (name) LEFT JOIN best b USING (name) LEFT JOIN (SELECT search_id, arg_min(score, rank) AS top_score FROM hits GROUP BY 1) f ON f.search_id = r.search_id
 LEFT JOIN (SELECT search_id, (sum(length(txt)) + count(*) - 1)::BIGINT AS output_chars FROM printed GROUP BY 1) o ON o.search_id = r.search_id)"""
CASE_CTES = (st.LOGS, CONTENTS, PRINTED, CASES)


def canary_results(spark, sf):
    s = st.searches(spark, sf)
    cases = s.select(F.col("search_id").alias("name"), F.when(F.col("event_id") % 5 == 0, "zero").otherwise("hit").alias("kind"), "event_id")
    t = cases.filter("kind = 'hit'").withColumn("t", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(1))))
    targets = t.select("name", F.concat(F.lit("d"), (F.col("event_id") % 20 + F.col("t")).cast("string")).alias("document"), "chunk_index")
    records = s.filter("event_id % 8 <> 0").select(F.col("search_id").alias("name"), "search_id", "hit_count", "candidates", "duration_ms", "code_version", "config_fingerprint")
    hits = st.hits(spark, sf).join(records.select("search_id", "name"), "search_id").drop("search_id")
    outputs = la.output_sizes(s, st.hits(spark, sf), contents(spark, sf)).withColumnRenamed("search_id", "name")
    return canary.evaluate_cases(cases.drop("event_id"), targets, records, hits, outputs)


@query("a32_canary_results", ctes(*CASE_CTES) + "SELECT * FROM results")
def a32(spark, sf):
    return canary_results(spark, sf)


@query("a32_canary_summary", ctes(*CASE_CTES) + """
SELECT count(*) AS cases, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'ERROR') AS errors FROM results""")
def a32b(spark, sf):
    return canary.summary(canary_results(spark, sf))


BASE = """, baseline AS (SELECT name, CASE WHEN crc % 5 = 1 AND status = 'PASS' THEN 'FAIL' WHEN crc % 5 = 1 THEN 'PASS' ELSE status END AS status, CASE WHEN crc % 7 = 2 THEN coalesce(rank, 0) + 1 ELSE rank END AS rank, result_count
 FROM (SELECT *, substr(name, 2)::BIGINT AS crc FROM results) WHERE crc % 6 <> 3)
SELECT c.name, CASE WHEN b.name IS NULL THEN 'new case' WHEN b.status <> 'PASS' AND c.status = 'PASS' THEN 'fixed' WHEN b.status = 'PASS' AND c.status <> 'PASS' THEN 'regressed'
 WHEN b.rank IS DISTINCT FROM c.rank THEN 'rank moved' ELSE 'unchanged' END AS change, b.status AS before_status, c.status AS after_status, b.rank AS before_rank, c.rank AS after_rank,
 b.result_count AS before_result_count, c.result_count AS after_result_count FROM results c LEFT JOIN baseline b USING (name)"""


@query("j08_run_comparison", ctes(*CASE_CTES) + BASE)
def j08(spark, sf):
    r = canary_results(spark, sf)
    crc = F.substring("name", 2, 20).cast("long")
    base = r.filter(crc % 6 != 3).withColumn(
        "status", F.when((crc % 5 == 1) & (F.col("status") == "PASS"), "FAIL").when(crc % 5 == 1, "PASS").otherwise(F.col("status"))
    ).withColumn("rank", F.when(crc % 7 == 2, F.coalesce("rank", F.lit(0)) + 1).otherwise(F.col("rank")))
    return canary.compare_runs(base, r)


@query("j13_isolation", ctes(st.LOGS) + "SELECT search_id FROM searches WHERE event_id % 12 = 0")
def j13(spark, sf):
    s = st.searches(spark, sf)
    ids = s.filter("event_id % 3 = 0").select("search_id").unionByName(st.errors(spark, sf).select(F.col("msg").alias("search_id")))
    return canary.leaked_ids(ids, s.filter("event_id % 4 = 0"))


# -- transcripts and query sets ----------------------------------------------------------------------------------------------

def transcript_lines(spark, sf):
    """Conversations as transcript lines: assistants call the search tool every other turn, results follow as user messages."""
    c, t = table(spark, sf, "conversations"), F.col("turn")
    search = F.concat(F.lit('cd /x; lookup search "turn '), t.cast("string"), F.lit('" col'), (F.col("conv_id") % 5).cast("string"), F.lit(" --exclude z"))
    uid = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    called = (F.col("role") == "assistant") & (t % 4 == 1)
    body = lambda role, content: F.to_json(F.struct(
        uid.alias("timestamp"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.lit("/w").alias("cwd"),
        F.struct(role.alias("role"), content.alias("content")).alias("message")))
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), uid.alias("id"), F.lit("Bash").alias("name"), F.struct(search.alias("command")).alias("input")))
    plain = body(F.col("role"), F.col("text"))
    # A list of blocks of different shapes is put together as text.
    mixed = F.concat(F.lit('{"timestamp":'), F.to_json(F.array(uid)).substr(F.lit(2), F.length(uid) + 2), F.lit(',"sessionId":"s'), F.col("conv_id").cast("string"),
                     F.lit('","cwd":"/w","message":{"role":"assistant","content":['), F.to_json(text), F.lit(","), use, F.lit("]}}"))
    result = body(F.lit("user"), F.array(F.struct(F.lit("tool_result").alias("type"), uid.alias("tool_use_id"), F.concat(F.lit("result of "), uid).alias("content"))))
    rows = F.array(F.struct((t * 2).alias("line_order"), F.when(called, mixed).otherwise(plain).alias("value")),
                   F.struct((t * 2 + 1).alias("line_order"), F.when(called & (t % 8 == 1), result).otherwise("not json").alias("value")))
    return c.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), F.explode(rows).alias("r")).select("file", "r.*")


CALLED = "role = 'assistant' AND turn % 4 = 1"


@query("s12_tool_calls", f"""
SELECT 'f' || conv_id::VARCHAR AS file, 'u' || conv_id::VARCHAR || '-' || turn::VARCHAR AS tool_use_id, 'turn ' || turn::VARCHAR AS query, 'col' || (conv_id % 5)::VARCHAR AS collection, 'z' AS exclude,
 CASE WHEN turn % 8 = 1 THEN 'result of u' || conv_id::VARCHAR || '-' || turn::VARCHAR ELSE '' END AS result_text FROM conversations WHERE {CALLED}""")
def s12(spark, sf):
    return transcripts.tool_calls(transcript_lines(spark, sf), "lookup").select("file", "tool_use_id", "query", "collection", "exclude", "result_text")


@query("s13_call_context", f"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') AS text FROM conversations),
c AS (SELECT *, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER w AS u, last_value(CASE WHEN role = 'assistant' AND text <> '' THEN text END IGNORE NULLS) OVER w AS a FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'u' || conv_id::VARCHAR || '-' || turn::VARCHAR AS timestamp, coalesce(right(u, 1500), '') AS user_text, coalesce(right(a, 1500), '') AS assistant_text FROM c WHERE {CALLED}""")
def s13(spark, sf):
    return transcripts.context_calls(transcript_lines(spark, sf), "lookup search").select("timestamp", "user_text", "assistant_text")


@query("s10_query_sets", """
SELECT 'f' || item_id::VARCHAR || '#' || i::VARCHAR AS query_id, 'kind' || (item_id % 3)::VARCHAR AS type, (e - 1)::INT AS pos, 'd' || (item_id + e - 1)::VARCHAR AS document, (e - 1)::INT AS chunk_index, text AS identifying_quote
FROM benchmark, unnest([1, 2]) a(i), unnest([1, 2]) b(e)""")
def s10(spark, sf):
    item = F.col("item_id")
    expected = F.array(*[F.struct(F.concat(F.lit("d"), (item + e).cast("string")).alias("document"), F.lit(e).alias("chunk_index"), F.col("text").alias("identifying_quote")) for e in (0, 1)])
    entry = F.struct(F.lit("q").alias("query"), F.concat(F.lit("kind"), (item % 3).cast("string")).alias("type"), F.array(F.lit("d")).alias("expected_documents"), expected.alias("expected_chunks"))
    both = F.array(entry, entry)
    body = F.when(item % 2 == 0, F.to_json(F.struct(both.alias("queries")))).otherwise(F.concat(F.lit(" "), F.to_json(both)))
    files = table(spark, sf, "benchmark").select(F.concat(F.lit("f"), item.cast("string")).alias("file"), body.alias("value"))
    q = evalsets.query_table(evalsets.parse_query_sets(files))
    return evalsets.expected_chunks(q).join(q.select("query_id", "type"), "query_id")
