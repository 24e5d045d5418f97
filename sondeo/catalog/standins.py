"""The given tables in the roles of chunk tables, logs, lists and judgments; Spark form and SQL form side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sondeo.catalog.base import table

# -- chunk table: conversations (document = conversation, chunk = turn) --------------------------------------------------

CHUNKS = """conv_sizes AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
chunks AS (
  SELECT 'col' || (c.conv_id % 10)::VARCHAR AS collection, 'conv_' || c.conv_id::VARCHAR || '.md' AS document,
         c.turn::INT AS chunk_index, (n + CASE WHEN c.conv_id % 7 = 3 THEN 1 ELSE 0 END)::INT AS total_chunks,
         c.text AS content, c.conv_id, c.role
  FROM conversations c JOIN conv_sizes USING (conv_id))"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    sizes = conv.groupBy("conv_id").agg(F.count("*").alias("n"))
    return conv.join(sizes, "conv_id").select(
        F.concat(F.lit("col"), (F.col("conv_id") % 10).cast("string")).alias("collection"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("document"),
        F.col("turn").cast("int").alias("chunk_index"),
        (F.col("n") + F.when(F.col("conv_id") % 7 == 3, 1).otherwise(0)).cast("int").alias("total_chunks"),
        F.col("text").alias("content"), "conv_id", "role",
    )


# -- corpus: documents (collection = source, document = doc_id) ----------------------------------------------------------

CORPUS = """corpus AS (SELECT source AS collection, 'doc_' || doc_id::VARCHAR || '.md' AS document, text AS content, doc_id FROM documents)"""


def corpus(spark: SparkSession, sf: str, read=table) -> DataFrame:
    return read(spark, sf, "documents").select(
        F.col("source").alias("collection"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("document"),
        F.col("text").alias("content"), "doc_id",
    )


# A stored manifest that lags behind the corpus: some documents unknown, some changed, some gone since.
MANIFEST = """current_hashes AS (SELECT collection, document, doc_id, sha256(content) AS sha256 FROM corpus),
stored_hashes AS (
  SELECT collection, CASE WHEN doc_id % 13 = 5 THEN 'gone_' || doc_id::VARCHAR || '.md' ELSE document END AS document,
         CASE WHEN doc_id % 11 = 1 THEN sha256(sha256) ELSE sha256 END AS sha256
  FROM current_hashes WHERE doc_id % 7 <> 2)"""


def current_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select(
        "collection", "document", "doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")
    )


def stored_hashes(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.concat(F.lit("gone_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return current_hashes(spark, sf).filter("doc_id % 7 <> 2").select(
        "collection", F.when(F.col("doc_id") % 13 == 5, gone).otherwise(F.col("document")).alias("document"),
        F.when(F.col("doc_id") % 11 == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
    )


# -- logs: events -------------------------------------------------------------------------------------------------------

COLLECTION_SQL = """(CASE user_id % 5 WHEN 0 THEN 'alpha-reference' WHEN 1 THEN 'alpha-docs' WHEN 2 THEN 'beta-reference'
 WHEN 3 THEN 'gamma' ELSE 'beta-docs' END)"""

LOGS = f"""ev AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value, (props->>'k')::INT AS k FROM events),
searches AS (
  SELECT 's' || lpad(event_id::VARCHAR, 9, '0') AS search_id, ts, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'v' || (user_id % 4)::VARCHAR END AS code_version,
         'topic ' || k::VARCHAR || ' in detail' AS query, {COLLECTION_SQL} AS collection,
         CASE WHEN k % 10 = 0 THEN 'd' || (k % 7)::VARCHAR || '%' END AS document, NULL::VARCHAR AS exclude,
         CASE WHEN event_id % 9 = 0 THEN (event_id % 2 * 3)::INT ELSE 30 END AS candidates, round(value * 100)::INT AS duration_ms,
         CASE WHEN event_id % 9 = 0 THEN 0 ELSE (1 + event_id % 4)::INT END AS hit_count,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'fp' || (user_id % 6)::VARCHAR END AS config_fingerprint, k, user_id, event_id
  FROM ev WHERE event_type = 'view'),
hits AS (
  SELECT search_id, r::INT AS rank, 'd' || ((k + r * (event_id % 3)) % 20)::VARCHAR AS document, ((k + r) % 3)::INT AS chunk_index,
         round(0.99::DOUBLE - 0.07::DOUBLE * r - 0.001::DOUBLE * (event_id % 50), 4) AS score
  FROM searches, unnest(range(1, hit_count + 1)) AS t(r)),
expands AS (
  SELECT 'e' || lpad(event_id::VARCHAR, 9, '0') AS expand_id, ts, 'v2' AS code_version, {COLLECTION_SQL} AS collection,
         'd' || (k % 20)::VARCHAR AS document, (k % 3)::INT AS chunk_index, (event_id % 3)::INT AS before, (event_id % 4)::INT AS after,
         (1 + event_id % 3)::INT AS chunks_returned, round(value * 100)::INT AS duration_ms
  FROM ev WHERE event_type = 'click'),
errors AS (
  SELECT ts, CASE user_id % 4 WHEN 0 THEN 'embedding-8b' WHEN 1 THEN 'reranker-0.6b' WHEN 2 THEN 'sync' ELSE 'watchdog' END AS server,
         CASE event_id % 6 WHEN 0 THEN 'start_initiated' WHEN 1 THEN 'busy' WHEN 2 THEN 'log_write_failed' WHEN 3 THEN 'start_succeeded'
           WHEN 4 THEN 'watchdog_killed_orphan' ELSE 'single_instance_alive_replaced' END AS code,
         'event ' || event_id::VARCHAR AS msg
  FROM ev WHERE event_type = 'error'),
calls AS (
  SELECT 't' || lpad((event_id // 2)::VARCHAR, 9, '0') AS tool_use_id, 'sess' || (user_id % 40)::VARCHAR AS session_id,
         CASE user_id % 3 WHEN 0 THEN '/home/u/alpha/src' WHEN 1 THEN '/home/u/beta/.claude/worktrees/x' ELSE '/home/u/misc' END AS cwd,
         query, collection, document, exclude, ts - INTERVAL 1 SECOND AS tool_use_ts,
         CASE WHEN event_id % 23 <> 0 THEN ts + INTERVAL 1 SECOND * (duration_ms // 1000) END AS result_ts,
         CASE WHEN event_id % 5 = 0 THEN '<persisted-output>' || chr(10) || 'Output too large (' || (30 + event_id % 20)::VARCHAR || '.5KB). Full output saved to: /tmp/u/tool-results/out' || event_id::VARCHAR || '.txt' || chr(10)
              ELSE '--- Result 1 (score: 0.9) ---' END AS result_text, search_id AS origin, event_id
  FROM searches WHERE event_id % 7 <> 0
  UNION ALL
  SELECT 't' || lpad(event_id::VARCHAR, 9, '9'), 'sess' || (user_id % 40)::VARCHAR, '/home/u/alpha',
         'signup ' || k::VARCHAR, {COLLECTION_SQL}, NULL, NULL, ts, ts + INTERVAL 3 SECOND,
         CASE event_id % 3 WHEN 0 THEN 'PreToolUse hook error: [python3 /hooks/block_' || (k % 3)::VARCHAR || '.py]: refused because of rule ' || (k % 3)::VARCHAR || chr(10) || 'more'
           WHEN 1 THEN '  ' || chr(10) || ' ' ELSE 'Traceback (most recent call last)' || chr(10) || 'boom' END, NULL, event_id
  FROM ev WHERE event_type = 'signup')"""


def events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    ev = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return ev.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def _collection():
    u = F.col("user_id") % 5
    return (
        F.when(u == 0, "alpha-reference").when(u == 1, "alpha-docs").when(u == 2, "beta-reference").when(u == 3, "gamma")
        .otherwise("beta-docs")
    )


def _tag(prefix: str, col, width: int = 0):
    body = col.cast("string")
    return F.concat(F.lit(prefix), F.lpad(body, width, "0") if width else body)


def searches(spark: SparkSession, sf: str) -> DataFrame:
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    return events(spark, sf, "view").select(
        _tag("s", e, 9).alias("search_id"), "ts",
        F.when(u % 4 == 0, F.lit(None)).when(u % 4 == 1, "").otherwise(_tag("v", u % 4)).alias("code_version"),
        F.concat(F.lit("topic "), k.cast("string"), F.lit(" in detail")).alias("query"), _collection().alias("collection"),
        F.when(k % 10 == 0, F.concat(_tag("d", k % 7), F.lit("%"))).alias("document"),
        F.lit(None).cast("string").alias("exclude"),
        F.when(e % 9 == 0, e % 2 * 3).otherwise(30).cast("int").alias("candidates"),
        F.round(F.col("value") * 100).cast("int").alias("duration_ms"),
        F.when(e % 9 == 0, 0).otherwise(1 + e % 4).cast("int").alias("hit_count"),
        F.when(e % 17 == 0, F.lit(None)).otherwise(_tag("fp", u % 6)).alias("config_fingerprint"), "k", "user_id", "event_id",
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    s = searches(spark, sf).filter("hit_count > 0")
    r, k, e = F.col("rank"), F.col("k"), F.col("event_id")
    return s.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("hit_count")))).select(
        "search_id", "rank", _tag("d", (k + r * (e % 3)) % 20).alias("document"), ((k + r) % 3).cast("int").alias("chunk_index"),
        F.round(F.lit(0.99) - F.lit(0.07) * r - F.lit(0.001) * (e % 50), 4).alias("score"),
    )


def expands(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    return events(spark, sf, "click").select(
        _tag("e", e, 9).alias("expand_id"), "ts", F.lit("v2").alias("code_version"), _collection().alias("collection"),
        _tag("d", k % 20).alias("document"), (k % 3).cast("int").alias("chunk_index"), (e % 3).cast("int").alias("before"),
        (e % 4).cast("int").alias("after"), (1 + e % 3).cast("int").alias("chunks_returned"),
        F.round(F.col("value") * 100).cast("int").alias("duration_ms"),
    )


def errors(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id") % 4, F.col("event_id") % 6
    return events(spark, sf, "error").select(
        "ts", F.when(u == 0, "embedding-8b").when(u == 1, "reranker-0.6b").when(u == 2, "sync").otherwise("watchdog").alias("server"),
        F.when(e == 0, "start_initiated").when(e == 1, "busy").when(e == 2, "log_write_failed").when(e == 3, "start_succeeded")
        .when(e == 4, "watchdog_killed_orphan").otherwise("single_instance_alive_replaced").alias("code"),
        _tag("event ", F.col("event_id")).alias("msg"),
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    saved = F.concat(
        F.lit("<persisted-output>\nOutput too large ("), (30 + e % 20).cast("string"),
        F.lit(".5KB). Full output saved to: /tmp/u/tool-results/out"), e.cast("string"), F.lit(".txt\n"),
    )
    logged = searches(spark, sf).filter("event_id % 7 <> 0").select(
        F.concat(F.lit("t"), F.lpad(F.floor(e / 2).cast("string"), 9, "0")).alias("tool_use_id"),
        _tag("sess", u % 40).alias("session_id"),
        F.when(u % 3 == 0, "/home/u/alpha/src").when(u % 3 == 1, "/home/u/beta/.claude/worktrees/x").otherwise("/home/u/misc").alias("cwd"),
        "query", "collection", "document", "exclude", (F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("tool_use_ts"),
        F.when(e % 23 != 0, F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("duration_ms") / 1000) * 1000000)).alias("result_ts"),
        F.when(e % 5 == 0, saved).otherwise("--- Result 1 (score: 0.9) ---").alias("result_text"),
        F.col("search_id").alias("origin"), "event_id",
    )
    refused = F.concat(
        F.lit("PreToolUse hook error: [python3 /hooks/block_"), (k % 3).cast("string"),
        F.lit(".py]: refused because of rule "), (k % 3).cast("string"), F.lit("\nmore"),
    )
    none = F.lit(None).cast("string")
    other = events(spark, sf, "signup").select(
        F.concat(F.lit("t"), F.lpad(e.cast("string"), 9, "9")).alias("tool_use_id"), _tag("sess", u % 40).alias("session_id"),
        F.lit("/home/u/alpha").alias("cwd"), _tag("signup ", k).alias("query"), _collection().alias("collection"),
        none.alias("document"), none.alias("exclude"), F.col("ts").alias("tool_use_ts"),
        (F.col("ts") + F.expr("INTERVAL 3 SECOND")).alias("result_ts"),
        F.when(e % 3 == 0, refused).when(e % 3 == 1, "  \n ").otherwise("Traceback (most recent call last)\nboom").alias("result_text"),
        none.alias("origin"), "event_id",
    )
    return logged.unionByName(other)


# -- vectors: embeddings -------------------------------------------------------------------------------------------------

VECTORS = """vec_chunks AS (
  SELECT 'col' || (label % 4)::VARCHAR AS collection, 'v' || label::VARCHAR AS document, vec_id::INT AS chunk_index, vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings),
vec_queries AS (SELECT vec_id AS query_id, label AS query_label, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 25 = 0)"""


def vec_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        _tag("col", F.col("label") % 4).alias("collection"), _tag("v", F.col("label")).alias("document"),
        F.col("vec_id").cast("int").alias("chunk_index"), "vec_id", "label", "embedding",
    )


def vec_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 25 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), "embedding"
    )


# -- quotes: opening of benchmark passages, looked up in conversation turns ------------------------------------------------

QUOTES = """quotes AS (
  SELECT conv_id * 100 + turn AS quote_id, collection, document, (chunk_index + CASE WHEN conv_id % 9 = 4 THEN 1 ELSE 0 END)::INT AS chunk_index,
         CASE WHEN conv_id % 11 = 6 THEN 'not said: ' ELSE '' END || content ||
         CASE WHEN conv_id % 5 = 2 THEN '  ' || coalesce(after, '') ELSE '' END AS quote
  FROM (SELECT *, chunk_index AS turn, lead(content) OVER (PARTITION BY conv_id ORDER BY chunk_index) AS after FROM chunks))"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    after = c.select("conv_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("content").alias("after"))
    j = c.join(after, ["conv_id", "chunk_index"], "left")
    v = F.col("conv_id")
    return j.select(
        (v * 100 + F.col("chunk_index")).alias("quote_id"), "collection", "document",
        (F.col("chunk_index") + F.when(v % 9 == 4, 1).otherwise(0)).cast("int").alias("chunk_index"),
        F.concat(
            F.when(v % 11 == 6, "not said: ").otherwise(""), F.col("content"),
            F.when(v % 5 == 2, F.concat(F.lit("  "), F.coalesce("after", F.lit("")))).otherwise(""),
        ).alias("quote"),
    )
