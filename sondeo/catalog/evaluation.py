"""Queries on ranking quality and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.catalog import standins as st
from sondeo.catalog.base import ctes, query
from sondeo.catalog.retrieval import (CC_RAW, DENSE, DENSE_ALL, K, LISTS, RELEVANCE, RRF_RAW, SCALED, SPARSE, SPARSE_ALL, WORDED, dense50, fused_sql,
                                      ranked_sql, sparse50, worded, outside_scores)
from sondeo.operators import evaluation as ev
from sondeo.operators import fusion, retrieval
from sondeo.plans import modes
from sondeo.session import checkpointed
from sondeo.sources.corpus import spread

# Relevant chunks of a query: every third chunk of its label; documents: its label and one other; quotes: some of those chunks' words.
EXPECTED = """asked AS (SELECT query_id, query_label, CASE (query_id // 25) % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'survey' END AS type, ((query_id * 7) % 90 + 10)::DOUBLE AS latency_ms FROM vec_queries),
expected AS (SELECT query_id, document, chunk_index FROM asked JOIN vec_chunks ON label = query_label WHERE vec_id % 3 = 0 UNION ALL SELECT query_id, 'v' || query_label::VARCHAR, 0 FROM asked WHERE query_id % 2 = 0),
edocs AS (SELECT query_id, 'v' || query_label::VARCHAR AS document FROM asked UNION ALL SELECT query_id, 'v' || ((query_label + 3) % 10)::VARCHAR FROM asked),
equotes AS (SELECT query_id, vec_id AS pos, upper(content) AS quote FROM asked JOIN worded ON label = query_label WHERE vec_id % 5 = 0 AND content <> '')"""
BASE = (st.VECTORS, WORDED, EXPECTED, DENSE_ALL, DENSE)


def asked(spark, sf):
    q = st.vec_queries(spark, sf).select("query_id", "query_label")
    kind = F.floor(F.col("query_id") / 25) % 3
    return q.withColumn("type", F.when(kind == 0, "lookup").when(kind == 1, "survey")).withColumn("latency_ms", ((F.col("query_id") * 7) % 90 + 10).cast("double"))


def expected(spark, sf):
    # Labels are few: the chunks of a label stay spread, and its queries (ids and labels only) come to them.
    q, c = asked(spark, sf), st.vec_chunks(spark, sf).select("vec_id", "label", "document", "chunk_index").filter("vec_id % 3 = 0")
    main = spread(c).join(F.broadcast(q.select("query_id", "query_label")), F.col("query_label") == F.col("label")).select("query_id", "document", "chunk_index")
    extra = q.filter("query_id % 2 = 0").select("query_id", F.concat(F.lit("v"), F.col("query_label").cast("string")).alias("document"), F.lit(0).alias("chunk_index"))
    return main.unionByName(extra)


def expected_documents(spark, sf):
    q = asked(spark, sf)
    tag = lambda c: F.concat(F.lit("v"), c.cast("string")).alias("document")
    return q.select("query_id", tag(F.col("query_label"))).unionByName(q.select("query_id", tag((F.col("query_label") + 3) % 10)))


def quotes(spark, sf):
    q, w = asked(spark, sf), worded(spark, sf).filter("vec_id % 5 = 0 AND content <> ''")
    said = spread(w.select("vec_id", "label", F.upper("content").alias("quote")))
    return said.join(F.broadcast(q.select("query_id", "query_label")), F.col("query_label") == F.col("label")).select("query_id", F.col("vec_id").alias("pos"), "quote")


def with_content(spark, sf, hits):
    return hits.join(worded(spark, sf).select(*retrieval.KEY, "content"), retrieval.KEY)


def metrics_sql(name: str, hits: str, k: str, keys: str = "query_id", queries: str = "asked") -> str:
    """``k`` may be a column of ``queries``; ``hits`` has keys, rank, document, chunk_index."""
    return f"""{name} AS (SELECT * EXCLUDE (dcg, fst, hit, total, ideal), CASE WHEN ideal > 0 THEN least(1.0, coalesce(dcg / ideal, 0)) ELSE 0.0 END::DOUBLE AS ndcg, coalesce(1.0::DOUBLE / fst, 0) AS mrr,
   CASE WHEN total > 0 THEN coalesce(hit, 0) / total ELSE 0.0 END::DOUBLE AS recall FROM (
  SELECT a.*, g.dcg, g.fst, g.hit, coalesce(t.total, 0) AS total, coalesce(list_sum(list_transform(range(1, least(coalesce(t.total, 0), {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0) AS ideal
  FROM {queries} a LEFT JOIN (SELECT query_id, count(*) AS total FROM expected GROUP BY 1) t USING (query_id) LEFT JOIN (
    SELECT {keys}, sum(CASE WHEN w.query_id IS NOT NULL THEN 1.0::DOUBLE / log2(h.rank + 1) ELSE 0 END) AS dcg, min(h.rank) FILTER (w.query_id IS NOT NULL) AS fst, count(w.query_id) AS hit
    FROM {hits} h LEFT JOIN (SELECT DISTINCT query_id, document, chunk_index FROM expected) w USING (query_id, document, chunk_index) GROUP BY ALL) g USING ({keys})))"""


METRICS = (*BASE, "top10 AS (SELECT * FROM dense WHERE rank <= 10)", metrics_sql("metrics", "top10", "10"))


def metrics(spark, sf, k=10):
    return ev.rank_metrics(asked(spark, sf), dense50(spark, sf), expected(spark, sf), k)


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("a04_ndcg", ctes(*METRICS) + "SELECT query_id, round(ndcg, 6) AS ndcg FROM metrics")
def a04(spark, sf):
    return _rounded(metrics(spark, sf).select("query_id", "ndcg"), "ndcg")


@query("a05_mrr", ctes(*METRICS) + "SELECT query_id, round(mrr, 6) AS mrr FROM metrics")
def a05(spark, sf):
    return _rounded(metrics(spark, sf).select("query_id", "mrr"), "mrr")


@query("a06_recall", ctes(*METRICS) + "SELECT query_id, round(recall, 6) AS recall FROM metrics")
def a06(spark, sf):
    return _rounded(metrics(spark, sf).select("query_id", "recall"), "recall")


DOC_MATCH = "doc_match AS (SELECT e.query_id, e.document, count(h.rank) > 0 AS found, string_agg(h.rank::VARCHAR, ',' ORDER BY h.rank) AS ranks FROM edocs e LEFT JOIN (SELECT * FROM dense WHERE rank <= 10) h USING (query_id, document) GROUP BY ALL)"
SNIPPET = f"""snippet AS (SELECT q.query_id, q.pos, min(h.rank) FILTER (contains(lower(h.content), lower(q.quote))) AS rank FROM equotes q LEFT JOIN
 (SELECT d.*, w.content FROM dense d JOIN worded w USING ({K}) WHERE rank <= 10) h USING (query_id) GROUP BY ALL)"""


@query("a07_document_match", ctes(*BASE, DOC_MATCH) + "SELECT query_id, document, found, coalesce(ranks, '') AS ranks FROM doc_match")
def a07(spark, sf):
    m = ev.document_match(expected_documents(spark, sf), dense50(spark, sf).filter("rank <= 10"))
    return m.select("query_id", "document", "found", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"))


@query("a08_snippet_match", ctes(*BASE, SNIPPET) + "SELECT query_id, pos, rank, rank IS NOT NULL AS found FROM snippet")
def a08(spark, sf):
    return ev.snippet_match(quotes(spark, sf), with_content(spark, sf, dense50(spark, sf).filter("rank <= 10")))


def per_query(spark, sf):
    hits = dense50(spark, sf).filter("rank <= 10")
    docs = ev.found_share(ev.document_match(expected_documents(spark, sf), hits), "doc_recall")
    snip = ev.found_share(ev.snippet_match(quotes(spark, sf), with_content(spark, sf, hits)), "snippet_recall")
    return ev.rank_metrics(asked(spark, sf), hits, expected(spark, sf), 10).join(docs, "query_id", "left").join(snip, "query_id", "left")


@query("a09_query_summary", ctes(*METRICS, DOC_MATCH, SNIPPET) + """,
pq AS (SELECT m.*, d.doc_recall, coalesce(s.snippet_recall, 0) AS snippet_recall FROM metrics m LEFT JOIN (SELECT query_id, avg(found::INT) AS doc_recall FROM doc_match GROUP BY 1) d USING (query_id)
 LEFT JOIN (SELECT query_id, count(rank) / count(*) AS snippet_recall FROM snippet GROUP BY 1) s USING (query_id))
SELECT type, count(*) AS queries, round(avg(doc_recall), 6) AS doc_recall, round(avg(snippet_recall), 6) AS snippet_recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, avg(latency_ms) AS latency_ms,
 count(*) FILTER (doc_recall = 1) AS full_doc_match, count(*) FILTER (snippet_recall = 1) AS full_snippet_match, count(*) FILTER (snippet_recall = 0) AS zero_snippet_match
FROM (SELECT * EXCLUDE (type), coalesce(type, 'unknown') AS type FROM pq) GROUP BY GROUPING SETS ((type), ())""")
def a09b(spark, sf):
    return _rounded(ev.summary(per_query(spark, sf)), "doc_recall", "snippet_recall", "ndcg", "mrr", "recall")


@query("a9_evaluation_summary", ctes(*METRICS) + "SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall FROM metrics")
def a09(spark, sf):
    return _rounded(ev.summary(metrics(spark, sf).drop("latency_ms"), None), "ndcg", "mrr", "recall")


# -- sweeps --------------------------------------------------------------------------------------------------------------------

RANGES = {"mode": ["dense", "sparse", "hybrid", "cc"], "top_k": [3, 5, 7, 10, 12]}
CONFIG = {"mode": "cc", "top_k": 12, "alpha": 0.8, "rrf_k": 60, "score_threshold": 0.0}
CELLS = """cells AS (SELECT (row_number() OVER (ORDER BY mi, top_k) - 1) AS cell, mode, top_k::BIGINT AS top_k FROM (VALUES (0, 'dense'), (1, 'sparse'), (2, 'hybrid'), (3, 'cc')) m(mi, mode), (VALUES (3), (5), (7), (10), (12)) t(top_k))"""
SWEEP = (st.VECTORS, WORDED, EXPECTED, DENSE_ALL, DENSE, SPARSE_ALL, SPARSE, fused_sql("hybrid", "query_id", RRF_RAW.format(k=60)), SCALED,
         fused_sql("cc", "query_id", CC_RAW.format(a="0.8::DOUBLE"), "dsc", "ssc"), CELLS,
         f"mlists AS (SELECT 'dense' AS mode, query_id, rank, {K} FROM dense UNION ALL SELECT 'sparse', query_id, rank, {K} FROM sparse UNION ALL SELECT 'hybrid', query_id, rank, {K} FROM hybrid UNION ALL SELECT 'cc', query_id, rank, {K} FROM cc)",
         f"shits AS (SELECT cell, query_id, rank, {K} FROM cells JOIN mlists USING (mode) WHERE rank <= top_k)",
         "sasked AS (SELECT a.*, cell, top_k, mode FROM asked a CROSS JOIN cells)", metrics_sql("smetrics", "shits", "top_k", "cell, query_id", "sasked"),
         f"ssnip AS (SELECT cell, query_id, count(rank) / count(*) AS snippet_recall FROM (SELECT a.cell, q.query_id, q.pos, min(h.rank) FILTER (contains(lower(h.content), lower(q.quote))) AS rank FROM equotes q JOIN sasked a USING (query_id) LEFT JOIN (SELECT s.*, w.content FROM shits s JOIN worded w USING ({K})) h ON h.query_id = q.query_id AND h.cell = a.cell GROUP BY ALL) GROUP BY ALL)",
         "sweep AS (SELECT cell, mode, top_k, count(*) AS queries, round(avg(coalesce(snippet_recall, 0)), 6) AS snippet_recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, count(*) FILTER (snippet_recall = 1) AS full_snippet_match, count(*) FILTER (coalesce(snippet_recall, 0) = 0) AS zero_snippet_match FROM smetrics LEFT JOIN ssnip USING (cell, query_id) GROUP BY ALL)")


def sweep_summary(spark, sf, ranges=RANGES):
    cells = modes.grid(ranges, CONFIG)
    lists = {"dense": dense50(spark, sf), "sparse": sparse50(spark, sf)}
    hits = checkpointed(modes.sweep(lists, cells))  # read for the metrics and for the quotes
    keys = ["cell", "query_id"]
    queries = modes.with_cells(asked(spark, sf).select("query_id"), cells, ["cell", *dict.fromkeys([*ranges, "top_k"])])
    per = _cell_metrics(queries, hits, expected(spark, sf), keys)
    matches = ev.snippet_match(quotes(spark, sf), with_content(spark, sf, hits), keys, len(cells))
    snip = ev.found_share(matches, "snippet_recall", keys, len(cells))
    per = per.join(snip, keys, "left")
    return _rounded(ev.summary(per, None, ["cell", *ranges]), "snippet_recall", "ndcg", "mrr", "recall")


def _cell_metrics(queries, hits, expected_rows, keys):
    # Hits of a cell are already cut to its top_k, so the depth only enters the ideal gain.
    return ev.rank_metrics(queries, hits.join(queries.select(*keys, "top_k"), keys), expected_rows, F.col("top_k"), keys)


@query("a10_parameter_sweep", ctes(*SWEEP) + "SELECT * FROM sweep")
def a10(spark, sf):
    return sweep_summary(spark, sf)


# Reranked modes and candidate depths of the sweep.
RERANKED = {"mode": ["cc+rerank", "hybrid+rerank", "cc+rerank-8b", "hybrid+rerank-8b", "dense+rerank-0.6b", "dense+rerank-8b"], "rerank_candidates": [20, 30, 40, 50]}


RERANKED_MODES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(RERANKED["mode"]))


@query("a10_rerank_sweep", ctes(*SWEEP[:SWEEP.index(CELLS)],
       f"rlists AS (SELECT 'dense' AS base, query_id, rank, {K} FROM dense UNION ALL SELECT 'hybrid', query_id, rank, {K} FROM hybrid UNION ALL SELECT 'cc', query_id, rank, {K} FROM cc)",
       f"rcells AS (SELECT row_number() OVER (ORDER BY mi, depth) - 1 AS cell, mode, split_part(mode, '+', 1) AS base, depth FROM (VALUES {RERANKED_MODES}) m(mi, mode), (VALUES (20), (30), (40), (50)) d(depth))",
       f"rscored AS (SELECT cell, query_id, rank AS was, {K}, {RELEVANCE} AS rel FROM rcells JOIN rlists USING (base) WHERE rank <= depth)")
       + f"SELECT cell, query_id, row_number() OVER (PARTITION BY cell, query_id ORDER BY rel DESC, was)::INT AS rank, {K}, round(rel, 6) AS score FROM rscored QUALIFY rank <= 12")
def a10c(spark, sf):
    """Every reranked cell of the grid: its candidates, rescored and cut to the list length."""
    return modes.sweep({"dense": dense50(spark, sf), "sparse": sparse50(spark, sf)}, modes.grid(RERANKED, CONFIG), outside_scores)


@query("a11_cross_table", ctes(*SWEEP) + """
SELECT mode, max(ndcg) FILTER (top_k = 3) AS k3, max(ndcg) FILTER (top_k = 5) AS k5, max(ndcg) FILTER (top_k = 7) AS k7, max(ndcg) FILTER (top_k = 10) AS k10, max(ndcg) FILTER (top_k = 12) AS k12 FROM sweep GROUP BY 1""")
def a11(spark, sf):
    t = ev.cross_table(sweep_summary(spark, sf), "mode", "top_k", RANGES["top_k"], "ndcg")
    return t.select("mode", *[F.col(str(k)).alias(f"k{k}") for k in RANGES["top_k"]])


@query("a11_best_cell", ctes(*SWEEP) + "SELECT mode, top_k, snippet_recall, ndcg FROM sweep ORDER BY snippet_recall DESC, ndcg DESC, cell LIMIT 1")
def a11b(spark, sf):
    return ev.best_cell(sweep_summary(spark, sf), ["mode", "top_k", "cell"], ["cell"]).drop("cell")


@query("a11_spread_notes", ctes(*SWEEP) + """
SELECT mode, min(snippet_recall) AS low, max(snippet_recall) AS high, first(top_k ORDER BY snippet_recall DESC, top_k) AS peak_at FROM sweep GROUP BY 1 HAVING max(snippet_recall) - min(snippet_recall) >= 0.02""")
def a11c(spark, sf):
    return ev.spread_notes(sweep_summary(spark, sf), "mode", "top_k", 0.02)


ALPHAS = {"mode": ["cc"], "alpha": [0.5, 0.6, 0.7, 0.8, 0.9]}


@query("a10_alpha_sweep", ctes(*LISTS, SCALED, "alphas(cell, alpha) AS (VALUES (0::BIGINT, 0.5::DOUBLE), (1, 0.6), (2, 0.7), (3, 0.8), (4, 0.9))",
       "dca AS (SELECT cell, alpha, dsc.* FROM dsc CROSS JOIN alphas)", "sca AS (SELECT cell, alpha, ssc.* FROM ssc CROSS JOIN alphas)",
       fused_sql("fused", "cell, alpha, query_id", CC_RAW.format(a="alpha"), "dca", "sca", 12)) + f"SELECT cell, query_id, rank, {K}, score FROM fused")
def a10b(spark, sf):
    cells = modes.grid(ALPHAS, CONFIG)
    return modes.sweep({"dense": dense50(spark, sf), "sparse": sparse50(spark, sf)}, cells)


# -- dimension sweep -----------------------------------------------------------------------------------------------------------

DIMS = [8, 16, 32, 64]
DIM_CTES = (st.VECTORS, WORDED, EXPECTED, SPARSE_ALL, SPARSE, "dims(dim) AS (VALUES (8), (16), (32), (64))",
            f"ddense_all AS (SELECT dim, query_id, {K}, round(list_cosine_similarity(qv[1:dim], embedding[1:dim]), 9) AS raw FROM dims, vec_queries, vec_chunks)",
            ranked_sql("ddense", "ddense_all", 50, "dim, query_id"), "dsparse AS (SELECT dim, sparse.* FROM sparse CROSS JOIN dims)",
            fused_sql("dhybrid", "dim, query_id", RRF_RAW.format(k=60), "ddense", "dsparse", 10),
            f"dhits AS (SELECT 'dense' AS mode, dim, query_id, rank, {K} FROM ddense WHERE rank <= 10 UNION ALL SELECT 'hybrid', dim, query_id, rank, {K} FROM dhybrid)",
            """dfound AS (SELECT m.mode, d.dim, e.query_id, a.type, count(DISTINCT e.document) AS total, count(DISTINCT h.document) AS doc_found FROM (VALUES ('dense'), ('hybrid')) m(mode) CROSS JOIN dims d CROSS JOIN edocs e JOIN asked a USING (query_id)
 LEFT JOIN dhits h ON h.mode = m.mode AND h.dim = d.dim AND h.query_id = e.query_id AND h.document = e.document GROUP BY ALL)""")


def dimension_hits(spark, sf):
    """Dense and fused lists, ten deep, for every vector length; the sparse list is shared."""
    q, c = st.vec_queries(spark, sf), st.vec_chunks(spark, sf)
    sparse = sparse50(spark, sf)
    dense = checkpointed(retrieval.dense_top_k(q, c, 50, dims=DIMS))  # read for its own hits and for the fusion
    spread = sparse.withColumn("dim", F.explode(F.array(*map(F.lit, DIMS))))
    fused = fusion.reciprocal_rank(dense, spread, keys=["dim", "query_id"], k=10)
    return dense.filter("rank <= 10").withColumn("mode", F.lit("dense")).unionByName(fused.withColumn("mode", F.lit("hybrid")))


def dimension_found(spark, sf):
    """(mode, dim, query_id, type, total, doc_found)."""
    hits = dimension_hits(spark, sf)
    cells = modes.grid({"mode": ["dense", "hybrid"], "dim": DIMS}, {})
    wanted = modes.with_cells(expected_documents(spark, sf), cells, ["mode", "dim"]).withColumn("dim", F.col("dim").cast("int"))
    keys = ["mode", "dim", "query_id"]
    return ev.document_match(wanted, hits, keys).groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("found").alias("doc_found")).join(
        asked(spark, sf).select("query_id", "type"), "query_id")


@query("r10_dimension_snippets", ctes(*DIM_CTES, f"""dsnip AS (SELECT mode, dim, query_id, count(rank) AS found, count(*) AS quotes FROM (
  SELECT m.mode, d.dim, q.query_id, q.pos, min(h.rank) FILTER (contains(lower(h.content), lower(q.quote))) AS rank FROM (VALUES ('dense'), ('hybrid')) m(mode) CROSS JOIN dims d CROSS JOIN equotes q
  LEFT JOIN (SELECT x.*, w.content FROM dhits x JOIN worded w USING ({K})) h ON h.mode = m.mode AND h.dim = d.dim AND h.query_id = q.query_id GROUP BY ALL) GROUP BY ALL)""")
       + "SELECT mode, dim, count(*) AS queries, round(avg(found / quotes), 6) AS snippet_recall, count(*) FILTER (found = quotes) AS full_snippet_match, count(*) FILTER (found = 0) AS zero_snippet_match FROM dsnip GROUP BY ALL")
def r10c(spark, sf):
    """Share of quotes found in the lists of every vector length."""
    cells = modes.grid({"mode": ["dense", "hybrid"], "dim": DIMS}, {})
    keys, hits = ["cell", "query_id"], modes.numbered(dimension_hits(spark, sf), cells, ["mode", "dim"])
    matches = ev.snippet_match(quotes(spark, sf), with_content(spark, sf, hits), keys, len(cells))
    snip = ev.found_share(matches, "snippet_recall", keys, len(cells))
    named = modes.with_cells(snip.withColumnRenamed("cell", "_of"), cells, ["cell", "mode", "dim"]).filter(F.col("cell") == F.col("_of"))
    return _rounded(ev.summary(named.withColumn("dim", F.col("dim").cast("int")), None, ["mode", "dim"]), "snippet_recall")


@query("r10_dimension_sweep", ctes(*DIM_CTES) + """
SELECT mode, dim, type, count(*) AS queries, round(avg(doc_found / total), 6) AS doc_recall, count(*) FILTER (doc_found = total) AS full_doc FROM (SELECT * EXCLUDE (type), coalesce(type, 'unknown') AS type FROM dfound) GROUP BY GROUPING SETS ((mode, dim, type), (mode, dim))""")
def r10(spark, sf):
    per = dimension_found(spark, sf).withColumn("doc_recall", F.col("doc_found") / F.col("total"))
    s = ev.summary(per, "type", ["mode", "dim"])
    return _rounded(s, "doc_recall").withColumnRenamed("full_doc_match", "full_doc")


@query("r10_differing_queries", ctes(*DIM_CTES) + """
SELECT query_id, min(doc_found) AS min_doc_found, max(doc_found) AS max_doc_found FROM dfound GROUP BY 1 HAVING count(DISTINCT doc_found) > 1""")
def r10b(spark, sf):
    return ev.differing_queries(dimension_found(spark, sf), ["mode", "dim"], ["doc_found"])
