"""Queries on retrieval, fusion and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.catalog import standins as st
from sondeo.catalog.base import ctes, query, table, text_table
from sondeo.models import encoders
from sondeo.operators import chunking, fusion, retrieval
from sondeo.plans import modes

K = "collection, document, chunk_index"

# -- lists over vectors --------------------------------------------------------------------------------------------------------


def ranked_sql(name: str, source: str, depth: int, keys: str = "query_id", digits: int = 4) -> str:
    return f"""{name} AS (SELECT {keys}, rank, {K}, round(raw, {digits}) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY raw DESC, {K}) AS rank FROM {source}) WHERE rank <= {depth})"""


DENSE_ALL = f"dense_all AS (SELECT query_id, {K}, round(list_cosine_similarity(qv, embedding), 9) AS raw FROM vec_queries CROSS JOIN vec_chunks)"
DENSE = ranked_sql("dense", "dense_all", 50)
SPARSE_ALL = f"""long_chunks AS (SELECT {K}, unnest(range(1, 65))::INT AS dim, unnest(embedding) AS weight FROM vec_chunks),
sparse_chunks AS (SELECT * FROM long_chunks WHERE weight > 0.12), sparse_queries AS (SELECT vec_id AS query_id, dim, weight FROM sparse_chunks JOIN vec_chunks USING ({K}) WHERE vec_id % 25 = 0),
cn AS (SELECT {K}, sqrt(sum(weight * weight)) AS cn FROM sparse_chunks GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS qn FROM sparse_queries GROUP BY 1),
sparse_all AS (SELECT q.query_id, c.collection, c.document, c.chunk_index, round(sum(c.weight * q.weight) / (any_value(cn) * any_value(qn)), 9) AS raw
  FROM sparse_chunks c JOIN sparse_queries q USING (dim) JOIN cn ON cn.collection = c.collection AND cn.document = c.document AND cn.chunk_index = c.chunk_index JOIN qn ON qn.query_id = q.query_id GROUP BY ALL)"""
SPARSE = ranked_sql("sparse", "sparse_all", 50)
WORDS = "array_to_string(list_transform(list_filter(range(1, 65), lambda i: embedding[i] > {t}), lambda i: 'w' || i::VARCHAR), ' ')"
WORDED = f"""worded AS (SELECT vec_id, {K}, label, embedding, {WORDS.format(t='0.18')} AS content, {WORDS.format(t='0.24')} AS query FROM vec_chunks)"""


def lexical_sql(chunks: str, queries: str, depth: int) -> str:
    """``chunks``: key, content; ``queries``: query_id, query."""
    tok = lambda c: f"regexp_extract_all(lower({c}), '([\\p{{L}}\\p{{N}}]+)', 1)"
    return f"""lx AS (SELECT {K}, {tok('content')} AS t FROM {chunks}), lstat AS (SELECT count(*) AS n_chunks, avg(len(t)) AS mean_length FROM lx),
lq AS (SELECT query_id, unnest(list_distinct({tok('query')})) AS term FROM {queries}), ltf AS (SELECT {K}, length, term, count(*) AS tf FROM (SELECT {K}, len(t) AS length, unnest(t) AS term FROM lx) WHERE term IN (SELECT term FROM lq) GROUP BY ALL),
ldf AS (SELECT term, count(*) AS df FROM ltf GROUP BY 1), lnt AS (SELECT query_id, count(*) AS n_terms FROM lq GROUP BY 1),
lm AS (SELECT query_id, {K}, count(*) AS found, round(sum(ln(1 + (n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 9) AS raw
  FROM lq JOIN ltf USING (term) JOIN ldf USING (term) CROSS JOIN lstat GROUP BY ALL),
lexical_all AS (SELECT m.* FROM lm m JOIN lnt USING (query_id) WHERE found = n_terms OR query_id NOT IN (SELECT query_id FROM lm JOIN lnt USING (query_id) WHERE found = n_terms)),
{ranked_sql('bm25', 'lexical_all', depth)}"""


def dense50(spark, sf):
    return retrieval.dense_top_k(st.vec_queries(spark, sf), st.vec_chunks(spark, sf), 50)


def sparse_long(spark, sf):
    c = st.vec_chunks(spark, sf)
    chunks = c.select("vec_id", *retrieval.KEY, F.posexplode("embedding").alias("pos", "w")).select(
        "vec_id", *retrieval.KEY, (F.col("pos") + 1).alias("dim"), F.col("w").cast("double").alias("weight")).filter("weight > 0.12")
    queries = chunks.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "dim", "weight")
    return queries, chunks.drop("vec_id")


def sparse50(spark, sf):
    return retrieval.sparse_top_k(*sparse_long(spark, sf), 50)


def worded(spark, sf):
    def words(t):
        return F.array_join(F.filter(F.transform("embedding", lambda x, i: F.when(x > t, F.concat(F.lit("w"), (i + 1).cast("string")))), lambda w: w.isNotNull()), " ")
    return st.vec_chunks(spark, sf).withColumn("content", words(0.18)).withColumn("query", words(0.24))


def bm25_vec(spark, sf, depth):
    w = worded(spark, sf)
    return retrieval.lexical_top_k(w.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "query"), w, depth)


def outside_scores(hits):
    """Stand-in for a scorer's answer: any function of query and chunk."""
    raw = (F.col("chunk_index") * 37 + F.col("query_id") * 11) % 101
    return hits.withColumn("relevance", raw / F.lit(101.0) - F.lit(0.2))


RELEVANCE = "((chunk_index * 37 + query_id * 11) % 101) / 101.0::DOUBLE - 0.2::DOUBLE"


@query("r01_dense_top_k", ctes(st.VECTORS, DENSE_ALL, DENSE) + f"SELECT query_id, rank, {K}, score FROM dense")
def r01(spark, sf):
    return dense50(spark, sf)


FILTERED = f"""fq AS (SELECT query_id, qv, CASE query_id % 3 WHEN 0 THEN NULL ELSE 'col' || (query_id % 4)::VARCHAR END AS fc, CASE query_id % 2 WHEN 0 THEN 'v%' ELSE 'v' || (query_id % 10)::VARCHAR END AS fd,
  CASE query_id % 5 WHEN 0 THEN 'v1' ELSE NULL END AS fe FROM vec_queries),
dense_all AS (SELECT query_id, {K}, round(list_cosine_similarity(qv, embedding), 9) AS raw FROM fq JOIN vec_chunks ON (fc IS NULL OR collection = fc) AND (CASE WHEN contains(fd, '%') THEN document LIKE fd ELSE document = fd END) AND (fe IS NULL OR document <> fe))"""


@query("r01_filtered_dense", ctes(st.VECTORS, FILTERED, DENSE) + f"SELECT query_id, rank, {K}, score FROM dense WHERE rank <= 12")
def r01b(spark, sf):
    return retrieval.dense_top_k(filtered_queries(spark, sf), st.vec_chunks(spark, sf), 12)


def filtered_queries(spark, sf):
    q = F.col("query_id")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return st.vec_queries(spark, sf).select(
        "query_id", "embedding", F.when(q % 3 != 0, tag("col", q % 4)).alias("filter_collection"),
        F.when(q % 2 == 0, "v%").otherwise(tag("v", q % 10)).alias("filter_document"), F.when(q % 5 == 0, "v1").alias("filter_exclude"))


@query("r02_sparse_top_k", ctes(st.VECTORS, SPARSE_ALL, SPARSE) + f"SELECT query_id, rank, {K}, score FROM sparse")
def r02(spark, sf):
    return sparse50(spark, sf)


DOC_TEXTS = """dt AS (SELECT source AS collection, doc_id::VARCHAR AS document, 0::INT AS chunk_index, text AS content FROM documents), bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""


def _doc_texts(spark, sf):
    d = text_table(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("document"), F.pmod("doc_id", F.lit(1)).cast("int").alias("chunk_index"), F.col("text").alias("content"))
    return d, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("r03_lexical_top_k", ctes(DOC_TEXTS, lexical_sql("dt", "bq", 10)) + f"SELECT query_id, rank, {K}, score FROM bm25")
def r03(spark, sf):
    docs, queries = _doc_texts(spark, sf)
    return retrieval.lexical_top_k(queries, docs, 10)


def fused_sql(name: str, keys: str, raw: str, dense: str = "dense", sparse: str = "sparse", depth: int | None = None) -> str:
    limit = f"WHERE rank <= {depth}" if depth else ""
    return f"""{name} AS (SELECT {keys}, rank, {K}, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(raw, 12) DESC, dr NULLS LAST, sr NULLS LAST, {K}) AS rank FROM (
  SELECT {keys}, {K}, d.rank AS dr, s.rank AS sr, {raw} AS raw FROM {dense} d FULL OUTER JOIN {sparse} s USING ({keys}, {K}))) {limit})"""


RRF_RAW = "coalesce(1.0::DOUBLE / ({k} + d.rank), 0) + coalesce(1.0::DOUBLE / ({k} + s.rank), 0)"
SCALED = f"""dsc AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS share, max(score) OVER (PARTITION BY query_id) AS top FROM dense QUALIFY top > 0),
ssc AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS share, max(score) OVER (PARTITION BY query_id) AS top FROM sparse QUALIFY top > 0)"""
CC_RAW = "coalesce({a} * d.share, 0) + coalesce((1.0::DOUBLE - {a}) * s.share, 0)"
LISTS = (st.VECTORS, DENSE_ALL, DENSE, SPARSE_ALL, SPARSE)


@query("r04_reciprocal_rank_fusion", ctes(*LISTS, fused_sql("fused", "query_id", RRF_RAW.format(k=60))) + "SELECT * FROM fused")
def r04(spark, sf):
    return fusion.reciprocal_rank(dense50(spark, sf), sparse50(spark, sf))


@query("r05_convex_combination", ctes(*LISTS, SCALED, fused_sql("fused", "query_id", CC_RAW.format(a="0.8::DOUBLE"), "dsc", "ssc")) + "SELECT * FROM fused")
def r05(spark, sf):
    return fusion.convex(dense50(spark, sf), sparse50(spark, sf))


# The same fusion over long lists: order = query, its lines by price and by discount.
LINES = """lines AS (SELECT l_orderkey AS query_id, 'c' AS collection, 'd' || l_partkey::VARCHAR AS document, l_linenumber::INT AS chunk_index, max(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY ALL)"""


@query("r04_fusion_of_order_lines", ctes(LINES, f"a AS (SELECT query_id, {K}, price AS raw FROM lines)", ranked_sql("dense", "a", 100),
       f"b AS (SELECT query_id, {K}, discount AS raw FROM lines WHERE discount > 0.02)", ranked_sql("sparse", "b", 100), fused_sql("fused", "query_id", RRF_RAW.format(k=60))) + "SELECT * FROM fused")
def r04b(spark, sf):
    lines = order_lines(spark, sf)
    dense = retrieval.with_ranks(lines.withColumn("score", F.col("price")))
    sparse = retrieval.with_ranks(lines.filter("discount > 0.02").withColumn("score", F.col("discount")))
    return fusion.reciprocal_rank(dense, sparse)


def order_lines(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("query_id"), F.lit("c").alias("collection"), F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("document"),
        F.col("l_linenumber").cast("int").alias("chunk_index")).agg(F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))


@query("w01_rank_assignment", ctes(LINES) + f"SELECT query_id, {K}, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, {K}) AS rank FROM lines")
def w01(spark, sf):
    return retrieval.with_ranks(order_lines(spark, sf).withColumn("score", F.col("price"))).select("query_id", *retrieval.KEY, "rank")


def rerank_sql(name: str, source: str, k: int, depth: int = 50) -> str:
    return f"""{name} AS (SELECT query_id, rank2 AS rank, {K}, round(rel, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS rank2 FROM
  (SELECT *, {RELEVANCE} AS rel FROM {source} WHERE rank <= {depth})) WHERE rank2 <= {k})"""


@query("r06_rerank", ctes(st.VECTORS, DENSE_ALL, DENSE, rerank_sql("reranked", "dense", 10)) + "SELECT * FROM reranked")
def r06(spark, sf):
    hits = dense50(spark, sf)
    return retrieval.apply_rerank(outside_scores(hits), 10).select("query_id", "rank", *retrieval.KEY, "score")


@query("r07_production_search", ctes(st.VECTORS, DENSE_ALL, DENSE, rerank_sql("reranked", "dense", 4, 30)) + "SELECT * FROM reranked WHERE score > 0")
def r07(spark, sf):
    found = retrieval.production_search(st.vec_queries(spark, sf), st.vec_chunks(spark, sf), outside_scores)
    return found.select("query_id", "rank", *retrieval.KEY, "score")


@query("r07_text_search")
def r07b(spark, sf):
    """Texts end to end: chunks and queries encoded by the bundled encoder, candidates rescored by word overlap."""
    chunks = chunking.chunk_documents(st.corpus(spark, sf, text_table))
    vectors = encoders.embed(chunks, "content", encoders.HashedTerms, encoders.DOCUMENT_PREFIX)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    queries = encoders.embed(asked, "text", encoders.HashedTerms, encoders.QUERY_PREFIX)

    def scores(hits):
        paired = hits.join(chunks.select(*retrieval.KEY, "content"), retrieval.KEY).join(asked, "query_id")
        return paired.withColumn("relevance", encoders.term_overlap(F.col("text"), F.col("content"))).drop("text", "content")

    return retrieval.production_search(queries, vectors, scores).select("query_id", "rank", *retrieval.KEY, "score")


@query("r13_run_specs", ctes(st.VECTORS, FILTERED, DENSE, rerank_sql("reranked", "dense", 30, 30)) + f"SELECT query_id, rank::INT AS rank, {K}, score, rank <= 3 + query_id % 10 AS kept FROM reranked")
def r13(spark, sf):
    specs = filtered_queries(spark, sf).withColumn("depth", 3 + F.col("query_id") % 10)
    return modes.run_specs(specs, st.vec_chunks(spark, sf), outside_scores).select("query_id", "rank", *retrieval.KEY, "score", "kept")


MODE_NAMES = ["dense", "sparse", "bm25", "hybrid", "cc", "cc+rerank", "hybrid+rerank", "dense+rerank-0.6b"]


def all_lists(spark, sf, bm25_depth=10):
    return {"dense": dense50(spark, sf), "sparse": sparse50(spark, sf), "bm25": bm25_vec(spark, sf, bm25_depth)}


MODE_CTES = (*LISTS, WORDED, lexical_sql("worded", "(SELECT vec_id AS query_id, query FROM worded WHERE vec_id % 25 = 0)", 10),
             fused_sql("hybrid", "query_id", RRF_RAW.format(k=60)), SCALED, fused_sql("cc", "query_id", CC_RAW.format(a="0.8::DOUBLE"), "dsc", "ssc"),
             rerank_sql("rr_cc", "cc", 10), rerank_sql("rr_hybrid", "hybrid", 10), rerank_sql("rr_dense", "dense", 10))
MODE_UNION = " UNION ALL ".join(
    f"SELECT query_id, rank, {K}, score, '{m}' AS mode FROM {t} WHERE rank <= 10"
    for m, t in zip(MODE_NAMES, ["dense", "sparse", "bm25", "hybrid", "cc", "rr_cc", "rr_hybrid", "rr_dense"]))


@query("r08_mode_family", ctes(*MODE_CTES) + f"SELECT mode, count(*) AS hits, count(DISTINCT query_id) AS queries, round(sum(score), 4) AS score_sum FROM ({MODE_UNION}) GROUP BY 1")
def r08(spark, sf):
    hits = modes.mode_table(MODE_NAMES, all_lists(spark, sf), 10, score_pairs=outside_scores)
    return hits.groupBy("mode").agg(F.count("*").alias("hits"), F.count_distinct("query_id").alias("queries"), F.round(F.sum("score"), 4).alias("score_sum"))


@query("r14_mode_comparison", ctes(*MODE_CTES) + MODE_UNION)
def r14(spark, sf):
    return modes.mode_table(MODE_NAMES, all_lists(spark, sf), 10, score_pairs=outside_scores)


@query("r09_truncated_vectors", """
SELECT vec_id, d AS dims, round(sqrt(list_sum(list_transform(t, lambda x: (x / n) * (x / n)))), 6) AS norm, round(t[1] / n, 6) AS first, round(t[d] / n, 6) AS last
FROM (SELECT vec_id, d, embedding[1:d]::DOUBLE[] AS t, sqrt(list_sum(list_transform(embedding[1:d]::DOUBLE[], lambda x: x * x))) AS n FROM embeddings, (VALUES (8), (16), (32)) v(d))""")
def r09(spark, sf):
    e = table(spark, sf, "embeddings")
    out = None
    for d in (8, 16, 32):
        t = e.select("vec_id", F.lit(d).alias("dims"), retrieval.truncated(F.col("embedding"), d).alias("t"))
        norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, x: a + x * x))
        part = t.select("vec_id", "dims", F.round(norm, 6).alias("norm"), F.round(F.col("t")[0], 6).alias("first"), F.round(F.col("t")[d - 1], 6).alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


# -- encoders --------------------------------------------------------------------------------------------------------------------

@query("m01_embedded_chunks")
def m01(spark, sf):
    v = encoders.embed(st.chunks(spark, sf), "content", encoders.HashedTerms, encoders.DOCUMENT_PREFIX)
    return v.select("collection", "document", "chunk_index", F.size("embedding").alias("dims"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


def _overlap_pairs(pairs):
    return [len(set(q.lower().split()) & set(c.lower().split())) / max(1, len(set(q.lower().split()))) for q, c in pairs]


@query("m02_scored_pairs")
def m02(spark, sf):
    docs, queries = _doc_texts(spark, sf)
    found = retrieval.lexical_top_k(queries, docs, 10).join(docs, retrieval.KEY).join(queries, "query_id")
    return encoders.score_pairs(found, "query", "content", lambda: _overlap_pairs).select("query_id", "rank", "document", F.round("relevance", 6).alias("relevance"))


@query("m03_sparse_encoding", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS w FROM documents),
c AS (SELECT doc_id, (('0x' || left(md5(w), 8))::BIGINT % 30522)::INT AS dim, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, dim, round(ln(1.0::DOUBLE + n), 6) AS weight FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(ln(1.0::DOUBLE + n), 6) DESC, dim) <= 256""")
def m03(spark, sf):
    return encoders.sparse_encode(text_table(spark, sf, "documents"), ["doc_id"], "text", encoders.MAX_ACTIVE_DIMS)


@query("r02_sparse_text_search", """
WITH w AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS w FROM documents UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) FROM benchmark),
c AS (SELECT side, id, (('0x' || left(md5(w), 8))::BIGINT % 30522)::INT AS dim, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT side, id, dim, round(ln(1.0::DOUBLE + n), 6) AS weight FROM c QUALIFY row_number() OVER (PARTITION BY side, id ORDER BY round(ln(1.0::DOUBLE + n), 6) DESC, dim) <= 256),
nm AS (SELECT side, id, sqrt(sum(weight * weight)) AS norm FROM e GROUP BY ALL),
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.weight * d.weight) / (any_value(nq.norm) * any_value(nd.norm)), 9) AS raw FROM e q JOIN e d ON q.side = 'q' AND d.side = 'd' AND q.dim = d.dim
  JOIN nm nq ON nq.side = 'q' AND nq.id = q.id JOIN nm nd ON nd.side = 'd' AND nd.id = d.id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id::VARCHAR) AS rank, doc_id::VARCHAR AS document, round(raw, 4) AS score FROM s QUALIFY rank <= 10""")
def r02b(spark, sf):
    docs, queries = _doc_texts(spark, sf)
    docs = docs.withColumn("collection", F.left("collection", F.lit(0)))
    store = retrieval.kept_store(encoders.sparse_store(docs, retrieval.KEY, "content", encoders.MAX_ACTIVE_DIMS))
    asked = encoders.sparse_encode(queries, ["query_id"], "query", encoders.MAX_ACTIVE_DIMS)
    return retrieval.sparse_top_k(asked, None, 10, store).select("query_id", "rank", "document", "score")
