"""The registered queries of this folder, one per operator, and the DuckDB form of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import (boosted_rules, gap_packing, hnsw, mixing, piece_scan, repeats, sharding, token_alignment, token_files, trie_counts, trie_join,
                        vote_classifier, warc)
from sondeo.llm.common import new_folder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return vote_classifier.classify(docs, vote_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(_table(spark, sf_dir, "documents"), PIECES)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_records(warc.responses(_table(spark, sf_dir, "pages")), path)
    out = warc.derive(warc.read_records(spark, path))
    return out.withColumn("page_id", F.col("source_key").cast("long")).drop("source_key")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact``: decoding the ids gives the text back."""
    found = piece_scan.round_trip(piece_scan.encode(_table(spark, sf_dir, "documents"), PIECES), PIECES)
    return found.withColumn("exact", F.col("text_crc32") == F.col("source_crc32")).drop("text_crc32", "source_crc32")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return boosted_rules.quality_rules(docs, boosted_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_dataset(_table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_files.read_dataset(spark, path, BYTE_BPE, digest=True).withColumnsRenamed({"id": "doc_id", "n": "n_tokens", "crc32": "ids_crc32"})


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(_table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_counts(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.detect(_table(spark, sf_dir, "documents"))


def op13_gap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = gap_packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_quality_classifier, op3_token_counts, op4_source_mixing, op5_warc_derivatives, op6_sentencepiece, op7_quality_rules,
    op8_token_files, op9_sharding, op10_jaccard_join, op11_token_alignment, op12_periodic_runs, op13_gap_packing)}


def _replaced(column: str) -> str:
    for pattern, place in warc.TO_TEXT:
        text, to = (x.replace("'", "''").replace("\n", "'||chr(10)||'") for x in (pattern, place))
        column = f"regexp_replace({column}, '{text}', '{to}', 'g')"
    return column


_UUID = "'<urn:uuid:'||h[1:8]||'-'||h[9:12]||'-'||h[13:16]||'-'||h[17:20]||'-'||h[21:32]||'>'"

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE fit),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id, least(v.vec_id, coalesce(m.b, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = v.vec_id""",
    "op10_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, coalesce(c.n, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = w.doc_id""",
    "op5_warc_derivatives": f"""
WITH p AS (SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri, coalesce(html, '') AS page FROM pages),
r AS (SELECT *, 'HTTP/1.1 200 OK'||chr(13)||chr(10)||'Content-Type: text/html; charset=utf-8'||chr(13)||chr(10)||'Content-Length: '||strlen(page)||chr(13)||chr(10)||chr(13)||chr(10)||page AS block,
  md5('response'||chr(10)||coalesce(page_id::VARCHAR, '')||chr(10)||coalesce(target_uri, '')) AS h FROM p),
s AS (SELECT * EXCLUDE (block, h), {_UUID} AS refers_to, 'sha256:'||sha256(block) AS source_block_digest, 'sha256:'||sha256(page) AS payload_digest FROM r),
d AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'status: 200'||chr(13)||chr(10)||'content-type: text/html; charset=utf-8'||chr(13)||chr(10)
    ||'content-length: '||strlen(page)||chr(13)||chr(10)||'title: '||regexp_replace(regexp_extract(page, '(?is)<title[^>]*>(.*?)</title', 1), '[\\r\\n\\t ]+', ' ', 'g')||chr(13)||chr(10)
    ||'outlinks: '||len(regexp_extract_all(page, '(?i)<a\\s[^>]*href'))||chr(13)||chr(10) AS block FROM s
  UNION ALL SELECT *, 'conversion', 'text/plain', {_replaced('page')} FROM s),
i AS (SELECT *, md5(record_type||chr(10)||refers_to) AS h FROM d)
SELECT record_type, {_UUID} AS record_id, refers_to, target_uri, '{warc.DATE}' AS date, 'sha256:'||sha256(block) AS block_digest, payload_digest, content_type, block,
  '200' AS source_status, 'text/html; charset=utf-8' AS source_type, source_block_digest, strlen(block)::BIGINT AS content_length, page_id FROM i""",
}
