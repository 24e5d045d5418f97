"""Queries on keeping tables in step with their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.catalog import standins as st
from sondeo.catalog.base import ctes, query, text_table
from sondeo.operators import chunking, inventory, sync
from sondeo.session import scratch_folder
from sondeo.sources.versioned import VersionedTable

BASE = (st.CORPUS, st.MANIFEST)
DIFF = """diff AS (SELECT coalesce(c.collection, s.collection) AS collection, coalesce(c.document, s.document) AS document, c.sha256 AS new_sha, s.sha256 AS old_sha,
  CASE WHEN s.sha256 IS NULL THEN 'added' WHEN c.sha256 IS NULL THEN 'removed' WHEN c.sha256 <> s.sha256 THEN 'updated' ELSE 'unchanged' END AS change
  FROM current_hashes c FULL OUTER JOIN stored_hashes s ON c.collection = s.collection AND c.document = s.document)"""


@query("j09_hash_diff", ctes(*BASE, DIFF) + "SELECT * FROM diff")
def j09(spark, sf):
    return sync.hash_diff(st.current_hashes(spark, sf), st.stored_hashes(spark, sf))


# Chunk table for the completeness test: one chunk per line of the text, one line missing for some documents.
STORED = """stored_chunks AS (SELECT collection, document, doc_id, n AS total_chunks, unnest(range(n)) AS chunk_index FROM (SELECT collection, document, doc_id, len(string_split(content, chr(10))) AS n FROM corpus))
, whole AS (SELECT collection, document FROM stored_chunks WHERE NOT (doc_id % 5 = 0 AND chunk_index = 0) GROUP BY ALL HAVING count(*) = max(total_chunks))"""


@query("j10_index_classification", ctes(*BASE, STORED) + """
SELECT c.collection, c.document, CASE WHEN s.sha256 = c.sha256 THEN 'skip' WHEN s.sha256 IS NULL AND w.document IS NOT NULL THEN 'adopt' ELSE 'index' END AS action, false AS force
FROM current_hashes c LEFT JOIN stored_hashes s ON c.collection = s.collection AND c.document = s.document LEFT JOIN whole w ON c.collection = w.collection AND c.document = w.document
UNION ALL SELECT collection, document, 'index', true FROM current_hashes""")
def j10(spark, sf):
    lines = st.corpus(spark, sf).withColumn("parts", F.split("content", "\n", -1))
    stored = chunking.enrich(lines, "parts").join(lines.select("collection", "document", "doc_id"), ["collection", "document"]).filter(
        "NOT (doc_id % 5 = 0 AND chunk_index = 0)")
    progress, now, old = inventory.progress(stored), st.current_hashes(spark, sf), st.stored_hashes(spark, sf)
    part = lambda force: sync.classify_for_index(now, old, progress, force).select("collection", "document", "action", F.lit(force).alias("force"))
    return part(False).unionByName(part(True))


# Cut at a size that no text reaches, a document is one chunk, its text without white space at the ends; SQL can say that.
WHOLE = 1 << 30
WHOLE_CHUNKS = """whole_chunks AS (SELECT collection, document, 0::INT AS chunk_index, 1::INT AS total_chunks, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content
  FROM corpus WHERE regexp_matches(content, '\\S'))"""


def _synced(spark, sf):
    corpus = st.corpus(spark, sf, text_table).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).select("collection", "document", "sha256", "content")
    stored = st.stored_hashes(spark, sf)
    table = stored.select("collection", "document", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("old").alias("content"))
    diff = sync.plan_sync(corpus, stored)
    return (*sync.apply_sync(corpus, stored, table, diff, size=WHOLE), diff)


@query("j11_sync_manifest", ctes(*BASE) + "SELECT collection, document, sha256 FROM current_hashes")
def j11(spark, sf):
    return _synced(spark, sf)[1]


@query("j11_sync_report", ctes(*BASE, DIFF, WHOLE_CHUNKS) + """
SELECT d.collection, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (change = 'unchanged') AS unchanged, count(w.document) FILTER (change IN ('added', 'updated')) AS total_chunks_indexed
FROM diff d LEFT JOIN whole_chunks w ON w.collection = d.collection AND w.document = d.document GROUP BY 1""")
def j11b(spark, sf):
    _, _, new_chunks, diff = _synced(spark, sf)
    return sync.sync_report(diff, new_chunks)


@query("j11_synced_chunks", ctes(*BASE, DIFF, WHOLE_CHUNKS) + """
SELECT w.* FROM whole_chunks w JOIN diff d ON w.collection = d.collection AND w.document = d.document WHERE change IN ('added', 'updated')
UNION ALL SELECT collection, document, 0, 1, 'old' FROM diff WHERE change = 'unchanged'""")
def j11c(spark, sf):
    return _synced(spark, sf)[0]


@query("j11_synced_chunk_sizes")
def j11d(spark, sf):
    """The synced table with documents cut at the usual size."""
    return _cut_sync(spark, sf).select("collection", "document", "chunk_index", "total_chunks", F.length("content").alias("size"))


def _cut_sync(spark, sf):
    corpus = st.corpus(spark, sf, text_table).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).select("collection", "document", "sha256", "content")
    stored = st.stored_hashes(spark, sf)
    table = stored.select("collection", "document", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("old").alias("content"))
    return sync.apply_sync(corpus, stored, table, sync.plan_sync(corpus, stored))[0]


# Two states of the corpus, one after the other, through the versioned table: what the second commit left.
@query("j11_versioned_sync", ctes(*BASE, DIFF, WHOLE_CHUNKS) + """
SELECT s.collection, s.document, s.sha256, coalesce(w.chunk_index, -1) AS chunk_index, coalesce(w.content, '') AS content
FROM current_hashes s LEFT JOIN whole_chunks w ON w.collection = s.collection AND w.document = s.document""")
def j11e(spark, sf):
    versions = VersionedTable(spark, f"{scratch_folder(spark)}/table")
    corpus = st.corpus(spark, sf, text_table)
    hashed = corpus.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    before = hashed.join(st.stored_hashes(spark, sf).select("collection", "document", F.col("sha256").alias("old")), ["collection", "document"], "right")
    before = before.select("collection", "document", F.col("old").alias("sha256"), F.coalesce("content", F.lit("gone")).alias("content"))
    versions.sync(before, size=WHOLE)
    versions.sync(hashed.select("collection", "document", "sha256", "content"), size=WHOLE)
    rows = versions.hashes().join(versions.chunks(), ["collection", "document"], "left")
    return rows.select("collection", "document", "sha256", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), F.coalesce("content", F.lit("")).alias("content"))
