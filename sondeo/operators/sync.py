"""Keeping a chunk table in step with its sources by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sondeo.operators import chunking
from sondeo.sources import tables

DOC = ["collection", "document"]


def hash_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """added, updated, removed or unchanged per (collection, document), by one full outer join on the key."""
    now = current.select(*DOC, F.col("sha256").alias("new_sha"))
    old = stored.select(*DOC, F.col("sha256").alias("old_sha"))
    change = (
        F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed")
        .when(F.col("new_sha") != F.col("old_sha"), "updated").otherwise("unchanged")
    )
    return now.join(old, DOC, "full_outer").select(*DOC, "new_sha", "old_sha", change.alias("change"))


def classify_for_index(current: DataFrame, stored: DataFrame, progress: DataFrame, force: bool = False) -> DataFrame:
    """skip (same hash), adopt (no hash, chunk set complete), else index; ``force`` indexes everything."""
    if force:
        return current.select(*DOC, "sha256", F.lit("index").alias("action"))
    old = stored.select(*DOC, F.col("sha256").alias("old_sha"))
    whole = progress.filter("complete").select(*DOC, F.lit(True).alias("whole"))
    action = (
        F.when(F.col("old_sha") == F.col("sha256"), "skip")
        .when(F.col("old_sha").isNull() & F.coalesce("whole", F.lit(False)), "adopt").otherwise("index")
    )
    return current.join(old, DOC, "left").join(whole, DOC, "left").select(*DOC, "sha256", action.alias("action"))


def plan_sync(corpus: DataFrame, stored: DataFrame, collections: DataFrame | None = None, removals: bool = True) -> DataFrame:
    """The diff a sync would apply. In scope are the collections named, else those of the corpus; without ``removals``
    (a partial delivery) only the documents that arrived."""
    if not removals:
        # The collection first: tables are partitioned by it, so other partitions need not be read.
        named = corpus.select("collection").distinct()
        scope = stored.join(named, "collection", "left_semi").join(corpus.select(*DOC), DOC, "left_semi")
    else:
        named = corpus.select("collection").distinct() if collections is None else collections.select("collection").distinct()
        scope = stored.join(named, "collection", "left_semi")
    return hash_diff(corpus, scope)


def apply_sync(
    corpus: DataFrame, stored: DataFrame, chunk_table: DataFrame, diff: DataFrame, size: int = chunking.CHUNK_SIZE,
    overlap: int = chunking.OVERLAP,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk table, manifest, new chunks) after a sync. Only added and updated documents are cut again.

    ``corpus`` holds (collection, document, sha256, content). A document that yields no chunk still gets its hash.
    """
    fresh = diff.filter(F.col("change").isin("added", "updated")).select(*DOC)
    stale = diff.filter(F.col("change") != "unchanged").select(*DOC)
    arrived = corpus.join(fresh, DOC, "left_semi")
    new_chunks = chunking.chunk_documents(arrived, size, overlap)
    table = chunk_table.join(stale, DOC, "left_anti").select(*new_chunks.columns).unionByName(new_chunks)
    manifest = stored.select(*DOC, "sha256").join(stale, DOC, "left_anti").unionByName(arrived.select(*DOC, "sha256"))
    return table, manifest, new_chunks


def sync_report(diff: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Counts per collection. Chunks are counted per document before they meet the collection."""
    counts = diff.groupBy("collection").agg(*[
        F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed", "unchanged")
    ])
    cut = new_chunks.groupBy("collection").agg(F.count("*").alias("total_chunks_indexed"))
    return counts.join(cut, "collection", "left").fillna(0, ["total_chunks_indexed"])


MANIFEST_SCHEMA = "collection string, document string, sha256 string"
CHUNK_SCHEMA = "collection string, document string, chunk_index int, total_chunks int, content string"


def sync_table(corpus: DataFrame, chunk_path: str, manifest_path: str, staging_path: str, size: int = chunking.CHUNK_SIZE,
               overlap: int = chunking.OVERLAP, collections: DataFrame | None = None, removals: bool = True) -> DataFrame:
    """Sync Parquet tables (partitioned by collection) in place and return the diff that was applied.

    The diff and the new partitions are staged first; the swap reads only staged rows and the manifest is swapped last.
    A run that stops half-way leaves the old manifest, so the next run finds the same documents to do again.
    """
    spark = corpus.sparkSession

    def read(path: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path) if tables.exists(spark, path) else spark.createDataFrame([], schema)

    stored, table = read(manifest_path, MANIFEST_SCHEMA), read(chunk_path, CHUNK_SCHEMA)
    diff_path, chunk_stage, manifest_stage = (f"{staging_path}/{n}" for n in ("diff", "chunks", "manifest"))
    plan_sync(corpus, stored, collections, removals).write.mode("overwrite").parquet(diff_path)
    diff = spark.read.parquet(diff_path)
    touched = diff.filter("change <> 'unchanged'").select("collection").distinct()
    narrow = lambda df: df.join(touched, "collection", "left_semi")
    new_table, new_manifest, _ = apply_sync(narrow(corpus), narrow(stored), narrow(table), diff, size, overlap)
    new_table.write.mode("overwrite").partitionBy("collection").parquet(chunk_stage)
    new_manifest.write.mode("overwrite").partitionBy("collection").parquet(manifest_stage)
    tables.swap_partitions(touched, chunk_stage, chunk_path, CHUNK_SCHEMA)
    tables.swap_partitions(touched, manifest_stage, manifest_path, MANIFEST_SCHEMA)
    return diff
