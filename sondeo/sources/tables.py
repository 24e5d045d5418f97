"""Chunk tables, sidecars, manifests and collection metadata: reading and replacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DOC = ["collection", "document"]
SIDECAR = "collection string, document string, chunks array<struct<index: int, content: string>>"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of sidecar files: one record per line in any number, or one record (or array of records) laid out over lines.

    A file whose first line that is not blank is a whole record has one per line; any other is read as one text. A record that
    is no JSON, has another shape, or lacks its collection, document or chunks stops the read; ``path`` names sidecars only.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    lines = lines.filter(F.regexp_like("value", F.lit(r"\S")))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("value"))
    laid_out = first.filter(_parsed("value")["broken"].isNotNull()).select("file")
    texts = lines.join(laid_out, "file", "left_semi").groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return sidecar_rows(_records(lines.join(laid_out, "file", "left_anti").select("file", "value").unionByName(texts)))


def _parsed(text: str):
    """``records`` of a JSON object or an array of them. Set in brackets, so that nothing after the first value goes unread."""
    schema = f"records array<struct<{SIDECAR}>>, broken string"
    inner = F.when(F.regexp_like(text, F.lit(r"^\s*\[")), F.col(text)).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.from_json(F.concat(F.lit('{"records": '), inner, F.lit("}")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def _records(texts: DataFrame) -> DataFrame:
    whole = F.forall("p.records", lambda r: r["collection"].isNotNull() & r["document"].isNotNull() & r["chunks"].isNotNull()
                     & F.forall(r["chunks"], lambda c: c["index"].isNotNull() & c["content"].isNotNull()))
    sound = F.col("p.broken").isNull() & F.coalesce(whole, F.lit(False))
    broken = F.raise_error(F.concat(F.lit("not a sidecar record in "), "file", F.lit(": "), F.left("value", F.lit(200))))
    parsed = texts.withColumn("p", _parsed("value"))
    return parsed.select(F.explode(F.when(sound, F.col("p.records")).otherwise(broken.cast(parsed.select("p.records").schema[0].dataType))).alias("r")).select("r.*")


def sidecar_rows(sidecars: DataFrame) -> DataFrame:
    """Nested sidecars to chunk rows; the total is the array length, the index comes from the file."""
    return sidecars.select(*DOC, F.size("chunks").alias("total_chunks"), F.explode("chunks").alias("c")).select(
        *DOC, F.col("c.index").alias("chunk_index"), "total_chunks", F.col("c.content").alias("content")
    )


def sidecar_records(chunks: DataFrame) -> DataFrame:
    """One nested record per document, chunks in index order: an export. The table with a chunk per row is what scales."""
    return chunks.groupBy(*DOC).agg(
        F.array_sort(F.collect_list(F.struct(F.col("chunk_index").alias("index"), F.col("content").alias("content")))).alias("chunks")
    )


def write_sidecars(chunks: DataFrame, path: str) -> None:
    sidecar_records(chunks).write.mode("overwrite").json(path)


def replace_documents(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table without any old chunk of an incoming document, plus the incoming chunks."""
    kept = table.join(incoming.select(*DOC).distinct(), DOC, "left_anti")
    return kept.unionByName(incoming)


def delete_documents(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows that match no key; a null document in a key row means the whole collection."""
    whole = keys.filter(F.col("document").isNull()).select("collection").distinct()
    single = keys.filter(F.col("document").isNotNull()).select(*DOC).distinct()
    return table.join(whole, "collection", "left_anti").join(single, DOC, "left_anti")


def deleted_counts(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows per collection that ``delete_documents`` drops."""
    whole = keys.filter(F.col("document").isNull()).select("collection").distinct().withColumn("_w", F.lit(True))
    single = keys.filter(F.col("document").isNotNull()).select(*DOC).distinct().withColumn("_s", F.lit(True))
    hit = table.join(whole, "collection", "left").join(single, DOC, "left").filter(
        F.col("_w").isNotNull() | F.col("_s").isNotNull()
    )
    return hit.groupBy("collection").agg(F.count("*").alias("deleted"))


def duplicate_keys(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(*DOC, "chunk_index").agg(F.count("*").alias("copies")).filter("copies > 1")


def write_replaced(incoming: DataFrame, table_path: str, staging_path: str) -> None:
    """Replace documents in a Parquet table partitioned by collection; only partitions of incoming collections move."""
    spark = incoming.sparkSession
    touched = incoming.select("collection").distinct()
    table = spark.read.schema(incoming.schema).parquet(table_path) if exists(spark, table_path) else incoming.limit(0)
    affected = table.join(touched, "collection", "left_semi")
    replace_documents(affected, incoming).write.mode("overwrite").partitionBy("collection").parquet(staging_path)
    swap_partitions(touched, staging_path, table_path, incoming.schema)


def swap_partitions(touched: DataFrame, staging_path: str, table_path: str, schema) -> None:
    """Overwrite the staged partitions, and drop those of touched collections that have no staged row left.

    Reads only staged rows, so it can be run again after a failure. Collections are named by people in a manifest; the
    emptied ones among them are the only names that reach the driver.
    """
    spark = touched.sparkSession
    staged = spark.read.schema(schema).parquet(staging_path)
    emptied = touched.join(staged.select("collection").distinct(), "collection", "left_anti")
    names = [row["collection"] for row in emptied.toLocalIterator()]
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(table_path)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in names:
        system, target = _resolve(spark, f"{table_path}/collection={escape(name)}")
        system.delete(target, True)


def _resolve(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _resolve(spark, path)
    return system.exists(target)


def upsert_collections(stored: DataFrame, stats: DataFrame) -> DataFrame:
    """Metadata keyed by name: every column of an incoming row replaces the stored one, other rows stay."""
    kept = stored.join(stats.select("name"), "name", "left_anti")
    return kept.unionByName(stats, allowMissingColumns=True)


def collection_stats(chunks: DataFrame) -> DataFrame:
    """Documents and chunks per collection; counted per document first, so a hot collection is combined early."""
    per_doc = chunks.groupBy(*DOC).agg(F.count("*").alias("c"))
    return per_doc.groupBy(F.col("collection").alias("name")).agg(
        F.count("*").alias("doc_count"), F.sum("c").alias("chunk_count")
    )


def register_hashes(stored: DataFrame, hashes: DataFrame) -> DataFrame:
    """Upsert (collection, document, sha256, last_indexed_at)."""
    kept = stored.join(hashes.select(*DOC), DOC, "left_anti")
    return kept.unionByName(hashes.select(*stored.columns))
