"""Counts and completeness of chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sondeo.operators import filters


def collections(chunks: DataFrame, text: str | None = None) -> DataFrame:
    found = filters.containing(chunks, "collection", text)
    return found.groupBy("collection").agg(F.count("*").alias("chunks"))


def documents(chunks: DataFrame, collection: str | None = None, include=None, exclude=None, text=None) -> DataFrame:
    df = chunks.filter(F.col("collection") == collection) if collection else chunks
    df = filters.include_documents(df, include)
    df = filters.exclude_documents(df, exclude)
    df = filters.containing(df, "document", text)
    return df.groupBy("collection", "document").agg(F.count("*").alias("chunks"))


def progress(chunks: DataFrame) -> DataFrame:
    """Stored against expected chunks per document. ``complete`` asks for equality, ``done`` status for at least."""
    counted = chunks.groupBy("collection", "document").agg(
        F.count("*").alias("done"), F.max("total_chunks").cast("long").alias("total")
    )
    return counted.select(
        "collection", "document", "done", "total",
        F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total")).otherwise(0.0).alias("percent"),
        F.when(F.col("done") >= F.col("total"), "done").otherwise("in-progress").alias("status"),
        ((F.col("done") > 0) & F.coalesce(F.col("done") == F.col("total"), F.lit(False))).alias("complete"),
    )


def index_run_stats(documents_df: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: chunks and integer mean size; ``failed`` marks documents of the run that reported an error."""
    per_file = chunks.groupBy("collection", "document").agg(
        F.count("*").alias("chunks"), F.floor(F.sum(F.length("content")) / F.count("*")).alias("avg_chunk_size")
    )
    return documents_df.join(per_file, ["collection", "document"], "left").select(
        "collection", "document", F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("avg_chunk_size", F.lit(0)).alias("avg_chunk_size"), F.col("error").isNotNull().alias("failed"),
    )


def index_run_summary(per_file: DataFrame) -> DataFrame:
    return per_file.agg(
        F.count_if((F.col("chunks") > 0) & ~F.col("failed")).alias("files"),
        F.sum(F.when(~F.col("failed"), F.col("chunks")).otherwise(0)).alias("chunks"),
        F.count_if("failed").alias("errors"),
    )
