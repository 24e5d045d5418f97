"""Row filters on chunk tables, hits, logs and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sondeo.functions import logs

# Size limit of the encoder, modes without score threshold, known error codes.
MAX_TOKENS = 4000
CHARS_PER_TOKEN = 3
THRESHOLD_EXEMPT = {
    "hybrid", "hybrid+rerank", "bm25", "cc+rerank-8b", "hybrid+rerank-8b", "dense+rerank-0.6b", "dense+rerank-8b",
}
ERROR_CODES = ["single_instance_alive_replaced", "busy", "watchdog_unlinked_dead", "watchdog_killed_orphan",
               "log_write_failed", "log_config_resolve_failed"]
LOG_FAILURE_CODES = ["log_write_failed", "log_config_resolve_failed"]


def like_or_equal(col: Column, pattern: str | Column) -> Column:
    """LIKE only when the pattern holds ``%``; otherwise equality, so that ``_`` stays a plain character."""
    if isinstance(pattern, str):
        return col.like(pattern) if "%" in pattern else col == pattern
    return F.when(pattern.contains("%"), F.like(col, pattern)).otherwise(col == pattern)


def include_documents(df: DataFrame, pattern: str | None, column: str = "document") -> DataFrame:
    return df.filter(like_or_equal(F.col(column), pattern)) if pattern else df


def exclude_documents(df: DataFrame, pattern: str | None, column: str = "document") -> DataFrame:
    return df.filter(~like_or_equal(F.col(column), pattern)) if pattern else df


def containing(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Case-insensitive substring; ``%`` and ``_`` in the text stay wildcards."""
    return df.filter(F.col(column).ilike(f"%{text}%")) if text else df


def unknown_collections(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requested collection names that hold no chunk."""
    return requests.select("collection").distinct().join(chunks.select("collection").distinct(), "collection", "left_anti")


def in_window(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Inclusive at both ends; an absent bound leaves that end open."""
    bounds = []
    if since is not None:
        bounds.append(F.col(column) >= F.lit(since).cast("timestamp"))
    if until is not None:
        bounds.append(F.col(column) <= F.lit(until).cast("timestamp"))
    return df.filter(reduce(lambda a, b: a & b, bounds)) if bounds else df


def positive_scores(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("score") > 0)


def above_threshold(hits: DataFrame, mode: str, threshold: float) -> DataFrame:
    if threshold <= 0 or mode in THRESHOLD_EXEMPT:
        return hits
    return hits.filter(F.coalesce("score", F.lit(0.0)) >= threshold)


def encoder_input(text: Column, prefix: str = "") -> Column:
    """Text cut to the encoder limit, then the prefix in front (not counted)."""
    return F.concat(F.lit(prefix), F.left(text, F.lit(MAX_TOKENS * CHARS_PER_TOKEN)))


def has_vector(embedding: Column) -> Column:
    """False when every component is null; an empty vector counts as all null."""
    return F.exists(embedding, lambda v: v.isNotNull())


def split_null_vectors(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks to store, and the number of skipped ones per document."""
    kept = chunks.filter(has_vector(F.col("embedding")))
    skipped = (
        chunks.filter(~F.coalesce(has_vector(F.col("embedding")), F.lit(False)))
        .groupBy("collection", "document").agg(F.count("*").alias("skipped"))
    )
    return kept, skipped


def sampled_log(log: DataFrame, start_day: str) -> DataFrame:
    """Searches from a day on that returned something; days compare as text."""
    return log.filter((F.date_format("ts", "yyyy-MM-dd") >= start_day) & (F.col("hit_count") > 0))


def known_errors(errors: DataFrame, since_midnight_of=None, zone: str = "UTC") -> DataFrame:
    """Known codes only; optionally from local midnight of a given instant in ``zone``."""
    kept = errors.filter(F.col("code").isin(ERROR_CODES))
    if since_midnight_of is None:
        return kept
    local = F.from_utc_timestamp(F.lit(since_midnight_of).cast("timestamp"), zone)
    return kept.filter(F.col("ts") >= F.to_utc_timestamp(F.date_trunc("day", local), zone))


def with_version(log: DataFrame) -> DataFrame:
    return log.withColumn("version", logs.version_or_default(F.col("code_version")))
