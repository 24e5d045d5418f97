"""Regression cases: does a search still return what it must, and what changed since the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def evaluate_cases(cases: DataFrame, targets: DataFrame, records: DataFrame, hits: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """PASS, FAIL or ERROR per case. ``targets`` holds (name, document, chunk_index); ``records`` one search per case, with code_version and
    config_fingerprint where the log has them; ``outputs`` (name, output_chars) what it printed, none if left out."""
    for name in ("code_version", "config_fingerprint"):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast("string"))
    if outputs is None:
        outputs = records.select("name", F.lit(None).cast("long").alias("output_chars"))
    best = hits.join(targets, ["name", "document", "chunk_index"]).groupBy("name").agg(F.min("rank").alias("rank"))
    top = hits.groupBy("name").agg(F.min_by("score", "rank").alias("top_score"))
    joined = cases.join(records, "name", "left").join(best, "name", "left").join(top, "name", "left").join(outputs.select("name", "output_chars"), "name", "left")
    passed = F.when(F.col("kind") == "zero", F.col("hit_count") == 0).otherwise(F.col("rank").isNotNull())
    status = F.when(F.col("search_id").isNull(), "ERROR").when(passed, "PASS").otherwise("FAIL")
    return joined.select(
        "name", "kind", status.alias("status"), "rank", F.col("hit_count").alias("result_count"), "candidates", "top_score",
        "duration_ms", F.when(F.col("search_id").isNotNull(), F.col("output_chars")).alias("output_chars"), "code_version",
        F.col("config_fingerprint").alias("fingerprint"), F.when(F.col("search_id").isNull(), "no search record written").alias("error"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("cases"), *[F.count_if(F.col("status") == s).alias(n) for s, n in
                                       (("PASS", "passed"), ("FAIL", "failed"), ("ERROR", "errors"))])


def compare_runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Change of every current case against the baseline; cases only the baseline knows are left out."""
    fields = ["status", "rank", "result_count"]
    before = baseline.select("name", *[F.col(c).alias(f"before_{c}") for c in fields], F.lit(True).alias("_known"))
    j = current.select("name", *[F.col(c).alias(f"after_{c}") for c in fields]).join(before, "name", "left")
    was, is_ = F.col("before_status") == "PASS", F.col("after_status") == "PASS"
    change = (
        F.when(F.col("_known").isNull(), "new case").when(~was & is_, "fixed").when(was & ~is_, "regressed")
        .when(~F.col("before_rank").eqNullSafe(F.col("after_rank")), "rank moved").otherwise("unchanged")
    )
    return j.select("name", change.alias("change"), *[f"{side}_{c}" for c in fields for side in ("before", "after")])


def leaked_ids(ids: DataFrame, log: DataFrame) -> DataFrame:
    """Ids that occur in the other log; none are expected."""
    return ids.select("search_id").distinct().join(log.select("search_id"), "search_id", "left_semi")
