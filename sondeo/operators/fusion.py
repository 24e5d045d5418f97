"""Fusing two ranked lists of the same queries. ``keys`` name the list, so one job can fuse many parameter cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondeo.operators.retrieval import ALPHA, KEY, RRF_K


def _both(dense: DataFrame, sparse: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    def side(df, p): return df.select(*keys, *KEY, F.col("rank").alias(f"{p}_rank"), *[F.col(c).alias(f"{p}_{c}") for c in extra])
    return side(dense, "d").join(side(sparse, "s"), [*keys, *KEY], "full_outer")


def _ranked(scored: DataFrame, keys: list[str], k: int | None) -> DataFrame:
    """Best first; equal scores keep the dense order, then the sparse order, then the key."""
    order = [F.desc("_s"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank"), *[F.asc(c) for c in KEY]]
    w = Window.partitionBy(*keys).orderBy(*order)
    out = scored.withColumn("_s", F.round("raw", 12)).withColumn("rank", F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out.select(*keys, "rank", *KEY, F.round("raw", 6).alias("score"))


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, rrf_k: int | Column = RRF_K, keys: list[str] = ["query_id"], k: int | None = None) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over both lists, rounded to six digits."""
    part = lambda c: F.coalesce(F.lit(1.0) / (rrf_k + F.col(c)), F.lit(0.0))
    scored = _both(dense, sparse, keys, []).withColumn("raw", part("d_rank") + part("s_rank"))
    return _ranked(scored, keys, k)


def convex(dense: DataFrame, sparse: DataFrame, alpha: float | Column = ALPHA, keys: list[str] = ["query_id"], k: int | None = None) -> DataFrame:
    """alpha * d / max(d) + (1 - alpha) * s / max(s) on the rounded scores; a list without positive score does not count."""
    def scaled(df):
        top = df.groupBy(*keys).agg(F.max("score").alias("_top"))
        return df.join(top, keys).filter("_top > 0").withColumn("share", F.col("score") / F.col("_top"))

    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    scored = _both(scaled(dense), scaled(sparse), keys, ["share"]).withColumn(
        "raw", F.coalesce(alpha * F.col("d_share"), F.lit(0.0)) + F.coalesce((F.lit(1.0) - alpha) * F.col("s_share"), F.lit(0.0)))
    return _ranked(scored, keys, k)
