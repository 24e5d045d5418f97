"""Order-dependent building blocks that stay parallel when one key holds a large part of the rows.

A plain window sends every row of a key to one task. The helpers here cut each key into blocks of its order axis, work
inside the blocks, and carry one small summary row per block across block borders. The windows that remain per key run
over block summaries only: their number depends on the length of the axis, not on the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "_block"


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key. Spark limits per partition before the shuffle, so a hot key ships few rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def salt_of(columns: list[str], salt: int) -> Column:
    """Salt 0..salt-1 of a row; ``salt`` is a power of two. Never null, so joins on it add no filter to the scan."""
    if salt & (salt - 1):
        raise ValueError("salt must be a power of two")
    return F.xxhash64(*columns).bitwiseAND(F.lit(salt - 1)).cast("int")


def every_salt(salt: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))


def _carried(blocked: DataFrame, keys: list[str], summary: Column, over_blocks, out: str) -> DataFrame:
    """One row per (keys, block) with a value computed over that key's block summaries."""
    per_block = blocked.groupBy(*keys, BLOCK).agg(summary.alias("_summary"))
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    return per_block.select(*keys, BLOCK, over_blocks(F.col("_summary"), w).alias(out))


def _join_blocks(blocked: DataFrame, carried: DataFrame, keys: list[str], out: str) -> DataFrame:
    right = carried.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(BLOCK).alias("_r_block"), out)
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(BLOCK).eqNullSafe(F.col("_r_block"))]
    return blocked.join(right, reduce(lambda a, b: a & b, on), "left").drop(*[f"_r_{k}" for k in keys], "_r_block")


def next_row(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """``value`` (a struct) of the following row in ``order``; ``block`` must not decrease along the order."""
    blocked = df.withColumn(BLOCK, block).withColumn("_row_value", value)
    inner = blocked.withColumn("_inner_next", F.lead("_row_value").over(Window.partitionBy(*keys, BLOCK).orderBy(*order)))
    carried = _carried(
        blocked, keys, F.min_by("_row_value", F.struct(*order)), lambda s, w: F.lead(s).over(w), "_block_carry"
    )
    joined = _join_blocks(inner, carried, keys, "_block_carry")
    return joined.withColumn(out, F.coalesce("_inner_next", "_block_carry")).drop(BLOCK, "_row_value", "_inner_next", "_block_carry")


def next_later(df: DataFrame, keys: list[str], at: str, width: int, out: str) -> DataFrame:
    """Smallest value of ``at`` (a long) strictly above the row's own, within the keys; null for the last one."""
    blocked = df.withColumn(BLOCK, F.floor(F.col(at) / width))
    w = Window.partitionBy(*keys, BLOCK).orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    inner = blocked.withColumn("_inner_next", F.min(at).over(w))
    carried = _carried(blocked, keys, F.min(at), lambda s, w: F.lead(s).over(w), "_block_carry")
    joined = _join_blocks(inner, carried, keys, "_block_carry")
    return joined.withColumn(out, F.coalesce("_inner_next", "_block_carry")).drop(BLOCK, "_inner_next", "_block_carry")


def largest_before(
    points: DataFrame, marks: DataFrame, keys: list[str], at: str, start: str, payload: Column, width: int, out: str,
    strict: bool = False,
) -> DataFrame:
    """For each point the largest ``payload`` among marks with equal keys and ``start`` <= ``at`` (< when strict).

    Both axes are longs. With a payload struct that begins with the start this is an as-of lookup; with an end position
    it answers "does any span that begins by here reach that far". No pair of rows is formed. Null keys are equal.
    """
    point_cols = points.columns
    left = points.select(
        *keys, F.col(at).alias("_pos"), F.lit(0 if strict else 1).alias("_kind"), F.struct(*point_cols).alias("_point"),
        F.lit(None).alias("_payload"),
    )
    right = marks.select(
        *keys, F.col(start).alias("_pos"), F.lit(1 if strict else 0).alias("_kind"),
        F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), payload.alias("_payload"),
    )
    left = left.withColumn("_payload", F.col("_payload").cast(right.schema["_payload"].dataType))
    blocked = left.unionByName(right).withColumn(BLOCK, F.floor(F.col("_pos") / width))
    w = Window.partitionBy(*keys, BLOCK).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    inner = blocked.withColumn("_inner_best", F.max("_payload").over(w)).filter(F.col("_point").isNotNull())
    carried = _carried(
        blocked, keys, F.max("_payload"),
        lambda s, w: F.max(s).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_block_carry",
    )
    joined = _join_blocks(inner, carried, keys, "_block_carry")
    # A mark inside the block need not beat the carried one (an earlier span may reach further).
    best = F.greatest("_inner_best", "_block_carry") if not _is_struct(right) else (
        F.when(F.col("_inner_best").isNull(), F.col("_block_carry"))
        .when(F.col("_block_carry").isNull() | (F.col("_inner_best") >= F.col("_block_carry")), F.col("_inner_best"))
        .otherwise(F.col("_block_carry"))
    )
    return joined.select(*[F.col(f"_point.{c}").alias(c) for c in point_cols], best.alias(out))


def _is_struct(df: DataFrame) -> bool:
    return df.schema["_payload"].dataType.typeName() == "struct"


def index_percentiles(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], coarse: Column | None = None
) -> DataFrame:
    """Element number ``min(n - 1, int(n * q))`` of each group's sorted values, plus count and largest value.

    Values are first counted per (group, value). For whole numbers the rows left per group are bounded by the value
    range, so one window over them ranks everything. For other values pass ``coarse``, a whole number that does not
    decrease with the value (say ``floor``): blocks are ranked first and values only inside their block.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c"))
    upto = Window.unboundedPreceding
    if coarse is None:
        per_group = Window.partitionBy(*groups)
        ranked = counted.withColumn("_n", F.sum("_c").over(per_group)).withColumn(
            "_upto", F.sum("_c").over(per_group.orderBy(value).rowsBetween(upto, 0))
        )
    else:
        counted = counted.withColumn(BLOCK, coarse)
        per_block = counted.groupBy(*groups, BLOCK).agg(F.sum("_c").alias("_bc"))
        w = Window.partitionBy(*groups)
        offsets = per_block.select(
            *groups, BLOCK, F.sum("_bc").over(w).alias("_n"),
            (F.sum("_bc").over(w.orderBy(BLOCK).rowsBetween(upto, 0)) - F.col("_bc")).alias("_offset"),
        ).withColumn("_block_carry", F.struct("_n", "_offset")).drop("_n", "_offset")
        inner = counted.withColumn(
            "_in", F.sum("_c").over(Window.partitionBy(*groups, BLOCK).orderBy(value).rowsBetween(upto, 0))
        )
        ranked = _join_blocks(inner, offsets, groups, "_block_carry").select(
            *groups, value, "_c", F.col("_block_carry._n").alias("_n"), (F.col("_block_carry._offset") + F.col("_in")).alias("_upto")
        )
    picks = [
        F.min(F.when(F.col("_upto") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q))), F.col(value))).alias(n)
        for n, q in quantiles.items()
    ]
    return ranked.groupBy(*groups).agg(F.sum("_c").alias("n"), F.max(value).alias("max_value"), *picks)


def smallest_n(df: DataFrame, code: str, n: Column, slots: int = 65536) -> DataFrame:
    """Exactly ``n`` rows with the smallest 64-bit ``code``; ``n`` may use ``total``, the number of rows.

    Codes fall into ``slots`` equal ranges; only the range that holds the border is ranked row by row, so neither the
    driver nor a single task sees the sample.
    """
    width = 2**64 // slots
    blocked = df.withColumn(BLOCK, F.floor(F.col(code).cast("decimal(20,0)") / F.lit(width).cast("decimal(20,0)")).cast("long"))
    counts = blocked.groupBy(BLOCK).agg(F.count("*").alias("_c"))
    w = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    edges = counts.select(
        F.col(BLOCK), F.col("_c"), F.sum("_c").over(w).alias("_upto"),
        F.sum("_c").over(Window.partitionBy()).alias("total"),
    ).select(BLOCK, F.struct((F.col("_upto") - F.col("_c")).alias("before"), F.col("_upto").alias("upto"), n.alias("n")).alias("_edge"))
    joined = blocked.join(edges, BLOCK).filter(F.col("_edge.before") < F.col("_edge.n"))
    whole = joined.filter(F.col("_edge.upto") <= F.col("_edge.n"))
    border = joined.filter(F.col("_edge.upto") > F.col("_edge.n"))
    ranked = border.withColumn("_r", F.row_number().over(Window.partitionBy(BLOCK).orderBy(code)))
    kept = ranked.filter(F.col("_r") <= F.col("_edge.n") - F.col("_edge.before")).drop("_r")
    return whole.unionByName(kept).drop(BLOCK, "_edge")
