"""Shards of near-equal bytes by sampled splitters, with built-in functions only.

Rows are ordered by a hash of their text, then one of their id, so that equal texts lie side by side. A sample weighted by size is drawn
by hash; its quantiles split the order into many ranges per shard, which begin between texts. Ranges that came out too large are
subdivided, by another hash of the text. So a group of equal texts is always inside one unit, and a unit belongs to one shard. Only a group
larger than a shard, where whole groups and near-equal sizes exclude each other, is cut by the hash of the id into units of its own.
Large units are dealt first, each to the emptiest shard; small ones, in order, fill what the large ones left. Slots count through
parts of units, so no task numbers more than a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.common import cut, needed, uniform

SHARDS = 40
#: Ranges per shard, sampled rows per range, and the size, in mean ranges, from which a range is subdivided.
RANGES, DRAWS, OVERFULL = 64, 16, 2.0
#: A unit of more than a shard's size by this is dealt on its own; there are at most so many times the shards of them.
LARGE = 16
#: Rows find their range in a table of this many (a power of two) parts of the hash's values.
PARTS_BITS = 12
ROW_BYTES = 16


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What is needed of each row: 40 bytes, whatever its text's length."""
    given = needed(docs, id=id_col, text=text_col)
    return given.select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
                        F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), F.xxhash64("text").alias("k1"), F.xxhash64("id").alias("k2"))


def splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """``at (k1, k2)``: where each range but the first begins, always at the first row of a text. About ``ranges * DRAWS`` sampled keys are sorted in one task."""
    step = max(total / (ranges * DRAWS), 1.0)
    draws = F.col("size") / F.lit(step)
    drawn = rows.where(uniform("k1", "k2", 11) < draws).select("k1", "k2", F.greatest(draws, F.lit(1.0)).alias("w"))
    line = Window.orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("before", F.coalesce(F.sum("w").over(line), F.lit(0.0))).withColumn("all", F.sum("w").over(Window.partitionBy()))
    first = placed.groupBy(F.floor(F.col("before") * ranges / F.col("all")).alias("q")).agg(F.min(F.struct("k1", "k2")).alias("at"))
    return first.where("q > 0").select(F.struct(F.col("at.k1").alias("k1"), F.lit(-(1 << 63)).alias("k2")).alias("at")).distinct()


def _part(k1: Column) -> Column:
    return F.shiftright(k1, 64 - PARTS_BITS)


def in_ranges(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with ``range``: how many ranges begin at or before the row. The lookup table has 2^PARTS_BITS rows."""
    lists = starts.groupBy(_part(F.col("at.k1")).alias("part")).agg(F.sort_array(F.collect_list("at")).alias("starts"))
    parts = starts.sparkSession.range(-(1 << (PARTS_BITS - 1)), 1 << (PARTS_BITS - 1)).select(F.col("id").alias("part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    table = parts.join(lists, "part", "left").select("part", "starts", F.coalesce(F.sum(F.coalesce(F.size("starts"), F.lit(0))).over(earlier), F.lit(0)).alias("base"))
    here = F.size(F.filter(F.col("starts"), lambda at: at <= F.struct("k1", "k2")))
    found = rows.withColumn("part", _part(F.col("k1"))).join(F.broadcast(table), "part")
    return found.withColumn("range", F.col("base") + F.when(F.col("starts").isNull(), 0).otherwise(here)).drop("part", "starts", "base")


def _dealt(units: DataFrame, shards: int, total: int) -> DataFrame:
    """``unit, shard`` for units ``unit, bytes``; at most LARGE * shards of them, and the ranges' own number, are looked at in one task."""
    large = F.col("bytes") * (LARGE * shards) > total
    listed = units.where(large).agg(F.sort_array(F.collect_list(F.struct("bytes", "unit")), asc=False).alias("large"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("owners"))

    def to_emptiest(state, unit):
        at = F.array_position(state["loads"], F.array_min(state["loads"]))
        loads = F.transform(state["loads"], lambda x, i: F.when(i == at - 1, x + unit["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["owners"], F.array((at - 1).cast("int"))).alias("owners"))

    state = cut(listed.select("large", F.aggregate("large", start, to_emptiest).alias("s")))
    owned = state.select(F.explode(F.arrays_zip("large", "s.owners")).alias("z")).select("z.large.unit", F.col("z.owners").alias("shard"))
    # What is left below the mean size, as ends on one line that the small units fill.
    room = F.transform("s.loads", lambda x: F.greatest(F.lit(total / shards) - x, F.lit(0.0)))
    ends = F.aggregate(room, F.array(F.lit(0.0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    ends = state.select(ends.alias("ends"))
    line = Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    small = units.where(~large).withColumn("middle", F.coalesce(F.sum("bytes").over(line), F.lit(0)) + F.col("bytes") / 2)
    small = small.withColumn("middle", F.col("middle") / F.sum("bytes").over(Window.partitionBy())).withColumn("ends", ends.scalar())
    before = F.size(F.filter("ends", lambda e: e <= F.col("middle") * F.element_at("ends", -1)))
    return owned.union(small.select("unit", F.least(F.greatest(before - 1, F.lit(0)), F.lit(shards - 1)).alias("shard")))


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``, one row per row of ``docs``.

    size is the text's UTF-8 bytes and 16 for the row. Equal texts go to one shard, unless together they are larger than an equal share of
    all bytes: such a group is cut by its ids' hash, so that sizes stay near equal. Shards' sums of sizes differ by little more than a
    range, or by the last large group that fitted none. Slots count each shard's rows from 0. A null text has no bytes and the
    checksum of none; null texts are a group. Rows of one id and text share their place, so copies of a row stay together. An empty
    table gives an empty result. Columns other than the two named are not read."""
    rows = cut(measured(docs, id_col, text_col))
    total = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    ranges = shards * RANGES
    placed = cut(in_ranges(rows, splitters(rows, total, ranges)))
    share = total / shards
    # Groups above a share of all bytes can only be in ranges above it; there are fewer such groups than shards.
    full = placed.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share).select("range")
    giants = cut(placed.join(F.broadcast(full), "range").groupBy("k1").agg(F.sum("size").alias("group")).where(F.col("group") > share))
    marked = placed.join(F.broadcast(giants), "k1", "left")
    mean = max(total / ranges, 1.0)
    sizes = marked.where("group IS NULL").groupBy("range").agg(F.sum("size").alias("bytes"))
    subs = sizes.select("range", F.when(F.col("bytes") > OVERFULL * mean, F.ceil(F.col("bytes") / mean)).otherwise(1).alias("subs"))
    spread = marked.join(F.broadcast(subs), "range", "left")
    giant = F.struct(F.lit(-1).alias("range"), F.col("k1").alias("sub"), F.floor(uniform("k2", 12) * F.ceil(F.col("group") / mean)).alias("nth"))
    other = F.struct(F.col("range").cast("int").alias("range"), F.floor(uniform("k1", 12) * F.col("subs")).alias("sub"), F.lit(0).cast("long").alias("nth"))
    spread = spread.withColumn("unit", F.when(F.col("group").isNotNull(), giant).otherwise(other)).drop("range", "group", "subs")
    units = cut(spread.groupBy("unit").agg(F.sum("size").alias("bytes")))
    owned = _dealt(units, shards, total).join(units, "unit").withColumn("parts", F.when(F.col("bytes") > OVERFULL * mean, F.ceil(F.col("bytes") / mean)).otherwise(1))
    parted = spread.join(F.broadcast(owned.select("unit", "shard", "parts")), "unit").withColumn("part", F.floor(uniform("k2", 13) * F.col("parts")))
    counts = parted.groupBy("shard", "unit", "part").agg(F.count("*").alias("rows"))
    in_shard = Window.partitionBy("shard").orderBy("unit", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("unit", "part", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("unit", "part").orderBy("k1", "k2", "id", "size", "crc"))
    out = parted.withColumn("nth", nth).join(F.broadcast(firsts), ["unit", "part"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", block: int = 100_000) -> None:
    """Writes whole rows below ``path`` as Parquet, a folder ``out_shard=N`` each and a file for every ``block`` slots. Rows of one id go
    where its first one goes."""
    places = assign(docs, shards, id_col, text_col).groupBy(F.col(f"`{id_col}`").alias("out_id")).agg(F.min(F.struct("shard", "slot")).alias("out"))
    rows = docs.join(places, F.col(f"`{id_col}`").eqNullSafe(F.col("out_id")))
    rows = rows.withColumns({"out_shard": F.col("out.shard"), "out_slot": F.col("out.slot"), "out_block": F.floor(F.col("out.slot") / block)}).drop("out", "out_id")
    rows.repartition("out_shard", "out_block").sortWithinPartitions("out_shard", "out_slot").drop("out_slot", "out_block").write.partitionBy("out_shard").parquet(path)
