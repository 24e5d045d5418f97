"""Mixing sources to target weights by pivotal dependent rounding, with built-in functions only.

A source's target, in words, divided by its words is the number of copies each of its documents should get: a whole part and a
fraction. Fractions are rounded in pairs: words move at random from one document's fraction to the other's, keeping their sum and
each one's expectation, until one of the two is whole. The other meets the next document of its block; what is left of a block
meets the others of its source one level up. So a source's taken words miss its target by at most one document's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.common import WORD, cut, needed

#: Weights of the sources in code point order (repeating), the share of all words to take, and the most copies of a source's words.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents rounded together at each level of the tree.
BLOCK = 64
TINY = 1e-9
_UNIT = "struct<id:{id},size:bigint,p:double>"
_DONE = "array<struct<id:{id},size:bigint,up:bigint>>"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, n, source_size, target`` from rows ``source, size``.

    Every source wants its weight's share; one that would take more than MOST times its words stops there, and what it leaves goes to
    the others by weight. Sorted by how soon they stop, the sources that do are a prefix; the table has one row per source."""
    sums = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighted = sums.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    most = F.col("source_size") * float(MOST)
    everything = Window.partitionBy()
    before = Window.orderBy("stops", "place").rowsBetween(Window.unboundedPreceding, -1)
    line = weighted.withColumn("stops", most / F.col("weight"))
    wanted = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    line = line.withColumn("level", wanted / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    line = line.withColumn("full", F.col("stops") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return line.select("source", "n", "source_size", F.when(F.col("full"), most).otherwise(F.col("weight") * level).alias("target"))


def _fold(kind: str, last: bool, seed: int) -> str:
    """SQL for one block: units in order, each paired with the one still open; gives ``open`` and all that became whole.

    Of a pair (a, b), ``gain`` words can move from b to a and ``loss`` from a to b before one is whole; moving the first with
    probability loss / (gain + loss) keeps both expectations."""
    unit, done = _UNIT.format(id=kind), _DONE.format(id=kind)
    moved = (f"transform(array(named_struct('a', acc.open, 'b', x, 'gain', least((1 - acc.open.p) * acc.open.size, x.p * x.size),"
             f" 'loss', least(acc.open.p * acc.open.size, (1 - x.p) * x.size),"
             f" 'u', shiftrightunsigned(xxhash64(acc.open.id, acc.open.size, x.id, x.size, {seed}), 11) / {float(1 << 53)})),"
             " t -> transform(array(if(t.u * (t.gain + t.loss) < t.loss, t.gain, -t.loss)), m -> named_struct("
             "'a', named_struct('id', t.a.id, 'size', t.a.size, 'p', t.a.p + m / t.a.size), 'b', named_struct('id', t.b.id, 'size', t.b.size, 'p', t.b.p - m / t.b.size)))[0])")
    fixed = lambda v: f"({v}.p < {TINY} or {v}.p > 1 - {TINY})"
    as_done = lambda v: f"named_struct('id', {v}.id, 'size', {v}.size, 'up', cast(round({v}.p) as bigint))"
    step = (f"transform({moved}, t -> case when {fixed('t.a')} and {fixed('t.b')} then named_struct('open', cast(null as {unit}), 'done', concat(acc.done, array({as_done('t.a')}, {as_done('t.b')})))"
            f" when {fixed('t.a')} then named_struct('open', t.b, 'done', concat(acc.done, array({as_done('t.a')})))"
            f" else named_struct('open', t.a, 'done', concat(acc.done, array({as_done('t.b')}))) end)[0]")
    finish = "acc -> acc"
    if last:
        finish = f"acc -> named_struct('open', cast(null as {unit}), 'done', if(acc.open is null, acc.done, concat(acc.done, array({as_done('acc.open')}))))"
    return (f"aggregate(units, named_struct('open', cast(null as {unit}), 'done', cast(array() as {done})),"
            f" (acc, x) -> if(acc.open is null, named_struct('open', x, 'done', acc.done), {step}), {finish})")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, size, source_size, target, copies, taken``, one row per row of ``docs``.

    size counts words (null: 0), copies is how often the mix repeats the document (0 to MOST), taken is copies times size. All random
    numbers come from ids and sizes, so reruns agree. The last fraction of a source, left when all others are whole, goes to the
    nearer whole number. Null is a source of its own, the last; sources without words have target 0; documents without words get the
    whole part of their source's copies. Repeated rows are rounded separately. An empty table gives an empty result. Columns other
    than the three named are not read."""
    given = needed(docs, id=id_col, text=text_col, source=source_col)
    kind = dict(given.dtypes)["id"]
    sizes = cut(given.select("id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    targets = cut(source_targets(sizes))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select("source", "n", "source_size", "target", F.floor(factor + TINY).alias("whole"), (factor - F.floor(factor + TINY)).alias("p"))
    rows = sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("id", "size", F.col("t.source").alias("source"), "n", "source_size", "target", "whole", "p")
    of_source = ["source", "n", "source_size", "target", "whole"]
    rounds = (F.col("size") > 0) & (F.col("p") > TINY)
    out = rows.where(~rounds).select("id", "size", *of_source[2:], F.lit(0).cast("long").alias("up"))
    open_ = rows.where(rounds).select(*of_source, F.struct("id", "size", "p").alias("unit"))
    left, level = targets.agg(F.max("n")).first()[0] or 0, 0
    while left:
        left, last = -(-left // BLOCK), left <= BLOCK
        blocks = F.greatest(F.ceil(F.col("n") / float(BLOCK) ** (level + 1)), F.lit(1))
        key = F.xxhash64("unit.id", "unit.size", F.lit(level))
        placed = open_.withColumn("key", key).withColumn("block", F.pmod("key", blocks))
        units = F.transform(F.sort_array(F.collect_list(F.struct("key", "unit"))), lambda x: x["unit"])
        folded = cut(placed.groupBy(*of_source, "block").agg(units.alias("units")).select(*of_source, F.expr(_fold(kind, last, level)).alias("f")))
        done = folded.select(*of_source[2:], F.explode("f.done").alias("d")).select("d.id", "d.size", *of_source[2:], "d.up")
        out = out.unionByName(done)
        if last:
            break
        open_ = folded.where("f.open IS NOT NULL").select(*of_source, F.col("f.open").alias("unit"))
        level += 1
    copies = F.col("whole") + F.col("up")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as many times as ``mix`` says. Rows that share an id get that id's
    copies one each, in the order of their sizes, so none is taken for another."""
    copies = mix(docs, id_col, text_col, source_col).groupBy(F.col(f"`{id_col}`").alias("_mixed_id"))
    copies = cut(copies.agg(F.sort_array(F.collect_list(F.struct("size", "copies"))).alias("_copies")).where(F.exists("_copies", lambda c: c["copies"] > 0)))
    times = docs.join(copies, F.col(f"`{id_col}`").eqNullSafe(F.col("_mixed_id")))
    nth = F.lit(1)
    if not copies.where(F.size("_copies") > 1).isEmpty():
        times = times.withColumn("_size", F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)))
        nth = F.row_number().over(Window.partitionBy("_mixed_id").orderBy("_size"))
    times = times.withColumn("_times", F.element_at("_copies", nth)["copies"]).where("_times > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return times.select(*[F.col(f"`{c}`") for c in docs.columns])
