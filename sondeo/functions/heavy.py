"""Equality joins in which few keys hold much of one side's rows, and containment as an equality.

A sketch of the key column is merged over all tasks first: it names the keys that have more rows than a task's fair share, with counts.
Only these get salts, as many as fair shares they fill; rows of all other keys are joined as they are."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

#: Keys that a sketch reports at most, and items it tracks. A key is found if its share of the rows is well above 1 / TRACKED.
REPORTED, TRACKED = 1000, 65536
#: Patterns of an automaton, about.
GROUP_PATTERNS = 200_000


def heavy_keys(rows: DataFrame, on: list[str], tasks: int | None = None) -> list[tuple[int, int]]:
    """``(hash of the key, salts)`` of keys with more rows than one of ``tasks`` equal shares; the session's shuffle partitions if not
    given. At most REPORTED pairs reach the driver."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(F.xxhash64(*on).alias("_key")).agg(F.expr(f"approx_top_k(_key, {REPORTED}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    fair = max(1, -(-found["n"] // tasks))
    return [(r["item"], -(-r["count"] // fair)) for r in found["top"] or [] if r["count"] > fair]


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", tasks: int | None = None, sketched: DataFrame | None = None
) -> DataFrame:
    """``left`` joined with ``right`` on equal columns ``on`` (inner or left). Rows of a heavy key of ``left`` are dealt to its salts by their
    ``spread`` columns, and rows of ``right`` with that key are repeated for each salt. Reads ``left``'s keys once more than a join does,
    or those of ``sketched`` instead, if its heavy keys are the ones to expect."""
    dealt, repeated = salted(left, right, on, spread, tasks, sketched)
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt") if "_salt" in dealt.columns else dealt.join(repeated, on, how)


def salted(
    left: DataFrame, right: DataFrame, on: list[str], spread: list[str], tasks: int | None = None, sketched: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of such a join with a column ``_salt`` to join on as well; without it if no key is heavy."""
    heavy = heavy_keys(left if sketched is None else sketched, on, tasks)
    if not heavy:
        return left, right
    table = F.broadcast(left.sparkSession.createDataFrame(heavy, "_key long, _salts long"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.withColumn("_key", F.xxhash64(*on)).join(table, "_key", "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts))
    repeated = right.withColumn("_key", F.xxhash64(*on)).join(table, "_key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("_key", "_salts"), repeated.drop("_key", "_salts")


# -- containment -----------------------------------------------------------------------------------------------------------

def with_anchor(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """``rows`` with ``_anchor``: of the parts of a row's text, cut at delimiters, the one found in the fewest rows that is neither first nor
    last; '' if there is none. Whatever contains the text has this part as a whole part of its own, so an equality on it proposes all
    containers. ``key`` tells rows apart."""
    inner = rows.select(key, F.explode(F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))).alias("_part"))
    counts = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    order = F.struct(F.col("_n"), -F.length("_part"), F.col("_part"))
    rarest = spread_join(inner, counts, ["_part"], [key]).groupBy(key).agg(F.min_by("_part", order).alias("_anchor"))
    return rows.join(rarest, key, "left").withColumn("_anchor", F.coalesce("_anchor", F.lit("")))


def every_anchor(parts: Column) -> Column:
    """A row for each distinct part of a container, and one for texts without an anchor."""
    return F.explode(F.array_distinct(F.concat(F.coalesce(parts, F.array().cast("array<string>")), F.array(F.lit("")))))


def containing(texts: DataFrame, patterns: DataFrame, on: list[str], text: str, pattern: str, spread: list[str], tasks: int | None = None) -> DataFrame:
    """Rows of ``texts`` beside those of ``patterns`` with equal columns ``on`` whose pattern stands in the text; other columns must differ in name.

    Keys are dealt into groups of bounded numbers of patterns. The patterns of a group become one automaton, by which each of its texts goes
    once, whatever their number; of what it finds, rows of the text's own key count. Keys with many texts are spread. Null texts and
    patterns match nothing; the empty pattern stands in every text."""
    left, right = salted(texts.filter(F.col(text).isNotNull()), patterns.filter(F.col(pattern).isNotNull()), on, spread, tasks)
    keys = [*on, "_salt"] if "_salt" in left.columns else on
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(tasks or least, -(-patterns.count() // GROUP_PATTERNS))
    left, right = (side.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups))) for side in (left, right))
    own = {*texts.columns}
    schema = StructType([*texts.schema.fields, *[f for f in patterns.schema.fields if f.name not in on]])

    def keyed(table: pa.Table) -> list[tuple]:
        return list(zip(*(table.column(c).to_pylist() for c in keys)))

    def match(some: pa.Table, against: pa.Table) -> pa.Table:
        rows: dict[str, dict[tuple, list[int]]] = {}
        for i, (p, key) in enumerate(zip(against.column(pattern).to_pylist(), keyed(against))):
            rows.setdefault(p, {}).setdefault(key, []).append(i)
        everywhere = rows.pop("", {})
        automaton = ahocorasick.Automaton()
        for p, by_key in rows.items():
            automaton.add_word(p, by_key)
        automaton.make_automaton()
        at, found = [], []
        for i, (value, key) in enumerate(zip(some.column(text).to_pylist(), keyed(some))):
            # A pattern has one table of rows, so its identity names the pattern.
            hits = {id(by_key): by_key for _, by_key in automaton.iter(value)} if rows else {}
            for where in [by_key.get(key, ()) for by_key in (*hits.values(), everywhere)]:
                found += where
                at += [i] * len(where)
        a, b = some.take(pa.array(at, pa.int64())), against.take(pa.array(found, pa.int64()))
        return pa.table({f.name: (a if f.name in own else b).column(f.name) for f in schema.fields})

    return left.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(match, schema)
