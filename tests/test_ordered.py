"""Block-wise building blocks against brute force, with blocks so small that borders matter."""

import random

from pyspark.sql import functions as F

from sondeo.functions import ordered


def _rows(seed, n=200, keys=("a", "b", None), span=60):
    r = random.Random(seed)
    return [(i, r.choice(keys), r.randrange(span), r.randrange(10)) for i in range(n)]


def test_next_row_crosses_blocks(spark):
    rows = [(i, k, p, v) for i, (k, p, v) in enumerate({(k, p, v) for _, k, p, v in _rows(1, keys=("a", "b"))})]
    df = spark.createDataFrame(rows, "id int, k string, pos int, v int")
    got = ordered.next_row(df, ["k"], ["pos", "v"], F.floor(F.col("pos") / 5), F.struct("pos", "v"), "nxt").collect()
    for row in got:
        later = sorted((p, v) for _, k, p, v in rows if k == row.k and (p, v) > (row.pos, row.v))
        assert (tuple(row.nxt) if row.nxt else None) == (later[0] if later else None)


def test_next_later_is_strict(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "id int, k string, pos long, v int")
    for row in ordered.next_later(df, ["k"], "pos", 7, "nxt").collect():
        later = [p for _, k, p, _ in rows if k == row.k and p > row.pos]
        assert row.nxt == (min(later) if later else None)


def test_largest_before_with_null_keys_and_both_bounds(spark):
    points, marks = _rows(3), _rows(4, 80)
    p = spark.createDataFrame(points, "id int, k string, at long, v int")
    m = spark.createDataFrame(marks, "mid int, k string, start long, reach int")
    for strict in (False, True):
        got = ordered.largest_before(p, m, ["k"], "at", "start", F.col("reach"), 6, "best", strict).collect()
        assert len(got) == len(points)
        for row in got:
            ok = [r for _, k, s, r in marks if k == row.k and (s < row["at"] if strict else s <= row["at"])]
            assert row.best == (max(ok) if ok else None)


def test_largest_before_takes_the_latest_struct(spark):
    points, marks = _rows(5), _rows(6, 80)
    p = spark.createDataFrame(points, "id int, k string, at long, v int")
    m = spark.createDataFrame(marks, "mid int, k string, start long, reach int")
    for row in ordered.largest_before(p, m, ["k"], "at", "start", F.struct("start", "mid"), 6, "best").collect():
        ok = [(s, i) for i, k, s, _ in marks if k == row.k and s <= row["at"]]
        assert (tuple(row.best) if row.best else None) == (max(ok) if ok else None)


def test_index_percentiles_whole_and_broken_numbers(spark):
    r = random.Random(7)
    rows = [(r.choice("xy"), r.randrange(50), r.random() * 20) for _ in range(301)]
    df = spark.createDataFrame(rows, "g string, whole int, broken double")
    qs = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for column, coarse in (("whole", None), ("broken", F.floor("broken"))):
        for row in ordered.index_percentiles(df, ["g"], column, qs, coarse).collect():
            values = sorted(x[1] if column == "whole" else x[2] for x in rows if x[0] == row.g)
            assert row.n == len(values) and row.max_value == values[-1]
            for name, q in qs.items():
                assert row[name] == values[min(len(values) - 1, int(len(values) * q))]


def test_index_percentile_differs_from_the_nearest_rank(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v int")
    assert ordered.index_percentiles(df, ["g"], "v", {"p": 0.5}).first().p == 3


def test_smallest_n_is_exact(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(-2**63, 2**63)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, code long")
    for n in (0, 1, 137, 500):
        got = {x.id for x in ordered.smallest_n(df, "code", F.lit(n), slots=16).collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda x: x[1])[:n]}


def test_top_k_plan_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = ordered.top_k(df, ["k"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
