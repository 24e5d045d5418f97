"""Judging and segment rules on small hand-made tables."""

from pyspark.sql import functions as F

from sondeo.operators import judging as jd
from sondeo.operators import segments as sg

RUN = "need_id string, arm string, label string, depth int, rank int, collection string, document string, chunk_index int, score double"


def run(arm, label, chunks, depth=12, need="N1"):
    return [(need, arm, label, depth, i, "c", "d.md", n, 1.0) for i, n in enumerate(chunks, 1)]


def judged(spark, rows):
    return spark.createDataFrame([("N1", f"c|d.md|{n}", g, a) for n, g, a in rows], "need_id string, key string, grade int, aspects array<string>")


def test_list_metrics_count_distinct_relevant_and_aspects(spark):
    hits = spark.createDataFrame(run("A", "A", [1, 1, 2, 3]), RUN)
    j = judged(spark, [(1, 2, ["a1"]), (2, 1, ["a2"]), (3, 0, []), (4, 1, ["a3"])])
    m = jd.list_metrics(jd.named_lists(hits), j).filter("list = 'A@4'").first()
    assert (m.printed, m.hit, m.rel, m.p, m.reldocs) == (4, 1, 2, 0.75, 1) and abs(m.asp - 2 / 3) < 1e-9
    bare = jd.list_metrics(jd.named_lists(spark.createDataFrame(run("A", "A", [9]), RUN)), j).first()
    assert (bare.hit, bare.rel, bare.asp) == (0, 0, 0.0)


def test_sibling_lists_and_agreement(spark):
    rows = run("A", "A", range(12)) + run("G", "G", [1, 2, 3, 50]) + run("S", "s2", [1, 4, 5], 3) + run("S", "s3", [6, 7, 8], 3) + run("S", "s4", [9, 10, 11], 3)
    hits = spark.createDataFrame(rows, RUN)
    s3 = jd.named_lists(hits).filter("list = 'S@3'").orderBy("position").collect()
    assert len(s3) == 12 and [r.key for r in s3[:3]] == ["c|d.md|1", "c|d.md|2", "c|d.md|3"]
    a = jd.sibling_agreement(hits, judged(spark, [(1, 2, ["a1"])])).first()
    assert (a.n_single, a.n_multiple, a.p_multiple, a.supported) == (10, 1, 1.0, False)


def metrics(spark, per_list):
    rows = [(f"N{i}", name, int(h), 1, 0.5, a, 1) for name, values in per_list.items() for i, (h, a) in enumerate(values)]
    return spark.createDataFrame(rows, "need_id string, list string, hit int, rel int, p double, asp double, reldocs int")


def test_comparison_ties_and_verdicts(spark):
    m = metrics(spark, {"x": [(1, 1.0), (1, 0.5), (1, None), (1, 0.2)], "y": [(1, 0.5), (1, 0.5), (1, 1.0), (1, 0.9)]})
    r = jd.compare_lists(m, [("c", "x", "y", "asp")]).first()
    assert (r.wins, r.losses, r.ties, r.verdict) == (1, 1, 2, "inconclusive")
    pairs = spark.createDataFrame([(4, 2), (3, 2), (1, 4), (0, 0)], "w int, l int")
    assert [x.v for x in pairs.select(jd.verdict(F.col("w"), F.col("l")).alias("v")).collect()] == ["supported", "inconclusive", "not supported", "inconclusive"]


def hit_counts(spark, a, g):
    n = 10
    lists = {f"{arm}@{b}": [(i < c[b], 0.5) for i in range(n)] for arm, c in (("A", a), ("G", g)) for b in jd.BUDGETS}
    return metrics(spark, lists)


def test_default_count(spark):
    a, g = {3: 8, 4: 9, 5: 9, 6: 10, 8: 10, 12: 10}, {3: 9, 4: 9, 5: 10, 6: 10, 8: 10, 12: 10}
    r = jd.default_count(hit_counts(spark, a, g)).first()
    assert (r.k_star, r.confirmed) == (4, True)
    late = {3: 2, 4: 3, 5: 4, 6: 9, 8: 10, 12: 10}
    assert jd.default_count(hit_counts(spark, late, late)).first().k_star is None


def test_strategy_needs_gain_and_wins(spark):
    better, base = [(1, 0.8), (1, 0.6), (0, 0.5)], [(1, 0.5), (1, 0.6), (0, 0.2)]
    needs = spark.createDataFrame([(f"N{i}", "recall") for i in range(3)], "need_id string, intent string")
    pick = lambda first, second: {r.comparison: r.adopt for r in jd.strategy_decisions(metrics(spark, {"S@3": first, "A@12": second, "G@12": second}), needs).collect()}
    assert pick(better, base)["all"] is True and pick(base, better)["all"] is False


def test_kappa(spark):
    rows = [("same", a, a) for a in (1, 0, 1, 0)] + [("chance", a, b) for a, b in zip((1, 1, 0, 0), (1, 0, 1, 0))] + [("one", 1, 1)]
    got = {r.g: r.kappa for r in jd.kappa(spark.createDataFrame(rows, "g string, first int, second int"), ["g"]).collect()}
    assert got["same"] == 1.0 and abs(got["chance"]) < 1e-9 and got["one"] == 1.0


def test_pool_numbers_go_on_and_first_build_is_cut(spark):
    hits = spark.createDataFrame(run("A", "A", range(60), 60) + run("A", "A", [1, 2, 3], 3, "N2"), RUN)
    pool = spark.createDataFrame([("N2", "c|d.md|1", "N2-c07")], "need_id string, key string, id string")
    rows = jd.extend_pool(pool, hits, "s").collect()
    n1 = [r for r in rows if r.need_id == "N1"]
    assert sorted(r.id for r in n1 if not r.trimmed) == [f"N1-c{i:02d}" for i in range(1, 45)]
    assert {r.key for r in n1 if r.trimmed} == {f"c|d.md|{i}" for i in range(44, 60)}
    assert sorted((r.id, r.trimmed) for r in rows if r.need_id == "N2") == [("N2-c08", False), ("N2-c09", False)]
    assert jd.judging_sheets(spark.createDataFrame(n1)).agg(F.max("sheet")).first()[0] == 4


def test_rejudge_sample_has_the_exact_size(spark):
    pool = spark.range(137).select(F.lit("N1").alias("need_id"), F.concat(F.lit("c"), "id").alias("id"))
    one, two = (jd.rejudge_sample(p, "7").collect() for p in (pool, pool.repartition(3)))
    assert len(one) == round(137 * 0.08) and {r.id for r in one} == {r.id for r in two}


def test_score_bands_and_profile_show_empty_rows(spark):
    obs = spark.createDataFrame([(1, 0.95, 1), (1, 1.0, 0), (3, 0.05, 0)], "rank int, score double, rel int")
    bands = {r.low: (r.n, r.precision) for r in jd.score_bands(obs).collect()}
    assert bands == {0.9: (2, 0.5), 0.5: (0, 0.0), 0.1: (0, 0.0), 0.0: (1, 0.0)}
    assert {r["rank"]: r.n for r in jd.rank_profile(obs).collect()} == {i: {1: 2, 3: 1}.get(i, 0) for i in range(1, 13)}


def test_search_specs(spark):
    schema = ("need_id string, collection string, document string, exclude string, logged_query string, g string, m string, siblings array<string>, "
              "forms map<string,string>, per_source array<struct<label: string, document: string>>")
    needs = spark.createDataFrame([("N1", "c", "d%", None, "l", "g", "", ["x", "y"], {"kw": "k"}, [("p1", "s1")]), ("N2", "c", None, "e", "l", "g", "m", ["x"], None, None)], schema)
    got = sorted((r.need_id, r.arm, r.label, r.query, r.document, r.depth) for r in jd.build_specs(needs).collect() if r.need_id == "N1")
    assert got == [("N1", "A", "A", "l", "d%", 12), ("N1", "F", "kw", "k", "d%", 3), ("N1", "G", "G", "g", "d%", 12), ("N1", "P", "p1", "g", "s1", 3),
                   ("N1", "S", "s2", "x", "d%", 3), ("N1", "S", "s3", "y", "d%", 3)]
    assert {r.arm for r in jd.build_specs(needs).filter("need_id = 'N2'").collect()} == {"A", "G", "S", "M"}


def test_coverage_checks(spark):
    span = "document string, kind string, label string, pos int, line_start int, line_end int"
    spans = spark.createDataFrame([("ok", "block", "b1", 0, 1, 4), ("ok", "trash", "t", 0, 5, 9), ("gap", "block", "b1", 0, 2, 4), ("gap", "block", "b2", 1, 6, 8),
                                   ("lap", "block", "b1", 0, 1, 5), ("lap", "block", "b2", 1, 5, 7), ("out", "block", "b1", 0, 1, 99), ("out", "block", "b2", 1, 5, 4)], span)
    totals = spark.createDataFrame([("ok", 9), ("gap", 9), ("lap", 7), ("out", 9)], "document string, total_lines int")
    got = sorted((r.document, r.label, r.problem) for r in sg.coverage_errors(spans, totals).collect())
    assert got == [("gap", "b1", "gap before span"), ("gap", "b2", "gap before span"), ("gap", "end", "coverage ends at another line"), ("lap", "b2", "overlaps preceding span"),
                   ("out", "b1", "out of document bounds"), ("out", "b2", "starts after its end")]


def test_long_spans_overlap_once(spark):
    left = spark.createDataFrame([("d", "t", 1, 2000)], "document string, theme_id string, line_start int, line_end int")
    right = spark.createDataFrame([("d", 0, 700, 1500), ("d", 1, 2000, 2000), ("d", 2, 2001, 2300)], "document string, pos int, line_start int, line_end int")
    assert sorted(r.pos for r in sg.overlapping_spans(left, right, ["theme_id"], ["pos"]).collect()) == [0, 1]
