"""Queries on pooled judging: lineitem plays the result lists, supplier the needs, labels the judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.catalog.base import ctes, query, table
from sondeo.operators import judging as jd
from sondeo.sources import evalsets

RUNS = [("A", "A", 12), ("G", "G", 12), ("S", "s2", 3), ("S", "s3", 3), ("S", "s4", 3), ("M", "M", 12), ("F", "kw", 3), ("F", "nl", 3), ("F", "bool", 3),
        ("P", "p1", 3), ("P", "p2", 3), ("R", "R", 5)]
RUN_VALUES = ", ".join(f"({i}, '{a}', '{l}', {d})" for i, (a, l, d) in enumerate(RUNS))
HITS = f"""run_names(run, arm, label, depth) AS (VALUES {RUN_VALUES}),
lines AS (SELECT l_suppkey, l_orderkey % 12 AS run, l_partkey % 200 AS doc, l_linenumber AS chunk_index, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
hits AS (SELECT 'N' || lpad(l_suppkey::VARCHAR, 4, '0') AS need_id, arm, label, depth, rank::INT AS rank, 'c' AS collection, 'd' || doc::VARCHAR AS document, chunk_index::INT AS chunk_index,
  round(price / 110000, 6) AS score, 'c|d' || doc::VARCHAR || '|' || chunk_index::VARCHAR AS key, doc FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, run ORDER BY price DESC, doc, chunk_index) AS rank FROM lines) JOIN run_names USING (run) WHERE rank <= 30)"""
JUDGED = """grades AS (SELECT doc_id AS doc, quality + 1 - toxic AS grade FROM labels),
judged AS (SELECT need_id, key, coalesce(grade, 0) AS grade, CASE WHEN grade >= 1 THEN list_distinct(['a' || (doc % 4)::VARCHAR, 'a' || (chunk_index % 3)::VARCHAR]) ELSE [] END AS aspects
  FROM (SELECT DISTINCT need_id, key, doc, chunk_index FROM hits WHERE rank <= depth) LEFT JOIN grades USING (doc)),
universe AS (SELECT need_id, count(DISTINCT a) AS universe FROM (SELECT need_id, unnest(aspects) AS a FROM judged WHERE grade >= 1) GROUP BY 1)"""
LISTS = """sib AS (SELECT *, CASE WHEN arm = 'G' THEN 's1' WHEN arm = 'S' THEN label END AS sl FROM hits),
lists AS (SELECT need_id, arm || '@' || b::VARCHAR AS list, rank, label AS part, key, document FROM hits, (VALUES (3), (4), (5), (6), (8), (12)) v(b) WHERE arm IN ('A', 'G', 'M') AND rank <= b
 UNION ALL SELECT need_id, 'S@' || d::VARCHAR, rank, sl, key, document FROM sib, (VALUES (1), (2), (3)) v(d) WHERE sl IS NOT NULL AND rank <= d
 UNION ALL SELECT need_id, 'F:' || label || '@3', rank, label, key, document FROM hits WHERE arm = 'F' AND rank <= 3
 UNION ALL SELECT need_id, 'P@3', rank, label, key, document FROM hits WHERE arm = 'P' AND rank <= 3
 UNION ALL SELECT need_id, 'R@' || d::VARCHAR, rank, label, key, document FROM hits, (VALUES (3), (5)) v(d) WHERE arm = 'R' AND rank <= d)"""
METRICS = """lj AS (SELECT l.*, coalesce(j.grade, 0) AS grade, j.aspects FROM lists l LEFT JOIN judged j USING (need_id, key)),
cov AS (SELECT need_id, list, count(DISTINCT a) AS covered FROM (SELECT need_id, list, unnest(aspects) AS a FROM lj WHERE grade >= 1) GROUP BY ALL),
metrics AS (SELECT l.need_id, l.list, count(*) AS printed, max((grade = 2)::INT) AS hit, count(DISTINCT key) FILTER (grade >= 1) AS rel, count(*) FILTER (grade >= 1) / count(*) AS p,
  coalesce(any_value(covered), 0) / any_value(universe) AS asp, count(DISTINCT document) FILTER (grade >= 1) AS reldocs FROM lj l LEFT JOIN cov USING (need_id, list) LEFT JOIN universe u ON u.need_id = l.need_id GROUP BY ALL)"""
NEEDS = "needs AS (SELECT 'N' || lpad(s_suppkey::VARCHAR, 4, '0') AS need_id, CASE WHEN s_suppkey % 2 = 0 THEN 'recall' ELSE 'precision' END AS intent FROM supplier)"
ALL = (HITS, JUDGED, LISTS, METRICS)


def need_id(col):
    return F.concat(F.lit("N"), F.lpad(col.cast("string"), 4, "0"))


def hits(spark, sf):
    names = spark.createDataFrame([(i, *r) for i, r in enumerate(RUNS)], "run long, arm string, label string, depth int")
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 12).alias("run"), (F.col("l_partkey") % 200).alias("doc"), F.col("l_linenumber").alias("chunk_index")).agg(
        F.max("l_extendedprice").alias("price"))
    from sondeo.functions import ordered
    best = ordered.top_k(lines, ["l_suppkey", "run"], [F.desc("price"), F.asc("doc"), F.asc("chunk_index")], 30)
    return best.join(names, "run").select(
        need_id(F.col("l_suppkey")).alias("need_id"), "arm", "label", "depth", "rank", F.lit("c").alias("collection"), F.concat(F.lit("d"), F.col("doc").cast("string")).alias("document"),
        F.col("chunk_index").cast("int").alias("chunk_index"), F.round(F.col("price") / 110000, 6).alias("score"), "doc")


def judged(spark, sf, h):
    grades = table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    pool = jd.with_key(h.filter("rank <= depth")).select("need_id", "key", "doc", "chunk_index").distinct().withColumn("id", F.concat_ws("~", "need_id", "key"))
    tag = lambda c, m: F.concat(F.lit("a"), (F.col(c) % m).cast("string"))
    judgments = pool.join(grades, "doc").select("id", "grade", F.when(F.col("grade") >= 1, F.array_distinct(F.array(tag("doc", 4), tag("chunk_index", 3)))).otherwise(F.array().cast("array<string>")).alias("aspects"))
    return jd.judged_pool(pool.select("need_id", "key", "id"), judgments)


def needs(spark, sf):
    return table(spark, sf, "supplier").select(need_id(F.col("s_suppkey")).alias("need_id"), F.when(F.col("s_suppkey") % 2 == 0, "recall").otherwise("precision").alias("intent"))


def metrics(spark, sf):
    h = hits(spark, sf)
    return jd.list_metrics(jd.named_lists(h), judged(spark, sf, h))


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("j07_judged_pool", ctes(HITS, JUDGED) + "SELECT need_id, key, grade, array_to_string(list_sort(aspects), ',') AS aspects FROM judged")
def j07(spark, sf):
    j = judged(spark, sf, hits(spark, sf))
    return j.select("need_id", "key", "grade", F.array_join(F.array_sort("aspects"), ",").alias("aspects"))


@query("a12_list_metrics", ctes(*ALL) + "SELECT need_id, list, printed, hit, rel, round(p, 6) AS p, round(asp, 6) AS asp, reldocs FROM metrics")
def a12(spark, sf):
    m = metrics(spark, sf)
    return rounded(m.withColumn("rel", F.col("rel").cast("long")).withColumn("reldocs", F.col("reldocs").cast("long")), "p", "asp")


@query("a13_named_lists", ctes(HITS, LISTS) + "SELECT need_id, list, part, rank, key FROM lists")
def a13(spark, sf):
    return jd.named_lists(hits(spark, sf)).select("need_id", "list", "position.part", "position.rank", "key")


OUTCOME = """count(*) FILTER (abs(a - b) > 1e-9 AND a > b) AS wins, count(*) FILTER (abs(a - b) > 1e-9 AND a < b) AS losses, count(*) FILTER (NOT coalesce(abs(a - b) > 1e-9, false)) AS ties"""
VERDICT = "CASE WHEN wins > losses AND 3 * wins >= 2 * (wins + losses) THEN 'supported' WHEN losses > wins AND 3 * losses >= 2 * (wins + losses) THEN 'not supported' ELSE 'inconclusive' END AS verdict"
CLAIMS = [("form kw", "G@3", "F:kw@3", "p"), ("form nl", "G@3", "F:nl@3", "p"), ("form bool", "G@3", "F:bool@3", "p"), ("multi concept", "S@3", "M@12", "asp"),
          ("anchor precision", "R@3", "A@3", "p"), ("anchor recall", "A@5", "R@5", "asp"), ("anchor documents", "A@5", "R@5", "reldocs"),
          ("small 3 hit", "G@3", "A@3", "hit"), ("small 3 precision", "G@3", "A@3", "p"), ("small 4 hit", "G@4", "A@4", "hit"), ("small 4 precision", "G@4", "A@4", "p"),
          ("per source documents", "P@3", "A@12", "reldocs")]


def claims_sql(claims) -> str:
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in c) + ")" for c in claims)
    return f"""claims(claim, first, second, measure) AS (VALUES {values}),
long AS (UNPIVOT (SELECT need_id, list, hit::DOUBLE AS hit, rel::DOUBLE AS rel, p::DOUBLE AS p, asp::DOUBLE AS asp, reldocs::DOUBLE AS reldocs FROM metrics) ON hit, rel, p, asp, reldocs INTO NAME measure VALUE v),
full_long AS (SELECT m.need_id, m.list, n.measure, l.v FROM metrics m CROSS JOIN (VALUES ('hit'), ('rel'), ('p'), ('asp'), ('reldocs')) n(measure) LEFT JOIN long l ON l.need_id = m.need_id AND l.list = m.list AND l.measure = n.measure),
outcomes AS (SELECT claim, {OUTCOME}, coalesce(avg(a), 0) AS mean_first, coalesce(avg(b), 0) AS mean_second FROM (
  SELECT c.claim, x.v AS a, y.v AS b FROM claims c JOIN full_long x ON x.list = c.first AND x.measure = c.measure JOIN full_long y ON y.need_id = x.need_id AND y.list = c.second AND y.measure = c.measure) GROUP BY 1)"""


SELECT_CLAIMS = f"SELECT claim, wins, losses, ties, round(mean_first, 6) AS mean_first, round(mean_second, 6) AS mean_second, {VERDICT} FROM outcomes"


@query("a14_paired_comparison", ctes(*ALL, claims_sql([("guided or logged", "G@12", "A@12", "asp")])) + SELECT_CLAIMS)
def a14(spark, sf):
    return rounded(jd.compare_lists(metrics(spark, sf), [("guided or logged", "G@12", "A@12", "asp")]), "mean_first", "mean_second")


@query("a18_claims", ctes(*ALL, claims_sql(CLAIMS)) + SELECT_CLAIMS)
def a18(spark, sf):
    return rounded(jd.compare_lists(metrics(spark, sf), CLAIMS), "mean_first", "mean_second")


HIT_SUMS = ", ".join(f"coalesce(sum(hit) FILTER (list = '{a}@{b}'), 0)::BIGINT AS hit_{a.lower()}_{b}" for a in ("A", "G") for b in jd.BUDGETS)


@query("a15_default_count", ctes(*ALL, f"h AS (SELECT {HIT_SUMS} FROM metrics)") + """
SELECT *, CASE WHEN hit_a_3 >= hit_a_12 - 1 THEN 3 WHEN hit_a_4 >= hit_a_12 - 1 THEN 4 WHEN hit_a_5 >= hit_a_12 - 1 THEN 5 END AS k_star,
 CASE WHEN hit_a_3 >= hit_a_12 - 1 THEN hit_g_3 >= hit_a_3 WHEN hit_a_4 >= hit_a_12 - 1 THEN hit_g_4 >= hit_a_4 WHEN hit_a_5 >= hit_a_12 - 1 THEN hit_g_5 >= hit_a_5 ELSE false END AS confirmed FROM h""")
def a15(spark, sf):
    return jd.default_count(metrics(spark, sf))


@query("a16_strategy", ctes(*ALL, NEEDS) + f""",
subsets(comparison, first, second, intent) AS (VALUES ('all', 'S@3', 'A@12', NULL), ('recall_only', 'S@3', 'A@12', 'recall'), ('precision_only', 'S@3', 'A@12', 'precision'), ('multiplicity_control', 'S@3', 'G@12', NULL), ('shape_control', 'G@12', 'A@12', NULL)),
o AS (SELECT comparison, sum(hs)::BIGINT AS hit_s, sum(ha)::BIGINT AS hit_a, coalesce(avg(a), 0) AS asp_mean_s, coalesce(avg(b), 0) AS asp_mean_a, {OUTCOME} FROM (
 SELECT s.comparison, x.hit AS hs, y.hit AS ha, x.asp AS a, y.asp AS b FROM subsets s JOIN metrics x ON x.list = s.first JOIN metrics y ON y.list = s.second AND y.need_id = x.need_id JOIN needs n ON n.need_id = x.need_id WHERE s.intent IS NULL OR s.intent = n.intent) GROUP BY 1)
SELECT comparison, hit_s, hit_a, round(asp_mean_s, 6) AS asp_mean_s, round(asp_mean_a, 6) AS asp_mean_a, wins, losses, ties, hit_s >= hit_a - 1 AND round(asp_mean_s, 12) > round(asp_mean_a, 12) AND wins > losses AS adopt FROM o""")
def a16(spark, sf):
    return rounded(jd.strategy_decisions(metrics(spark, sf), needs(spark, sf)), "asp_mean_s", "asp_mean_a")


CURVE = [f"{a}@{b}" for a in ("A", "G") for b in jd.BUDGETS]
EQUAL = ["A@4", "G@4", "M@4", "S@1"]


def totals_sql(names):
    return f"""SELECT list, count(*) AS needs, sum(hit)::BIGINT AS hit, sum(rel)::BIGINT AS rel, round(coalesce(avg(asp), 0), 6) AS asp, sum(reldocs)::BIGINT AS reldocs, round(avg(p), 6) AS p FROM metrics WHERE list IN ({', '.join(f"'{n}'" for n in names)}) GROUP BY 1"""


@query("a17_budget_curve", ctes(*ALL) + totals_sql(CURVE))
def a17(spark, sf):
    return rounded(jd.list_totals(metrics(spark, sf), CURVE), "asp", "p")


@query("a17_equal_print", ctes(*ALL) + totals_sql(EQUAL))
def a17b(spark, sf):
    return rounded(jd.list_totals(metrics(spark, sf), EQUAL), "asp", "p")


@query("a19_sibling_agreement", ctes(HITS, JUDGED) + """,
c AS (SELECT need_id, key, count(*) AS n FROM (SELECT DISTINCT need_id, label, key FROM hits WHERE rank <= 3 AND (arm = 'G' OR arm = 'S')) GROUP BY ALL),
o AS (SELECT avg((coalesce(grade, 0) >= 1)::INT) FILTER (n = 1) AS p_single, count(*) FILTER (n = 1) AS n_single, avg((coalesce(grade, 0) >= 1)::INT) FILTER (n >= 2) AS p_multiple, count(*) FILTER (n >= 2) AS n_multiple FROM c LEFT JOIN judged USING (need_id, key))
SELECT round(p_single, 6) AS p_single, n_single, round(p_multiple, 6) AS p_multiple, n_multiple, coalesce(n_single >= 10 AND n_multiple >= 10 AND p_multiple - p_single >= 0.1, false) AS supported FROM o""")
def a19(spark, sf):
    h = hits(spark, sf)
    return rounded(jd.sibling_agreement(h, judged(spark, sf, h)), "p_single", "p_multiple")


OBS = "obs AS (SELECT rank, score, (coalesce(grade, 0) >= 1)::INT AS rel FROM hits LEFT JOIN judged USING (need_id, key) WHERE arm = 'A' AND rank <= 12)"


@query("a20_score_bands", ctes(HITS, JUDGED, OBS) + """
SELECT low, high, count(rel) AS n, round(coalesce(avg(rel), 0), 6) AS precision, count(rel) >= 50 AND coalesce(avg(rel), 0) < 0.1 AS cutoff
FROM (VALUES (0.9::DOUBLE, 1.01::DOUBLE), (0.5, 0.9), (0.1, 0.5), (0.0, 0.1)) b(low, high) LEFT JOIN obs ON score >= low AND score < high GROUP BY ALL""")
def a20(spark, sf):
    h = hits(spark, sf)
    return rounded(jd.score_bands(jd.logged_observations(h, judged(spark, sf, h))), "precision")


@query("a21_rank_profile", ctes(HITS, JUDGED, OBS) + """
SELECT r::INT AS rank, count(rel) AS n, round(coalesce(avg(rel), 0), 6) AS precision FROM unnest(range(1, 13)) t(r) LEFT JOIN obs ON obs.rank = r GROUP BY ALL""")
def a21(spark, sf):
    h = hits(spark, sf)
    return rounded(jd.rank_profile(jd.logged_observations(h, judged(spark, sf, h))), "precision")


KAPPA = """cells AS (SELECT scale, a, b, count(*) AS n FROM pairs GROUP BY ALL), tot AS (SELECT scale, sum(n) AS t, sum(n) FILTER (a = b) AS s FROM cells GROUP BY 1),
ch AS (SELECT scale, sum(x.na * y.nb) AS c FROM (SELECT scale, a, sum(n) AS na FROM cells GROUP BY ALL) x JOIN (SELECT scale, b AS a, sum(n) AS nb FROM cells GROUP BY ALL) y USING (scale, a) GROUP BY 1)"""


@query("a22_kappa", ctes("""pairs AS (SELECT 'binary' AS scale, quality AS a, 1 - toxic AS b FROM labels UNION ALL SELECT 'graded', quality + (doc_id % 2)::INT, 1 - toxic + (doc_id % 2)::INT FROM labels)""", KAPPA) + """
SELECT scale, t::BIGINT AS n, round((s / t - c / (t * t)) / (1 - c / (t * t)), 6) AS kappa FROM tot JOIN ch USING (scale)""")
def a22(spark, sf):
    lb, odd = table(spark, sf, "labels"), (F.col("doc_id") % 2).cast("int")
    first, second = F.col("quality").cast("int"), (1 - F.col("toxic")).cast("int")
    pairs = lb.select(F.explode(F.array(
        F.struct(F.lit("binary").alias("scale"), first.alias("first"), second.alias("second")),
        F.struct(F.lit("graded").alias("scale"), (first + odd).alias("first"), (second + odd).alias("second")))).alias("r")).select("r.*")
    return rounded(jd.kappa(pairs, ["scale"]), "kappa")


@query("a37_distinct_share", ctes(HITS, LISTS) + "SELECT round(avg(share), 6) AS distinct_share FROM (SELECT count(DISTINCT key) / count(*) AS share FROM lists WHERE list = 'S@3' GROUP BY need_id)")
def a37(spark, sf):
    return rounded(jd.distinct_share(jd.named_lists(hits(spark, sf))), "distinct_share")


# -- pool ------------------------------------------------------------------------------------------------------------------------

EXISTING = """old_pool AS (SELECT DISTINCT need_id, key, need_id || '-c0' || (1 + chunk_index % 5)::VARCHAR AS id FROM hits WHERE rank = 1 AND arm = 'A' AND need_id[5:5]::INT % 2 = 0)"""
POOL = """seen AS (SELECT need_id, key, string_agg(arm || ':' || label || ':' || rank::VARCHAR || '/' || depth::VARCHAR, ' ' ORDER BY arm || ':' || label || ':' || rank::VARCHAR || '/' || depth::VARCHAR) AS appearances, min(rank / depth) AS best FROM hits WHERE rank <= depth GROUP BY ALL),
fresh AS (SELECT s.*, o.last FROM seen s LEFT JOIN (SELECT need_id, max(regexp_extract(id, '(\\d+)$', 1)::INT) AS last FROM old_pool GROUP BY 1) o USING (need_id) WHERE NOT EXISTS (SELECT 1 FROM old_pool p WHERE p.need_id = s.need_id AND p.key = s.key)),
cut AS (SELECT *, last IS NULL AND row_number() OVER (PARTITION BY need_id ORDER BY best, key) > 44 AS trimmed FROM fresh),
new_pool AS (SELECT need_id, key, appearances, trimmed, CASE WHEN NOT trimmed THEN need_id || '-c' || format('{:02d}', coalesce(last, 0) + row_number() OVER (PARTITION BY need_id, trimmed ORDER BY sha256('7|' || need_id || '|' || (coalesce(last, 0) + 1)::VARCHAR || '|' || key), key)) END AS id FROM cut)"""


def old_pool(h):
    first = jd.with_key(h.filter("rank = 1 AND arm = 'A'")).filter(F.substring("need_id", 5, 1).cast("int") % 2 == 0)
    return first.select("need_id", "key", F.concat(F.col("need_id"), F.lit("-c0"), (1 + F.col("chunk_index") % 5).cast("string")).alias("id")).distinct()


def new_pool(spark, sf):
    h = hits(spark, sf)
    return jd.extend_pool(old_pool(h), h, "7")


@query("w07_pool_trim", ctes(HITS, EXISTING, POOL) + "SELECT need_id, key, trimmed FROM new_pool")
def w07(spark, sf):
    return new_pool(spark, sf).select("need_id", "key", "trimmed")


@query("w08_pool_ids", ctes(HITS, EXISTING, POOL) + "SELECT need_id, key, id, appearances FROM new_pool WHERE NOT trimmed")
def w08(spark, sf):
    return new_pool(spark, sf).filter("NOT trimmed").select("need_id", "key", "id", F.array_join("appearances", " ").alias("appearances"))


@query("l06_judging_sheets", ctes(HITS, EXISTING, POOL) + "SELECT id, (ceil(row_number() OVER (PARTITION BY need_id ORDER BY id) / 12))::BIGINT AS sheet FROM new_pool WHERE id IS NOT NULL")
def l06(spark, sf):
    return jd.judging_sheets(new_pool(spark, sf)).select("id", "sheet")


@query("l05_rejudge_sample", ctes("""pool AS (SELECT 'N' || (l_orderkey % 97)::VARCHAR AS need_id, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR AS id FROM lineitem GROUP BY ALL)""") + """
SELECT need_id, id FROM (SELECT *, row_number() OVER (ORDER BY ('0x' || left(md5('20261016|' || need_id || '|' || id), 15))::BIGINT, id) AS r, count(*) OVER () AS n FROM pool) WHERE r <= round_even(n * 0.08, 0)""")
def l05(spark, sf):
    p = table(spark, sf, "lineitem").select(
        F.concat(F.lit("N"), (F.col("l_orderkey") % 97).cast("string")).alias("need_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id")).distinct()
    return jd.rejudge_sample(p, "20261016")


TARGETS = "targets AS (SELECT 'N' || lpad(s_suppkey::VARCHAR, 4, '0') AS need_id, 'd' || ((s_suppkey * 3 + t) % 200)::VARCHAR AS document, c::INT AS chunk_index FROM supplier, unnest(range(0, 30)) x(t), unnest(range(1, 4)) y(c) WHERE s_suppkey % 3 <> 0)"


@query("w09_known_item_rank", ctes(HITS, TARGETS) + """
SELECT r.need_id, r.arm, r.label, min(h.rank) AS known_rank FROM (SELECT DISTINCT need_id, arm, label FROM hits WHERE need_id IN (SELECT need_id FROM targets)) r
LEFT JOIN (SELECT h.* FROM hits h JOIN targets USING (need_id, document, chunk_index)) h USING (need_id, arm, label) GROUP BY ALL""")
def w09(spark, sf):
    s = F.col("s_suppkey")
    t = table(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("chunk_index", F.explode(F.sequence(F.lit(1), F.lit(3))))
    targets = t.select(need_id(s).alias("need_id"), F.concat(F.lit("d"), ((s * 3 + F.col("t")) % 200).cast("string")).alias("document"), "chunk_index")
    return jd.rank_of_known(hits(spark, sf), targets)


@query("w09_first_answer_rank", ctes(*ALL) + "SELECT need_id, list, min(rank) FILTER (grade = 2) AS answer_rank FROM lj WHERE list IN ('A@12', 'G@12') GROUP BY ALL")
def w09b(spark, sf):
    h = hits(spark, sf)
    return jd.first_answer(jd.named_lists(h), judged(spark, sf, h), ["A@12", "G@12"])


# -- specs -----------------------------------------------------------------------------------------------------------------------

SPECS = """specs AS (
 SELECT need_id, 'A' AS arm, 'A' AS label, 'logged ' || s AS query, NULL AS document, 12 AS depth FROM n UNION ALL SELECT need_id, 'G', 'G', 'guided ' || s, NULL, 12 FROM n
 UNION ALL SELECT need_id, 'S', 's' || (i + 1)::VARCHAR, 'sib ' || i::VARCHAR || ' ' || s, NULL, 3 FROM n, unnest(range(1, 4)) t(i) UNION ALL SELECT need_id, 'M', 'M', 'multi ' || s, NULL, 12 FROM n WHERE k % 2 = 0
 UNION ALL SELECT need_id, 'F', 'kw', 'kw ' || s, NULL, 3 FROM n WHERE k % 3 = 0 UNION ALL SELECT need_id, 'P', 'p' || p::VARCHAR, 'guided ' || s, 'src' || p::VARCHAR || '%', 3 FROM n, unnest([1, 2]) t(p) WHERE k % 4 = 0)"""
SPEC_NEEDS = "n AS (SELECT 'N' || lpad(s_suppkey::VARCHAR, 4, '0') AS need_id, s_suppkey AS k, s_suppkey::VARCHAR AS s FROM supplier)"


def specs(spark, sf):
    k = F.col("s_suppkey")
    s = k.cast("string")
    none = F.lit(None)
    n = table(spark, sf, "supplier").select(
        need_id(k).alias("need_id"), F.lit("c").alias("collection"), none.cast("string").alias("document"), none.cast("string").alias("exclude"),
        F.concat(F.lit("logged "), s).alias("logged_query"), F.concat(F.lit("guided "), s).alias("g"), F.when(k % 2 == 0, F.concat(F.lit("multi "), s)).alias("m"),
        F.array(*[F.concat(F.lit(f"sib {i} "), s) for i in (1, 2, 3)]).alias("siblings"),
        F.when(k % 3 == 0, F.create_map(F.lit("kw"), F.concat(F.lit("kw "), s))).alias("forms"),
        F.when(k % 4 == 0, F.array(*[F.struct(F.lit(f"p{p}").alias("label"), F.lit(f"src{p}%").alias("document")) for p in (1, 2)])).alias("per_source"))
    return jd.build_specs(n)


@query("r11_search_specs", ctes(SPEC_NEEDS, SPECS) + "SELECT * FROM specs")
def r11(spark, sf):
    return specs(spark, sf).select("need_id", "arm", "label", "query", "document", "depth")


@query("r12_pending_specs", ctes(HITS, SPEC_NEEDS, SPECS) + "SELECT need_id, arm, label FROM specs WHERE (need_id, arm, label) NOT IN (SELECT (need_id, arm, label) FROM hits WHERE rank = 1 AND score > 0.93)")
def r12(spark, sf):
    done = hits(spark, sf).filter("rank = 1 AND score > 0.93")
    return jd.pending(specs(spark, sf), done).select("need_id", "arm", "label")


@query("s11_judgment_lines", """
SELECT 'N' || doc_id::VARCHAR AS id, (CASE WHEN doc_id % 4 = 0 THEN toxic ELSE quality + 1 - toxic END)::INT AS grade, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'a1,a3' ELSE '' END AS aspects FROM labels""")
def s11(spark, sf):
    d = F.col("doc_id")
    grade = (F.col("quality") + 1 - F.col("toxic")).cast("string")
    first = F.concat(F.lit("N"), d.cast("string"), F.lit("  "), grade, F.when(d % 3 == 0, " a3,a1 ").otherwise(""))
    again = F.when(d % 4 == 0, F.concat(F.lit("N"), d.cast("string"), F.lit(" "), F.col("toxic").cast("string")))
    lines = table(spark, sf, "labels").select("doc_id", F.posexplode(F.array(F.lit("# header"), first, F.lit("short"), F.coalesce(again, F.lit("")))).alias("line", "value"))
    rows = evalsets.judgment_rows(lines.select(F.when(F.col("line") == 3, "N2.txt").otherwise("N1.txt").alias("file"), F.lit(0).alias("block"), "line", "value"))
    return evalsets.latest_judgments(rows).select("id", "grade", F.array_join("aspects", ",").alias("aspects"))
