"""Pooled relevance judging: building the pool, judging lists against it, comparing strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondeo.functions import logs, ordered

# List budgets, sibling labels, depths, pool and sheet sizes, tolerances and thresholds of the decisions.
BUDGETS = [3, 4, 5, 6, 8, 12]
BUDGET_ARMS = ["A", "G", "M"]
SIBLING_LABELS = ["s1", "s2", "s3", "s4"]
ARM_DEPTH = {"A": 12, "G": 12, "S": 3, "M": 12, "F": 3, "P": 3, "R": 5}
POOL_CAP = 44
SHEET_SIZE = 12
SAMPLE_SHARE = 0.08
TIE_TOLERANCE = 1e-9
SUPPORT_SHARE = 2 / 3
HIT_TOLERANCE = 1
INLINE_CAP = 5
AGREEMENT_MARGIN = 0.10
AGREEMENT_MIN_GROUP = 10
CUTOFF_MAX_PRECISION = 0.10
CUTOFF_MIN_RESULTS = 50
SCORE_BANDS = [(0.9, 1.01), (0.5, 0.9), (0.1, 0.5), (0.0, 0.1)]

RUN = ["need_id", "arm", "label"]


# -- specs -----------------------------------------------------------------------------------------------------------------

def build_specs(needs: DataFrame) -> DataFrame:
    """One row per search to run for a need: logged, guided, siblings, multi-concept, forms, one per source.

    ``needs``: need_id, collection, document, exclude, logged_query, g, m, siblings[], forms{}, per_source[label, document].
    """
    def spec(arm, label, query, document=F.lit(None).cast("string")):
        return F.struct(F.lit(arm).alias("arm"), label.alias("label"), query.alias("query"), document.alias("document"))

    none = F.array().cast("array<struct<arm: string, label: string, query: string, document: string>>")
    single = F.array(spec("A", F.lit("A"), F.col("logged_query")), spec("G", F.lit("G"), F.col("g")))
    siblings = F.transform("siblings", lambda q, i: spec("S", F.concat(F.lit("s"), (i + 2).cast("string")), q))
    multi = F.when(F.coalesce("m", F.lit("")) != "", F.array(spec("M", F.lit("M"), F.col("m")))).otherwise(none)
    forms = F.transform(F.map_entries("forms"), lambda e: spec("F", e["key"], e["value"]))
    sources = F.transform("per_source", lambda s: spec("P", s["label"], F.col("g"), s["document"]))
    every = F.concat(single, *[F.coalesce(p, none) for p in (siblings, multi, forms, sources)])
    depth = F.create_map(*[F.lit(x) for pair in ARM_DEPTH.items() for x in pair])
    return needs.select("need_id", "collection", F.col("document").alias("_d"), "exclude", F.explode(every).alias("s")).select(
        "need_id", "s.arm", "s.label", "s.query", "collection", F.coalesce("s.document", "_d").alias("document"), "exclude",
        depth[F.col("s.arm")].alias("depth"))


def pending(specs: DataFrame, runs: DataFrame) -> DataFrame:
    return specs.join(runs.select(*RUN).distinct(), RUN, "left_anti")


# -- pool ------------------------------------------------------------------------------------------------------------------

def with_key(hits: DataFrame) -> DataFrame:
    return hits.withColumn("key", logs.chunk_key(F.col("collection"), F.col("document"), F.col("chunk_index")))


def appearances(hits: DataFrame) -> DataFrame:
    """Where each chunk of a need was listed within the depth of its run, and its best normalised rank."""
    seen = with_key(hits.filter(F.col("rank") <= F.col("depth")))
    place = F.concat_ws(":", "arm", "label", F.concat(F.col("rank").cast("string"), F.lit("/"), F.col("depth").cast("string")))
    return seen.groupBy("need_id", "key").agg(
        F.array_sort(F.collect_list(place)).alias("appearances"), F.min(F.col("rank") / F.col("depth")).alias("best"))


def extend_pool(pool: DataFrame, hits: DataFrame, seed: str, cap: int = POOL_CAP) -> DataFrame:
    """New pool rows (need_id, key, id, appearances, trimmed). A need's first build keeps the best ``cap`` chunks.

    Ids go on from the need's last number in an order drawn by hash, so they tell nothing about rank. ``pool`` holds
    need_id, key, id. The limit per need is applied per partition first; trimmed rows come back without an id.
    """
    seen = appearances(hits)
    state = pool.groupBy("need_id").agg(F.max(F.regexp_extract("id", r"-c(\d+)$", 1).cast("int")).alias("_last"))
    fresh = seen.join(pool.select("need_id", "key"), ["need_id", "key"], "left_anti").join(state, "need_id", "left")
    first, later = fresh.filter(F.col("_last").isNull()), fresh.filter(F.col("_last").isNotNull())
    kept = ordered.top_k(first, ["need_id"], [F.asc("best"), F.asc("key")], cap, "_r").drop("_r")
    trimmed = first.join(kept.select("need_id", "key"), ["need_id", "key"], "left_anti")
    numbered = kept.unionByName(later)
    start = F.coalesce("_last", F.lit(0))
    code = F.sha2(F.concat_ws("|", F.lit(seed), "need_id", (start + 1).cast("string"), "key").cast("binary"), 256)
    number = F.row_number().over(Window.partitionBy("need_id").orderBy(code, "key")) + start
    named = numbered.withColumn("id", F.format_string("%s-c%02d", "need_id", number))
    out = ["need_id", "key", "id", "appearances"]
    return named.select(*out, F.lit(False).alias("trimmed")).unionByName(
        trimmed.withColumn("id", F.lit(None).cast("string")).select(*out, F.lit(True).alias("trimmed")))


def judging_sheets(new_rows: DataFrame, size: int = SHEET_SIZE) -> DataFrame:
    """Sheet number of each new pool row, in id order; the new rows of a need come from a few short lists."""
    w = Window.partitionBy("need_id").orderBy("id")
    return new_rows.filter(F.col("id").isNotNull()).withColumn("sheet", F.ceil(F.row_number().over(w) / size))


def rejudge_sample(pool: DataFrame, seed: str, share: float = SAMPLE_SHARE) -> DataFrame:
    """Exactly round(share * n) pool rows, the same ones every time."""
    code = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(seed), "need_id", "id")), F.lit(15)), 16, 10).cast("long")
    picked = ordered.smallest_n(pool.withColumn("_code", code), "_code", F.bround(F.col("total") * share).cast("long"))
    return picked.drop("_code")


def stratified(candidates: DataFrame, seed: str) -> DataFrame:
    """Stratum by collection suffix and a seeded order inside it (sort by ``position``)."""
    return candidates.withColumn("stratum", logs.stratum(F.col("collection"))).withColumn(
        "position", F.md5(F.concat(F.lit(f"{seed}|"), F.col("search_id"))))


# -- judged lists ------------------------------------------------------------------------------------------------------------

def judged_pool(pool: DataFrame, judgments: DataFrame) -> DataFrame:
    """Pool chunks with grade and aspects; without a judgment grade 0 and no aspect."""
    return pool.join(judgments, "id", "left").select(
        "need_id", "key", F.coalesce("grade", F.lit(0)).alias("grade"), F.coalesce("aspects", F.array().cast("array<string>")).alias("aspects"))


def aspect_universe(judged: DataFrame) -> DataFrame:
    """Number of distinct aspects that some relevant chunk of the need covers."""
    return judged.filter("grade >= 1").select("need_id", F.explode("aspects").alias("a")).distinct().groupBy("need_id").agg(
        F.count("*").alias("universe"))


def named_lists(hits: DataFrame) -> DataFrame:
    """Rows (need_id, list, position, key, document) of all compared lists.

    Every hit names the lists it belongs to, so one pass over the runs builds them all.
    """
    arm, label, rank = F.col("arm"), F.col("label"), F.col("rank")
    sibling = F.when((arm == "G") & (label == "G"), F.lit("s1")).when((arm == "S") & label.isin(SIBLING_LABELS), label)
    named = [F.when(arm.isin(BUDGET_ARMS) & (arm == label) & (rank <= b), F.concat(arm, F.lit(f"@{b}"))) for b in BUDGETS]
    named += [F.when(sibling.isNotNull() & (rank <= d), F.lit(f"S@{d}")) for d in (1, 2, 3)]
    named += [F.when((arm == "F") & (rank <= 3), F.concat(F.lit("F:"), label, F.lit("@3"))), F.when((arm == "P") & (rank <= 3), F.lit("P@3"))]
    named += [F.when((arm == "R") & (label == "R") & (rank <= d), F.lit(f"R@{d}")) for d in (3, 5)]
    return with_key(hits).withColumn("list", F.explode(F.array_compact(F.array(*named)))).select(
        "need_id", "list", F.struct(F.when(F.col("list").startswith("S@"), sibling).otherwise(label).alias("part"), "rank").alias("position"), "key", "document")


def list_metrics(lists: DataFrame, judged: DataFrame) -> DataFrame:
    """Printed, hit, distinct relevant, precision, aspect share and relevant documents per list.

    The sets gathered here belong to one list, at most twelve entries long.
    """
    j = lists.join(judged, ["need_id", "key"], "left")
    rel = F.coalesce(F.col("grade") >= 1, F.lit(False))
    per = j.groupBy("need_id", "list").agg(
        F.count("*").alias("printed"), F.max(F.coalesce((F.col("grade") == 2).cast("int"), F.lit(0))).alias("hit"),
        F.size(F.collect_set(F.when(rel, F.col("key")))).alias("rel"), (F.count_if(rel) / F.count("*")).alias("p"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(rel, F.col("aspects")))))).alias("covered"),
        F.size(F.collect_set(F.when(rel, F.col("document")))).alias("reldocs"))
    joined = per.join(aspect_universe(judged), "need_id", "left")
    return joined.select("need_id", "list", "printed", "hit", "rel", "p", (F.col("covered") / F.col("universe")).alias("asp"), "reldocs")


def distinct_share(lists: DataFrame, name: str = "S@3") -> DataFrame:
    """Mean over needs of distinct / printed chunks of one list."""
    per = lists.filter(F.col("list") == name).groupBy("need_id").agg((F.count_distinct("key") / F.count("*")).alias("share"))
    return per.agg(F.avg("share").alias("distinct_share"))


def rank_of_known(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """First rank of a wanted (document, chunk_index) per run of every need that names one; null if it is not listed."""
    wanted = targets.select("need_id", "document", "chunk_index").distinct()
    runs = hits.select(*RUN).distinct().join(wanted.select("need_id").distinct(), "need_id", "left_semi")
    found = hits.join(wanted, ["need_id", "document", "chunk_index"]).groupBy(*RUN).agg(F.min("rank").alias("known_rank"))
    return runs.join(found, RUN, "left")


def first_answer(lists: DataFrame, judged: DataFrame, names: list[str]) -> DataFrame:
    """First rank with the top grade in each named list."""
    j = lists.filter(F.col("list").isin(names)).join(judged.select("need_id", "key", "grade"), ["need_id", "key"], "left")
    return j.groupBy("need_id", "list").agg(F.min(F.when(F.col("grade") == 2, F.col("position.rank"))).alias("answer_rank"))


# -- comparisons -------------------------------------------------------------------------------------------------------------

def verdict(wins: Column, losses: Column) -> Column:
    decided = wins + losses
    return (
        F.when((wins > losses) & (wins / decided >= SUPPORT_SHARE), "supported")
        .when((losses > wins) & (losses / decided >= SUPPORT_SHARE), "not supported").otherwise("inconclusive")
    )


def _outcomes(a: Column, b: Column) -> list[Column]:
    decided = a.isNotNull() & b.isNotNull() & (F.abs(a - b) > TIE_TOLERANCE)
    return [F.count_if(decided & (a > b)).alias("wins"), F.count_if(decided & (a < b)).alias("losses"),
            F.count_if(~F.coalesce(decided, F.lit(False))).alias("ties")]


def _lists_of_needs(metrics: DataFrame) -> DataFrame:
    """One row per need with its metrics by list name; the named lists are some thirty, whatever the size of the log."""
    values = F.struct(*[F.col(m).cast("double").alias(m) for m in ("hit", "rel", "p", "asp", "reldocs")])
    return metrics.groupBy("need_id").agg(F.map_from_entries(F.collect_list(F.struct("list", values))).alias("by_list"))


def compare_lists(metrics: DataFrame, claims: list[tuple[str, str, str, str]]) -> DataFrame:
    """Wins, losses, ties, verdict and means for each (claim, first, second, measure) over needs that have both lists."""
    per = _lists_of_needs(metrics)
    lists = F.col("by_list")
    rows = F.array(*[F.struct(
        F.lit(claim).alias("claim"), (F.map_contains_key(lists, F.lit(one)) & F.map_contains_key(lists, F.lit(two))).alias("both"),
        lists[one][measure].alias("a"), lists[two][measure].alias("b")) for claim, one, two, measure in claims])
    j = per.select(F.explode(rows).alias("r")).select("r.*").filter("both")
    a, b = F.col("a"), F.col("b")
    return j.groupBy("claim").agg(*_outcomes(a, b), F.coalesce(F.avg(a), F.lit(0.0)).alias("mean_first"), F.coalesce(F.avg(b), F.lit(0.0)).alias("mean_second")).withColumn(
        "verdict", verdict(F.col("wins"), F.col("losses")))


# The strategy comparisons (name, first list, second list, intent of the needs or none for all).
STRATEGIES = [("all", "S@3", "A@12", None), ("recall_only", "S@3", "A@12", "recall"), ("precision_only", "S@3", "A@12", "precision"),
              ("multiplicity_control", "S@3", "G@12", None), ("shape_control", "G@12", "A@12", None)]


def strategy_decisions(metrics: DataFrame, needs: DataFrame) -> DataFrame:
    """Adopt the first list? At least all but one hit of the second, a larger aspect mean, and more wins than losses.

    Five comparisons: siblings against logged for all, recall and precision needs, siblings and guided as controls.
    """
    kind = F.when(F.col("intent") == "recall", "recall").otherwise("precision")
    per = _lists_of_needs(metrics).join(needs.select("need_id", kind.alias("kind")), "need_id")
    lists = F.col("by_list")

    def row(name, one, two, intent):
        usable = F.map_contains_key(lists, F.lit(one)) & F.map_contains_key(lists, F.lit(two))
        if intent:
            usable = usable & (F.col("kind") == intent)
        return F.struct(F.lit(name).alias("comparison"), usable.alias("usable"), lists[one]["hit"].alias("ha"), lists[two]["hit"].alias("hb"),
                        lists[one]["asp"].alias("a"), lists[two]["asp"].alias("b"))

    j = per.select(F.explode(F.array(*[row(*s) for s in STRATEGIES])).alias("r")).select("r.*").filter("usable")
    agg = j.groupBy("comparison").agg(
        F.sum("ha").cast("long").alias("hit_s"), F.sum("hb").cast("long").alias("hit_a"), F.coalesce(F.avg("a"), F.lit(0.0)).alias("asp_mean_s"),
        F.coalesce(F.avg("b"), F.lit(0.0)).alias("asp_mean_a"), *_outcomes(F.col("a"), F.col("b")))
    adopt = (F.col("hit_s") >= F.col("hit_a") - HIT_TOLERANCE) & (F.round("asp_mean_s", 12) > F.round("asp_mean_a", 12)) & (F.col("wins") > F.col("losses"))
    return agg.withColumn("adopt", adopt)


def list_totals(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Hit, relevant and document sums, mean precision and aspects per list (budget curve, equal-print table)."""
    return metrics.filter(F.col("list").isin(names)).groupBy("list").agg(
        F.count("*").alias("needs"), F.sum("hit").alias("hit"), F.sum("rel").alias("rel"), F.coalesce(F.avg("asp"), F.lit(0.0)).alias("asp"),
        F.sum("reldocs").alias("reldocs"), F.avg("p").alias("p"))


def default_count(metrics: DataFrame) -> DataFrame:
    """Smallest budget up to 5 whose logged hits reach those of 12 less one; confirmed if guided hits reach it as well."""
    per = metrics.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("list") == f"{arm}@{b}", F.col("hit"))), F.lit(0)).alias(f"{arm}{b}") for arm in ("A", "G") for b in BUDGETS])
    small = [b for b in BUDGETS if b <= INLINE_CAP]
    ok = lambda b: F.col(f"A{b}") >= F.col("A12") - HIT_TOLERANCE
    k_star = F.coalesce(*[F.when(ok(b), F.lit(b)) for b in small])
    confirmed = F.coalesce(*[F.when(ok(b), F.col(f"G{b}") >= F.col(f"A{b}")) for b in small], F.lit(False))
    return per.select(k_star.alias("k_star"), confirmed.alias("confirmed"), *[F.col(f"A{b}").alias(f"hit_a_{b}") for b in BUDGETS], *[F.col(f"G{b}").alias(f"hit_g_{b}") for b in BUDGETS])


def sibling_agreement(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """Precision of chunks returned by one and by several sibling searches (top 3 each)."""
    sib = ((F.col("arm") == "G") & (F.col("label") == "G")) | ((F.col("arm") == "S") & F.col("label").isin(SIBLING_LABELS[1:]))
    listed = with_key(hits.filter(sib & (F.col("rank") <= 3))).select("need_id", "label", "key").distinct()
    counts = listed.groupBy("need_id", "key").agg(F.count("*").alias("n")).join(judged.select("need_id", "key", "grade"), ["need_id", "key"], "left")
    rel = F.coalesce(F.col("grade") >= 1, F.lit(False)).cast("double")
    one, many = F.col("n") == 1, F.col("n") >= 2
    out = counts.agg(F.avg(F.when(one, rel)).alias("p_single"), F.count_if(one).alias("n_single"), F.avg(F.when(many, rel)).alias("p_multiple"), F.count_if(many).alias("n_multiple"))
    enough = (F.col("n_single") >= AGREEMENT_MIN_GROUP) & (F.col("n_multiple") >= AGREEMENT_MIN_GROUP)
    return out.withColumn("supported", F.coalesce(enough & (F.col("p_multiple") - F.col("p_single") >= AGREEMENT_MARGIN), F.lit(False)))


def logged_observations(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """(rank, score, rel) of the first twelve logged hits of every need."""
    j = with_key(hits.filter((F.col("arm") == "A") & (F.col("rank") <= 12))).join(judged.select("need_id", "key", "grade"), ["need_id", "key"], "left")
    return j.select("rank", "score", F.coalesce((F.col("grade") >= 1).cast("int"), F.lit(0)).alias("rel"))


def score_bands(observations: DataFrame) -> DataFrame:
    """Number and precision per score band [low, high); empty bands show with zero. ``cutoff`` marks a band worth cutting."""
    spark = observations.sparkSession
    every = spark.createDataFrame([(float(a), float(b)) for a, b in SCORE_BANDS], "low double, high double")
    low = F.coalesce(*[F.when((F.col("score") >= a) & (F.col("score") < b), F.lit(float(a))) for a, b in SCORE_BANDS])
    per = observations.groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.avg("rel").alias("precision"))
    out = every.join(per, "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("precision", F.lit(0.0)).alias("precision"))
    return out.withColumn("cutoff", (F.col("n") >= CUTOFF_MIN_RESULTS) & (F.col("precision") < CUTOFF_MAX_PRECISION))


def rank_profile(observations: DataFrame) -> DataFrame:
    every = observations.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("rank"))
    per = observations.groupBy("rank").agg(F.count("*").alias("n"), F.avg("rel").alias("precision"))
    return every.join(per, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def kappa(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """Cohen's kappa of two label columns (first, second) per group, from the table of label pairs.

    Label pairs are counted before anything else, so what follows has one row per pair of categories.
    """
    cells = pairs.groupBy(*groups, "first", "second").agg(F.count("*").alias("n"))
    total = cells.groupBy(*groups).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c: cells.groupBy(*groups, F.col(c).alias("category")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side("first").join(side("second"), [*groups, "category"]).groupBy(*groups).agg(F.sum(F.col("n_first") * F.col("n_second")).alias("chance"))
    j = total.join(chance, groups, "left")
    observed, expected = F.col("same") / F.col("total"), F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))
    return j.select(*groups, F.col("total").alias("n"), F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"))
