"""Search log analytics: joining calls, searches and expands, and the indicators of the report."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondeo.functions import heavy, logs, ordered
from sondeo.operators.filters import LOG_FAILURE_CODES
from sondeo.session import checkpointed

# Margins, windows, ranks and limits of the report.
JOIN_MARGIN_US = 2_000_000
COLD_MARGIN_US = 1_000_000
EXPAND_WINDOW_US = 60 * 60 * 1_000_000
MATCH_WINDOW_US = 120 * 1_000_000
SCORE_PROFILE_RANKS = [1, 3, 6, 12]
PERSIST_THRESHOLD_CHARS = 30000
START_CODE = "start_initiated"
START_SERVER = "^(embedding|reranker)"
SEARCH_KEY = ["query", "collection", "document", "exclude"]
MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
ALL = "all"


# -- projects ------------------------------------------------------------------------------------------------------------

def known_projects(log: DataFrame) -> DataFrame:
    suffix = f"({logs.DOCS_SUFFIX}|{logs.REFERENCE_SUFFIX})$"
    named = log.select("collection").distinct().filter(F.col("collection").rlike(suffix))
    return named.select(F.regexp_replace("collection", suffix, "").alias("project")).distinct()


def with_project(calls: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds the project of the working directory: the last known project among its parts. Each folder is looked up once."""
    folders = calls.select("cwd").distinct().filter(F.col("cwd").isNotNull())
    parts = folders.select("cwd", F.posexplode(logs.path_parts_before_tooling(F.col("cwd"))).alias("pos", "project"))
    owner = parts.join(projects, "project").groupBy("cwd").agg(F.max_by("project", "pos").alias("project"))
    return calls.join(owner, "cwd", "left")


# -- joins ---------------------------------------------------------------------------------------------------------------

def join_calls_to_searches(calls: DataFrame, log: DataFrame, call_id: str, tie: str, scratch: str | None = None) -> DataFrame:
    """(call_id, search_id): calls in time order each take the earliest unused search of the same key in their window.

    Windows that overlap in a chain form an island; islands of a key do not influence each other. Islands of one call,
    the usual case, are solved by a join and a minimum. Only longer chains need an ordered pass: islands are spread over
    the partitions and sorted by Spark, and each partition streams by once with the calls that still wait in memory, so
    neither a hot key nor one endless chain is gathered. Calls without a result never match.

    The two narrow intermediate tables are read several times and therefore checkpointed (``scratch``: folder to use
    where the cluster names none).
    """
    us = logs.micros
    timed = calls.filter(F.col("result_ts").isNotNull()).select(
        F.col(call_id).alias("call_id"), F.col(tie).alias("tie"), *SEARCH_KEY,
        (us(F.col("tool_use_ts")) - JOIN_MARGIN_US).alias("lo"), (us(F.col("result_ts")) + JOIN_MARGIN_US).alias("hi"),
    )
    reach = checkpointed(
        ordered.largest_before(timed, timed, SEARCH_KEY, "lo", "lo", F.col("hi"), HOUR_US, "reach", strict=True), scratch)
    heads = reach.filter(F.col("reach").isNull() | (F.col("reach") < F.col("lo"))).select(*SEARCH_KEY, "lo").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    call_type = reach.schema["call_id"].dataType.simpleString()
    tie_type = reach.schema["tie"].dataType.simpleString()
    # Calls and searches as one table of points, each placed on its island: "lo" is set for calls, "at" for searches.
    points = reach.select(*SEARCH_KEY, F.col("lo").alias("pos"), "call_id", "tie", "lo", "hi", none("string").alias("search_id"), none("long").alias("at")).unionByName(
        log.select(*SEARCH_KEY, us(F.col("ts")).alias("pos"), none(call_type).alias("call_id"), none(tie_type).alias("tie"),
                   none("long").alias("lo"), none("long").alias("hi"), "search_id", us(F.col("ts")).alias("at")))
    placed = ordered.largest_before(points, heads, SEARCH_KEY, "pos", "lo", F.col("lo"), HOUR_US, "island").filter(F.col("island").isNotNull())
    # Unions of keys into one text spare the null-safe comparisons of the group key from here on.
    group = F.concat_ws("|", F.to_json(F.struct(*SEARCH_KEY)), F.col("island").cast("string"))
    members = checkpointed(placed.select(group.alias("group"), "call_id", "tie", "lo", "hi", "search_id", "at"), scratch)

    sizes = members.groupBy("group").agg(F.count("call_id").alias("n_calls"), F.count("search_id").alias("n_records")).filter("n_calls > 0 AND n_records > 0")
    single = members.filter("lo IS NOT NULL").join(sizes.filter("n_calls = 1").select("group"), "group", "left_semi").select("group", "call_id", "lo", "hi")
    records = members.filter("at IS NOT NULL").select("group", "search_id", "at")
    direct = single.join(records, "group").filter(F.col("at").between(F.col("lo"), F.col("hi"))).groupBy("call_id").agg(
        F.min(F.struct("at", "search_id")).alias("m")).select("call_id", "m.search_id")
    chained = members.join(sizes.filter("n_calls > 1").select("group"), "group", "left_semi")
    # A call opens before the searches of its first microsecond, so calls sort first; "until" is set for calls only.
    events = chained.select("group", F.coalesce("lo", "at").alias("pos"), F.col("lo").isNull().alias("found"), "tie", "call_id", "search_id", F.col("hi").alias("until"))
    in_order = events.repartition("group").sortWithinPartitions("group", "pos", "found", "tie", "search_id")
    greedy = in_order.mapInArrow(_take_in_order, f"call_id {call_type}, search_id string")
    return direct.unionByName(greedy)


def _take_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls wait in line from their start; a search goes to the first in line whose window is still open. As searches come in
    time order, a call that has closed for one has closed for all later ones, so each event enters and leaves the line once."""
    group, waiting = None, deque()
    for batch in batches:
        calls, searches = [], []
        columns = (batch.column(name).to_pylist() for name in ("group", "pos", "found", "call_id", "search_id", "until"))
        for of, pos, found, call, search, until in zip(*columns):
            if of != group:
                group = of
                waiting.clear()
            if not found:
                waiting.append((until, call))
                continue
            while waiting and waiting[0][0] < pos:
                waiting.popleft()
            if waiting:
                calls.append(waiting.popleft()[1])
                searches.append(search)
        yield pa.RecordBatch.from_arrays([pa.array(calls, batch.schema.field("call_id").type), pa.array(searches, pa.string())], ["call_id", "search_id"])


def attribute_expands(expands: DataFrame, log: DataFrame, hits: DataFrame, window_us: int = EXPAND_WINDOW_US) -> DataFrame:
    """Each expand with the latest search of its collection, at most an hour old, that listed the chunk, else the document.

    Two as-of lookups over sorted unions, keyed by chunk and by document: no (expand, search) pair is formed, and a
    collection that holds most of the log is spread over its documents and hours.
    """
    listed = hits.join(log.select("search_id", "collection", logs.micros(F.col("ts")).alias("at")), "search_id")
    points = expands.withColumn("at", logs.micros(F.col("ts")))

    def lookup(df: DataFrame, keys: list[str], out: str) -> DataFrame:
        marks = listed.groupBy(*keys, "at").agg(F.min(F.struct("search_id", "rank")).alias("first"))
        found = ordered.largest_before(
            df, marks, keys, "at", "at", F.struct("at", "first.search_id", "first.rank"), window_us, out
        )
        return found.withColumn(out, F.when(F.col("at") - F.col(f"{out}.at") <= window_us, F.col(out)))

    both = lookup(lookup(points, ["collection", "document", "chunk_index"], "_exact"), ["collection", "document"], "_doc")
    best = F.coalesce("_exact", "_doc")
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_doc").isNotNull(), "document")
    return both.select(*expands.columns, best["search_id"].alias("search_id"), kind.alias("kind"), best["rank"].alias("hit_rank"))


def start_events(errors: DataFrame) -> DataFrame:
    return errors.filter((F.col("code") == START_CODE) & F.col("server").rlike(START_SERVER))


def with_cold_start(log: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds ``cold``: a model start lies between one second before the search began and its end."""
    points = log.withColumn("_at", logs.micros(F.col("ts")))
    marks = starts.select(logs.micros(F.col("ts")).alias("_start"))
    found = ordered.largest_before(points, marks, [], "_at", "_start", F.col("_start"), MINUTE_US, "_last")
    begin = F.col("_at") - F.col("duration_ms") * 1000 - COLD_MARGIN_US
    return found.withColumn("cold", F.coalesce(F.col("_last") >= begin, F.lit(False))).drop("_at", "_last")


def match_commands(searches: DataFrame, commands: DataFrame, order: str) -> DataFrame:
    """First command (by ``order``) within 120 s that names the collection and the first 40 characters of the query.

    No equality exists here, so time is cut into buckets of the window width and a command is offered to its own bucket
    and both neighbours. The distinct query starts of a bucket are looked for in one pass over each command; repeats are joined back by
    time.
    """
    width = MATCH_WINDOW_US
    timed = searches.select("search_id", "collection", F.left("query", F.lit(40)).alias("_q"), logs.micros(F.col("ts")).alias("_at"))
    timed = timed.withColumn("_b", F.floor(F.col("_at") / width))
    offered = commands.select(F.col(order).alias("_order"), "command", logs.micros(F.col("ts")).alias("_cat")).withColumn(
        "_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_cat") / width) + d))
    )
    patterns = timed.select("_b", "collection", "_q").distinct()
    named = heavy.containing(offered, patterns, ["_b"], "command", "_q", ["_order"]).filter(F.col("command").contains(F.col("collection")))
    close = timed.join(named, ["_b", "collection", "_q"]).filter(F.abs(F.col("_at") - F.col("_cat")) < width)
    return close.groupBy("search_id").agg(F.min(F.struct("_order", "command")).alias("m")).select(
        "search_id", F.col("m._order").alias(order), "m.command")


def hit_contents(hits: DataFrame, contents: DataFrame, measures: list[Column] | None = None) -> DataFrame:
    """Hits with stored contents by position after sorting both by rank; the shorter side ends the list.

    Both sides are single result lists (at most the search depth). With ``measures`` (expressions over ``content``) each text is measured
    where it is read, and only its measures move to the hit. Texts may be many times larger than the planner thinks, so the join is by
    sorted keys: they are never gathered on the driver to be sent to all tasks.
    """
    w = Window.partitionBy("search_id").orderBy("rank")
    left = hits.withColumn("pos", F.row_number().over(w))
    taken = contents.select("search_id", "rank", *(measures or [F.col("content")]))
    right = taken.withColumn("pos", F.row_number().over(w)).drop("rank")
    return left.join(right.hint("merge"), ["search_id", "pos"])


def output_sizes(searches: DataFrame, hits: DataFrame, contents: DataFrame) -> DataFrame:
    """Characters of the printed list per search: rendered results joined by line breaks; 0 without contents.

    A printed result is as long as its lines around the content and the content together."""
    placed = hit_contents(hits, contents, [F.length("content").alias("_chars")]).join(searches.select("search_id", "collection"), "search_id")
    around = logs.render_result(F.col("pos"), F.col("score"), F.col("collection"), F.col("document"), F.col("chunk_index"), F.lit(""))
    sums = placed.groupBy("search_id").agg((F.sum(F.length(around) + F.col("_chars")) + F.count("*") - 1).alias("output_chars"))
    return searches.select("search_id").join(sums, "search_id", "left").fillna(0, ["output_chars"])


def with_provenance(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``complete``: the fingerprint is registered (last entry wins) with preset and model of both models."""
    order = [c for c in ("line_order", "first_seen") if c in registry.columns][:1]
    last = registry.groupBy("fingerprint").agg(F.max_by(F.struct("embedding", "reranker"), F.col(order[0])).alias("r"))
    given = F.lit(True)
    for part in ("embedding", "reranker"):
        for field in ("preset", "model_name"):
            given = given & (F.coalesce(F.col(f"r.{part}.{field}"), F.lit("")) != "")
    flags = last.select(F.col("fingerprint").alias("config_fingerprint"), given.alias("complete"))
    return log.join(flags, "config_fingerprint", "left").fillna(False, ["complete"])


# -- indicators ----------------------------------------------------------------------------------------------------------

def version_groups() -> Column:
    """``all`` and the version. A version of that very name is called ``all (version)``, so it is never part of the total twice."""
    return F.array(F.lit(ALL), F.when(F.col("version") == ALL, f"{ALL} (version)").otherwise(F.col("version")))


def by_version(items: DataFrame) -> DataFrame:
    """Each item under its version and under ``all``."""
    return items.withColumn("version_group", F.explode(version_groups()))


def technical_indicators(items: DataFrame) -> DataFrame:
    """Counts, latencies and output sizes per version group, from one pass over the items.

    Every item gives a few (measure, value) entries, which are counted first. All values are whole numbers (ms,
    characters, hits, flags), so the counted table is bounded by their ranges, and percentiles, maxima and the length
    of the longest list are read from it.
    """
    ms = F.when(F.col("cold"), "cold").otherwise("warm")
    entry = lambda measure, value: F.struct(measure.alias("measure"), value.cast("long").alias("value"))
    entries = F.array(
        entry(F.lit("hits"), F.col("hit_count")), entry(ms, F.col("duration_ms")), entry(F.lit("output"), F.col("output_chars")),
        entry(F.lit("complete"), F.col("complete").cast("int")),
        entry(F.lit("no_candidates"), ((F.col("hit_count") == 0) & (F.col("candidates") == 0)).cast("int")))
    groups = version_groups()
    counted = items.select(groups.alias("g"), F.explode(entries).alias("e")).select(F.explode("g").alias("version_group"), "e.*").groupBy(
        "version_group", "measure", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("version_group", "measure")
    ranked = counted.select(
        "*", F.sum("c").over(w).alias("n"), F.max("value").over(w).alias("top"),
        F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    measure, value = F.col("measure"), F.col("value")

    def total(cond): return F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    def percentile(name, q): return F.min(F.when((measure == name) & (F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))), value)).cast("int")
    def largest(name): return F.max(F.when(measure == name, value)).cast("int")

    hits = measure == "hits"
    return ranked.groupBy("version_group").agg(
        total(hits).alias("searches"), total((measure == "complete") & (value == 1)).alias("provenance_complete"),
        total(hits & (value == 0)).alias("zero_hit"), total((measure == "no_candidates") & (value == 1)).alias("zero_hit_no_candidates"),
        total(hits & (value > 0) & (value < F.col("top"))).alias("partial"), largest("hits").alias("full_length"),
        total(measure == "cold").alias("cold"), percentile("cold", 0.5).alias("cold_p50"),
        total(measure == "warm").alias("warm"), percentile("warm", 0.5).alias("warm_p50"), percentile("warm", 0.9).alias("warm_p90"), largest("warm").alias("warm_max"),
        percentile("output", 0.5).cast("long").alias("output_p50"), percentile("output", 0.9).cast("long").alias("output_p90"), largest("output").cast("long").alias("output_max"),
        total((measure == "output") & (value > PERSIST_THRESHOLD_CHARS)).alias("output_over_threshold"))


def relevance_indicators(items: DataFrame, hits: DataFrame, attributions: DataFrame) -> DataFrame:
    """Expands per kind, and how many documents the lists of two or more hits hold (at most the list length)."""
    found = attributions.filter(F.col("search_id").isNotNull()).groupBy("search_id").agg(
        F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "document").alias("doc"))
    distinct = hits.select("search_id", "document").distinct().groupBy("search_id").agg(F.count("*").alias("docs"))
    per_search = items.join(found, "search_id", "left").join(distinct, "search_id", "left")
    lists = F.col("hit_count") >= 2
    return by_version(per_search).groupBy("version_group").agg(
        F.count("*").alias("searches"), F.count_if(F.col("exact") > 0).alias("searches_with_exact_expand"),
        F.count_if(F.col("doc") > 0).alias("searches_with_document_expand"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_expands"), F.coalesce(F.sum("doc"), F.lit(0)).alias("document_expands"),
        F.count_if(lists).alias("lists_considered"),
        F.median(F.when(lists, F.coalesce("docs", F.lit(0)))).alias("median_distinct_documents"),
        F.count_if(lists & (F.col("docs") == 1)).alias("single_document_lists"),
    )


def exact_rank_counts(items: DataFrame, attributions: DataFrame) -> DataFrame:
    exact = attributions.filter(F.col("kind") == "exact").select("search_id", "hit_rank")
    return by_version(items.select("search_id", "version").join(exact, "search_id")).groupBy("version_group", "hit_rank").agg(
        F.count("*").alias("n"))


def score_profile(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Number and median score at fixed ranks. Scores carry six decimals at most, which bounds the distinct values."""
    ranked = hits.filter(F.col("rank").isin(SCORE_PROFILE_RANKS)).select("search_id", "rank", "score")
    stats = by_version(items.select("search_id", "version").join(ranked, "search_id")).groupBy("version_group", "rank").agg(
        F.count("*").alias("n"), F.round(F.median("score"), 4).alias("median"))
    every = items.select("version").distinct().select(F.explode(version_groups()).alias("version_group")).distinct()
    every = every.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in SCORE_PROFILE_RANKS])))
    return every.join(stats, ["version_group", "rank"], "left").select("version_group", "rank", F.coalesce("n", F.lit(0)).alias("n"), "median")


#: Delimiters that part a path and the texts that name it.
PATH_PARTS = "[^A-Za-z0-9_-]+"


def read_back_commands(commands: DataFrame, readbacks: DataFrame) -> DataFrame:
    """Ids of commands whose saved output is opened later in the same session.

    A read meets only the saved outputs of its session that share a whole part of their path with it, the rarest inner one; paths
    without inner parts meet all reads of their session, which are spread where they are many.
    """
    saved = commands.select("tool_use_id", "session_id", "result_ts", logs.persisted_path(F.col("result_text")).alias("path")).filter(F.col("path").isNotNull())
    saved = heavy.with_anchor(saved, "tool_use_id", F.split("path", PATH_PARTS))
    later = readbacks.select("session_id", F.col("ts").alias("read_ts"), "text")
    parted = later.withColumn("_anchor", heavy.every_anchor(F.split("text", PATH_PARTS)))
    whole = readbacks.select("session_id", F.lit("").alias("_anchor"))
    hits = heavy.spread_join(parted, saved, ["session_id", "_anchor"], ["text", "read_ts"], sketched=whole)
    return hits.filter((F.col("read_ts") > F.col("result_ts")) & F.contains("text", "path")).select("tool_use_id").distinct()


def overflow_indicators(joined: DataFrame, readbacks: DataFrame) -> DataFrame:
    """Per version group: commands, saved outputs, those read back, and the same for one or several searches a command.

    ``joined`` holds one row per search with its call (tool_use_id, session_id, result_ts, result_text) and version.
    """
    commands = joined.groupBy("tool_use_id").agg(
        F.min_by(F.struct("session_id", "result_ts", "result_text"), "search_id").alias("c")).select("tool_use_id", "c.*")
    back = read_back_commands(commands, readbacks).withColumn("back", F.lit(True))
    state = commands.select("tool_use_id", (logs.command_state(F.col("result_text")) == "persisted").alias("persisted"))
    per_command = by_version(joined).groupBy("version_group", "tool_use_id").agg(F.count("*").alias("n"))
    rows = per_command.join(state, "tool_use_id").join(back, "tool_use_id", "left")
    one, many, kept = F.col("n") == 1, F.col("n") > 1, F.col("persisted")
    return rows.groupBy("version_group").agg(
        F.count("*").alias("commands"), F.count_if(kept).alias("persisted"),
        F.count_if(kept & F.coalesce("back", F.lit(False))).alias("read_back"),
        F.count_if(one).alias("single_commands"), F.count_if(kept & one).alias("single_persisted"),
        F.count_if(many).alias("multi_commands"), F.count_if(kept & many).alias("multi_persisted"),
    )


def with_relation(joined: DataFrame, projects: DataFrame) -> DataFrame:
    placed = with_project(joined, projects)
    return placed.withColumn("relation", logs.reference_relation(F.col("collection"), F.col("project")))


def first_per_session(joined: DataFrame, keys: list[str] = ["session_id"]) -> DataFrame:
    """Earliest item of each session; an aggregate, so a long session is combined before the shuffle."""
    rest = [c for c in joined.columns if c not in keys]
    return joined.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts", "search_id")).alias("f")).select(*keys, "f.*")


def reference_reach(related: DataFrame) -> DataFrame:
    """Sessions per version group by the reference collections they used."""
    g = by_version(related)
    per_collection = g.groupBy("version_group", "session_id", "collection").agg(
        F.max(F.col("relation").isNotNull()).alias("any"), F.max(F.coalesce(F.col("relation") == "foreign", F.lit(False))).alias("foreign"),
        F.max(F.coalesce(F.col("relation") == "own", F.lit(False))).alias("own"),
        F.count_if(logs.reference_owner(F.col("collection")).isNotNull()).alias("refs"))
    per_session = per_collection.groupBy("version_group", "session_id").agg(
        F.max("any").alias("any"), F.max("own").alias("own"), F.count_if("foreign").alias("foreign"), F.sum("refs").alias("refs"))
    first = g.groupBy("version_group", "session_id").agg(F.min_by(F.struct("project"), F.struct("ts", "search_id")).alias("f"))
    return per_session.join(first, ["version_group", "session_id"]).groupBy("version_group").agg(
        F.count("*").alias("sessions"), F.count_if("any").alias("with_reference"), F.count_if(F.col("foreign") > 0).alias("with_foreign"),
        F.count_if("own").alias("with_own"), *[F.count_if(F.least("foreign", F.lit(3)) == i).alias(f"foreign_{i}") for i in range(4)],
        F.count_if(F.col("f.project").isNull()).alias("unknown_project_sessions"), F.sum("refs").alias("reference_searches"),
    )


def reference_collections(related: DataFrame) -> DataFrame:
    """Uses and distinct sessions per reference collection; combined per (collection, relation, session) first."""
    per = related.filter(F.col("relation").isNotNull()).groupBy("collection", "relation", "session_id").agg(F.count("*").alias("n"))
    def uses(r): return F.sum(F.when(F.col("relation") == r, F.col("n")).otherwise(0)).alias(r)
    def sessions(r): return F.count_if((F.col("relation") == r) & F.col("session_id").isNotNull()).alias(f"{r}_sessions")
    return per.groupBy("collection").agg(uses("own"), uses("foreign"), uses("unknown_project"), sessions("own"), sessions("foreign"))


def attempts(joined: DataFrame, unjoined: DataFrame, searches: DataFrame) -> DataFrame:
    """One row: attempts, executed with a log row, refused, executed without one, and searches that no call explains."""
    blocked = logs.command_state(F.col("result_text")) == "hook_blocked"
    executed = joined.agg(F.count("*")).scalar()
    lost = searches.join(joined.select("search_id"), "search_id", "left_anti").agg(F.count("*")).scalar()
    u = unjoined.agg(F.count("*").alias("u"), F.count_if(blocked).alias("hook_blocked"))
    return u.select(
        (executed + F.col("u")).alias("attempts"), executed.alias("executed_with_log_row"), "hook_blocked",
        (F.col("u") - F.col("hook_blocked")).alias("executed_without_log_row"), lost.alias("searches_without_call"))


def refusals_by_hook(unjoined: DataFrame) -> DataFrame:
    hook = logs.command_hook(F.col("result_text"))
    return unjoined.withColumn("hook", hook).filter(F.col("hook").isNotNull()).groupBy("hook").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "hook")


def error_summary(errors: DataFrame) -> DataFrame:
    """Counts by code, by server and by both."""
    return errors.groupingSets([["code"], ["server"], ["server", "code"]], "server", "code").agg(F.count("*").alias("n"))


def log_failures(errors: DataFrame) -> DataFrame:
    every = errors.sparkSession.createDataFrame([(c,) for c in LOG_FAILURE_CODES], "code string")
    counts = errors.filter(F.col("code").isin(LOG_FAILURE_CODES)).groupBy("code").agg(F.count("*").alias("c"))
    return every.join(counts, "code", "left").select("code", F.coalesce("c", F.lit(0)).alias("n"))


def last_errors(errors: DataFrame, n: int) -> DataFrame:
    """The n latest, oldest first."""
    return errors.orderBy(F.desc("ts"), F.desc("msg")).limit(n).orderBy("ts", "msg")


def slowest_warm(items: DataFrame, n: int = 5) -> DataFrame:
    return items.filter("NOT cold").select("search_id", "ts", "version", "duration_ms", "collection").orderBy(
        F.desc("duration_ms"), "search_id").limit(n)


def seconds_to_next(joined: DataFrame) -> DataFrame:
    """Seconds to the next strictly later search of the session (null for the last): parallel inside long sessions."""
    at = joined.withColumn("_at", logs.micros(F.col("ts")))
    nxt = ordered.next_later(at, ["session_id"], "_at", DAY_US, "_later")
    return nxt.withColumn("next_gap_s", (F.col("_later") - F.col("_at")) / 1e6).drop("_at", "_later")


def zero_hit_rows(items: DataFrame, joined: DataFrame) -> DataFrame:
    """Searches without hits; ``next_gap`` is seconds, ``none`` for the last of a session, null when no call is known."""
    gaps = seconds_to_next(joined).select("search_id", "next_gap_s", F.lit(True).alias("has_call"))
    gap = F.when(F.col("has_call"), F.coalesce(F.col("next_gap_s").cast("string"), F.lit("none")))
    return items.filter("hit_count = 0").join(gaps, "search_id", "left").select(
        "search_id", "ts", "version", "collection", "document", "candidates", F.left("query", F.lit(60)).alias("query"), gap.alias("next_gap"))


def latency_stats(lat: DataFrame, groups: list[str], value: str, order: list[str]) -> DataFrame:
    """Mean, p50, p95, p99 and max; the first latency counts as cold, the rest as warm."""
    pct = ordered.index_percentiles(lat, groups, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, coarse=F.floor(value))
    cold = lat.groupBy(*groups).agg(F.min_by(value, F.struct(*order)).alias("cold"), F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    mean_warm = F.when(F.col("_n") > 1, (F.col("_sum") - F.col("cold")) / (F.col("_n") - 1)).otherwise(0.0)
    return pct.join(cold, groups).select(
        *groups, "n", (F.col("_sum") / F.col("_n")).alias("mean"), "p50", "p95", "p99", F.col("max_value").alias("max"), "cold",
        mean_warm.alias("mean_warm"))


def printed_sizes(hits: DataFrame, searches: DataFrame, contents: DataFrame) -> DataFrame:
    """Characters and bytes of each result printed on its own: its lines around the content, and the content, which is measured where it
    is read and does not move."""
    measured = contents.select("search_id", "rank", F.length("content").alias("_chars"), F.octet_length("content").alias("_bytes"))
    joined = hits.join(measured.hint("merge"), ["search_id", "rank"]).join(searches.select("search_id", "collection"), "search_id")
    around = logs.render_result(F.lit(1), F.col("score"), F.col("collection"), F.col("document"), F.col("chunk_index"), F.lit(""))
    return joined.select("search_id", "rank", (F.length(around) + F.col("_chars")).alias("chars"), (F.octet_length(around) + F.col("_bytes")).alias("bytes"))


def size_summary(sizes: DataFrame) -> DataFrame:
    """Median, p90 (index form) and max of characters and bytes."""
    long = sizes.select(F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))
    )).alias("s")).select("s.*")
    return ordered.index_percentiles(long, ["unit"], "size", {"median": 0.5, "p90": 0.9})


def overflow_probability(sizes: DataFrame, ks: list[int], chains: list[int], draws: int, limit: int, seed: int) -> DataFrame:
    """Share of bootstrap draws (k results times chain searches, with replacement) above the limit, and median bytes.

    Picks are arithmetic: 48 bits of an MD5 over (seed, k, chain, draw, slot), modulo the number of sizes. Sizes are first
    reduced to their distinct (chars, bytes) pairs, whose cumulative counts turn a pick into an as-of lookup, so the job is
    as large as the number of draws, whatever the length of the log.
    """
    spark = sizes.sparkSession
    pairs = sizes.groupBy("chars", "bytes").agg(F.count("*").alias("c"))
    order = Window.orderBy("chars", "bytes")  # distinct size pairs only
    upto = pairs.withColumn("lo", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    total = sizes.agg(F.count("*")).scalar()
    grid = spark.range(draws).select(F.col("id").alias("draw")).withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("chain", F.explode(F.array(*[F.lit(c) for c in chains])))
    slots = grid.withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("k") * F.col("chain"))))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("k", "chain", "draw", "slot")])
    code = F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("long")
    picks = slots.withColumn("pick", F.pmod(code, total))
    # Pick -> size: as-of lookup of the last pair that starts at or before the pick.
    width = 4096
    sized = ordered.largest_before(picks, upto, [], "pick", "lo", F.struct("lo", "chars", "bytes"), width, "s")
    sums = sized.groupBy("k", "chain", "draw").agg(F.sum("s.chars").alias("chars"), F.sum("s.bytes").alias("bytes"))
    share = sums.groupBy("k", "chain").agg(
        (F.count_if(F.col("chars") > limit) / F.count("*")).alias("p_over_chars"), (F.count_if(F.col("bytes") > limit) / F.count("*")).alias("p_over_bytes"))
    mid = ordered.index_percentiles(sums, ["k", "chain"], "bytes", {"median_bytes": 0.5}).select("k", "chain", "median_bytes")
    return share.join(mid, ["k", "chain"])
