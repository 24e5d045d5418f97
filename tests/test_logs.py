"""Log joins against sequential specifications, and the classifying expressions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sondeo.functions import logs as lf
from sondeo.functions import text
from sondeo.operators import canary, loganalytics as la

BASE = datetime(2024, 1, 1)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def greedy(calls, log):
    """Calls in time order take the earliest unused search of their key inside the window."""
    used, out = set(), {}
    for cid, key, start, end in sorted(calls, key=lambda c: (c[2], c[0])):
        if end is None:
            continue
        for sid, k, t in sorted(log, key=lambda s: (s[2], s[0])):
            if k == key and sid not in used and start - 2 <= t <= end + 2:
                used.add(sid)
                out[cid] = sid
                break
    return out


def test_interval_join_is_greedy_and_one_to_one(spark):
    r = random.Random(11)
    keys = [("q1", "c", None, None), ("q1", "c", "d%", None), (None, None, None, None)]
    calls = []
    for i in range(220):
        start = r.randrange(0, 1500) if i % 3 else r.randrange(0, 200)
        calls.append((i, r.choice(keys), start, None if r.random() < 0.1 else start + r.randrange(0, 9)))
    log = [(f"s{i:03d}", r.choice(keys), r.randrange(0, 1500) if i % 3 else r.randrange(0, 200)) for i in range(260)]
    c = spark.createDataFrame([(i, *k, at(a), at(b) if b is not None else None) for i, k, a, b in calls],
                              "id int, query string, collection string, document string, exclude string, tool_use_ts timestamp, result_ts timestamp")
    s = spark.createDataFrame([(i, *k, at(t)) for i, k, t in log], "search_id string, query string, collection string, document string, exclude string, ts timestamp")
    got = {row.call_id: row.search_id for row in la.join_calls_to_searches(c, s, "id", "id").collect()}
    want = greedy(calls, log)
    assert got == want and len(set(got.values())) == len(got) > 60


def test_one_endless_chain_of_calls_is_streamed(spark):
    n = 100_000
    key = [F.lit("q").alias("query"), F.lit("c").alias("collection"), F.lit(None).cast("string").alias("document"), F.lit(None).cast("string").alias("exclude")]
    c = spark.range(n).select("id", *key, F.timestamp_seconds("id").alias("tool_use_ts"), F.timestamp_seconds("id").alias("result_ts"))
    s = spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("search_id"), *key, F.timestamp_seconds("id").alias("ts"))
    got = la.join_calls_to_searches(c, s, "id", "id")
    assert got.filter(F.col("call_id") == F.col("search_id").cast("long")).count() == got.count() == n


def attribute(expand, searches):
    _, t, coll, doc, chunk = expand
    near = sorted([s for s in searches if s[2] == coll and s[1] <= t <= s[1] + 3600], key=lambda s: (-s[1], s[0]))
    for exact in (True, False):
        for sid, _, _, hits in near:
            for rank, d, c in hits:
                if d == doc and (c == chunk or not exact):
                    return sid, "exact" if exact else "document", rank
    return None, None, None


def test_expands_go_to_the_latest_exact_search(spark):
    r = random.Random(12)
    searches = [(f"s{i:03d}", r.randrange(0, 20000), r.choice(["x", "y", None]), [(k, r.choice("abc"), r.randrange(3)) for k in range(1, 4)]) for i in range(120)]
    expands = [(i, r.randrange(0, 22000), r.choice(["x", "y", None]), r.choice("abcd"), r.randrange(3)) for i in range(200)] + [(900, searches[0][1], searches[0][2], "a", 0)]
    e = spark.createDataFrame([(i, at(t), c, d, k) for i, t, c, d, k in expands], "expand_id int, ts timestamp, collection string, document string, chunk_index int")
    s = spark.createDataFrame([(i, at(t), c) for i, t, c, _ in searches], "search_id string, ts timestamp, collection string")
    h = spark.createDataFrame([(i, k, d, c) for i, _, _, hs in searches for k, d, c in hs], "search_id string, rank int, document string, chunk_index int")
    got = {row.expand_id: (row.search_id, row.kind, row.hit_rank) for row in la.attribute_expands(e, s, h).collect()}
    assert got == {x[0]: attribute(x, searches) for x in expands}


def test_command_match_takes_the_first_within_the_window(spark):
    s = spark.createDataFrame([("s1", "col", "find the thing", at(1000)), ("s2", "col", "other", at(1000))], "search_id string, collection string, query string, ts timestamp")
    c = spark.createDataFrame([(3, 'find the thing col', at(1119)), (2, 'find the thing col', at(880)), (1, 'find the thing col', at(1120)), (0, "find the thing", at(1000))], "n int, command string, ts timestamp")
    got = la.match_commands(s, c, "n").collect()
    assert [(r.search_id, r.n) for r in got] == [("s1", 3)]  # exactly 120 s is too far, and a command must name the collection


def test_command_results(spark):
    cases = {
        "PreToolUse hook error: [python3 /a/b/block_x.py]: Refused\nmore": ("hook_blocked", "block_x.py: Refused", None, None),
        "y" * 295 + "hook error: [zz": ("executed", None, None, None),
        "hook error without a bracket": ("hook_blocked", "hook error without a bracket", None, None),
        "<persisted-output>\nOutput too large (42.1KB). Full output saved to: /p/q.txt\n": ("persisted", None, "/p/q.txt", 42.1),
        "<persisted-output> odd": ("persisted", None, None, None),
        "fine": ("executed", None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    t = F.col("t")
    for row in df.select("t", lf.command_state(t).alias("s"), lf.command_hook(t).alias("h"), lf.persisted_path(t).alias("p"), lf.persisted_kb(t).alias("k")).collect():
        assert (row.s, row.h, row.p, row.k) == cases[row.t]


def test_small_expressions(spark):
    one = spark.range(1)
    def value(col): return one.select(col.alias("v")).first().v
    assert value(lf.quantization(F.lit("Qwen3-Embedding-8B-q8_0"))) == "Q8_0" and value(lf.quantization(F.lit("plain"))) is None
    assert value(text.first_line(F.lit(" \n a b \n c"))) == "a b " and value(text.first_line(F.lit("\n "))) == "(empty result)"
    assert [value(text.stem(F.lit(w))) for w in ("studies", "boxes", "class", "running", "tested", "volatility", "is")] == ["study", "box", "class", "runn", "test", "volatil", "is"]
    assert value(text.leading_clause(F.lit("How so, and why"))) == "How so" and value(text.leading_clause(F.lit("Plain text?! "))) == "Plain text"
    assert value(text.word_aligned_tail(F.lit("alpha beta gamma"), 8)) == "gamma" and value(text.word_aligned_tail(F.lit("ab cd "), 3)) == "cd "
    assert value(lf.micros(lf.parse_utc(F.lit("2026-09-20T17:11:17.256Z")))) == value(lf.micros(lf.parse_utc(F.lit("2026-09-20T19:11:17.256+02:00"))))
    assert value(text.normalize_ws(F.lit("  a \n b "))) == "a b"


def test_fingerprint_equals_sorted_json(spark):
    import hashlib
    import json
    fields = {"b": 3, "a": 'quote " and \n ü 日 \U0001f600\x7f', "c": None}
    want = hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:16]
    cols = {"b": (F.lit(3), False), "a": (F.lit(fields["a"]), True), "c": (F.lit(None).cast("string"), True)}
    assert spark.range(1).select(lf.config_fingerprint(cols).alias("f")).first().f == want


def test_cold_start_bounds(spark):
    log = spark.createDataFrame([("a", at(100), 2000), ("b", at(200), 2000)], "search_id string, ts timestamp, duration_ms int")
    starts = spark.createDataFrame([(at(97),), (at(196),)], "ts timestamp")
    got = {r.search_id: r.cold for r in la.with_cold_start(log, starts).collect()}
    assert got == {"a": True, "b": False}


def test_latency_statistics(spark):
    values = [5.5, 1.25, 9.0, 3.0, 7.75]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "mode string, n int, ms double")
    r = la.latency_stats(df, ["mode"], "ms", ["n"]).first()
    assert (r.p50, r.p95, r.p99, r.max, r.cold, r.mean_warm) == (5.5, 9.0, 9.0, 9.0, 5.5, sum(values[1:]) / 4)


def test_canary_changes(spark):
    schema = "name string, status string, rank int, result_count int"
    before = spark.createDataFrame([("a", "FAIL", None, 3), ("b", "PASS", 1, 3), ("c", "PASS", 1, 3), ("d", "PASS", None, 0), ("gone", "PASS", 1, 1)], schema)
    now = spark.createDataFrame([("a", "PASS", 2, 3), ("b", "ERROR", None, None), ("c", "PASS", 2, 3), ("d", "PASS", None, 0), ("n", "PASS", 1, 3)], schema)
    got = {r["name"]: r.change for r in canary.compare_runs(before, now).collect()}
    assert got == {"a": "fixed", "b": "regressed", "c": "rank moved", "d": "unchanged", "n": "new case"}


def _listed(spark, n):
    """Searches with three hits and contents each; the last content of every tenth search is null."""
    searches = spark.range(n).select(F.format_string("s%03d", "id").alias("search_id"), F.lit("col").alias("collection"))
    hits = searches.select("search_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).select(
        "search_id", "rank", F.lit("dö").alias("document"), F.lit(2).alias("chunk_index"), (1 - F.col("rank") / 8).alias("score"))
    body = F.when((F.col("rank") == 3) & (F.substring("search_id", 4, 1) == "0"), None).otherwise(F.repeat(F.lit("ö "), 10 * F.col("rank")))
    return searches, hits, hits.select("search_id", "rank", body.alias("content"))


def test_printed_sizes_count_the_text_around_the_content(spark):
    searches, hits, contents = _listed(spark, 10)
    around = lambda rank, score: len(f"--- Result {rank} (score: {score}) ---\nCollection: col | Document: dö | Chunk: 2\n\n")
    whole = {(r.search_id, r.rank): (r.chars, r.bytes) for r in la.printed_sizes(hits, searches, contents).collect()}
    assert whole["s001", 3] == (around(1, 0.625) + 60, around(1, 0.625) + 1 + 90)
    assert whole["s000", 3] == (None, None) and len(whole) == 30
    sums = {r.search_id: r.output_chars for r in la.output_sizes(searches, hits, contents).collect()}
    scores = {1: 0.875, 2: 0.75, 3: 0.625}
    assert sums["s001"] == sum(around(r, s) + 20 * r for r, s in scores.items()) + 2
    assert sums["s000"] == sum(around(r, scores[r]) + 20 * r for r in (1, 2)) + 2


def test_contents_are_not_gathered_on_the_driver(spark):
    """A table of texts looks small to the planner where they are made from short columns; it must not be broadcast, nor texts shuffled for a size."""
    searches, hits, contents = _listed(spark, 10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = la.hit_contents(hits, contents)
    assert joined.filter("length(content) = 20 * rank").count() == 29
    assert "Broadcast" not in plan(joined)
    shuffled = lambda df: [line for line in plan(df).splitlines() if "Exchange" in line or "Sort [" in line]
    for df in (la.output_sizes(searches, hits, contents), la.printed_sizes(hits, searches, contents)):
        text = plan(df)
        joins = [line for line in text.splitlines() if "Join" in line]
        assert any("SortMergeJoin" in j and "rank" in j or "pos" in j and "SortMergeJoin" in j for j in joins), joins
        assert not any("content" in line for line in shuffled(df))
