"""Heavy keys are found and spread; anchors propose every container."""

import random

from pyspark.sql import functions as F

from sondeo.functions import heavy
from sondeo.operators import chunking, segments


def test_only_heavy_keys_get_salts(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "all").when(F.col("id") % 10 == 1, "some").otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id")
    found = dict(heavy.heavy_keys(rows, ["k"], tasks=20))
    named = {r.k: found.get(r.h) for r in rows.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert (named.pop("all"), named.pop("some")) == (10, 2) and set(named.values()) == {None}


def test_a_common_ngram_is_spread_over_the_tasks(spark):
    """Half of all rows hold one key: joined rows of it come from many partitions, and the join is the plain one."""
    left = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 500).alias("k"), "id")
    right = spark.createDataFrame([(-1, "x"), (-1, "y"), (7, "z"), (9_999, "no")], "k long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for how in ("inner", "left"):
            got = heavy.spread_join(left, right, ["k"], ["id"], how, tasks=16)
            plain = left.join(right, "k", how)
            assert got.exceptAll(plain.select(got.columns)).isEmpty() and plain.select(got.columns).exceptAll(got).isEmpty()
        got = heavy.spread_join(left, right, ["k"], ["id"], tasks=16)
        assert got.where("k = -1").select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_leakage_with_one_ngram_in_every_text(spark):
    common = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    passages = spark.createDataFrame([(i, f"{common} extra{i}") for i in range(300)] + [(999, "nothing shared here")], "passage_id long, text string")
    summaries = spark.createDataFrame([(1, common), (2, "other words entirely different from these")], "summary_id long, text string")
    rows = segments.corpus_leakage(passages, summaries).collect()
    assert {(r.summary_id, r.passage_id) for r in rows} == {(1, i) for i in range(300)} and len({r.shared for r in rows}) == 1


def test_quotes_are_found_wherever_they_stand(spark):
    r = random.Random(4)
    texts = {("c", f"d{d}", i): " ".join(r.choice(["a", "b", "of", "x%d" % r.randint(0, 30)]) for _ in range(r.randint(1, 12))) for d in range(3) for i in range(12)}
    chunks = spark.createDataFrame([(*k, t) for k, t in texts.items()], "collection string, document string, chunk_index int, content string")
    quotes = []
    for q in range(300):
        d = f"d{r.randint(0, 3)}"
        whole = " ".join(texts.get(("c", d, i), "zz") for i in range(12))
        at = r.randint(0, max(0, len(whole) - 2))
        quotes.append((q, "c", d, r.randint(0, 11), whole[at:at + r.randint(1, 40)].replace(" ", r.choice([" ", "  "]))))
    got = {row.quote_id: row for row in chunking.quote_coverage(spark.createDataFrame(quotes, "quote_id long, collection string, document string, chunk_index int, quote string"), chunks).collect()}
    for q, c, d, expected, quote in quotes:
        flat = " ".join(quote.split())
        own = [i for i in range(12) if (c, d, i) in texts]
        single = [i for i in own if flat in " ".join(texts[(c, d, i)].split())]
        both = [i for i in own if (c, d, i + 1) in texts and flat in " ".join((texts[(c, d, i)] + " " + texts[(c, d, i + 1)]).split())]
        row = got[q]
        assert row.status == ("single" if single else "boundary" if both else "missing") and row.doc_found == bool(own)
        assert row.matched_chunk_index == (min(single) if single else min(both) if both else None)


def test_patterns_of_one_key_are_found_in_one_pass(spark):
    r = random.Random(6)
    texts = [(i, i % 3, "".join(r.choice("abc") for _ in range(r.randint(0, 12)))) for i in range(400)] + [(900, 0, None), (901, 0, "")]
    patterns = [(i % 3, "".join(r.choice("abc") for _ in range(r.randint(0, 4))), i) for i in range(60)] + [(1, None, 99), (1, "ab", 100), (1, "ab", 101), (7, "a", 102)]
    t = spark.createDataFrame(texts, "id long, k long, text string")
    p = spark.createDataFrame(patterns, "k long, pattern string, n long")
    for tasks in (4, 40):
        got = sorted((row.id, row.n) for row in heavy.containing(t, p, ["k"], "text", "pattern", ["id"], tasks).collect())
        assert got == sorted((i, n) for i, k, text in texts for key, pattern, n in patterns if k == key and text is not None and pattern is not None and pattern in text)


def test_many_patterns_and_texts_of_one_key(spark):
    """30,000 patterns and 30,000 texts share a key: 9 * 10^8 pairs, of which 30,000 match."""
    numbered = spark.range(30_000).select(F.lit(1).alias("k"), "id", F.concat(F.lit("find <"), "id", F.lit("> in it")).alias("text"))
    patterns = spark.range(30_000).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.concat(F.lit("<"), "id", F.lit(">")).alias("pattern"))
    got = heavy.containing(numbered, patterns, ["k"], "text", "pattern", ["id"])
    assert got.agg(F.count("*"), F.count_if(F.col("id") == F.col("n"))).first() == (30_000, 30_000)
