"""Dense, sparse and lexical search against brute force; both ways of meeting queries and chunks."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondeo.catalog import evaluation as catalog
from sondeo.models import encoders
from sondeo.operators import evaluation, fusion, postings, retrieval
from sondeo.plans import modes


def _vectors(n, dims, seed):
    r = random.Random(seed)
    rows = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(dims)] for _ in range(n)]
    rows[3] = rows[4] = rows[5] = rows[2]  # copies: ties are broken by key
    return rows


def _brute(queries, chunks, k, allowed=lambda q, c: True):
    out = {}
    for qid, qv in queries:
        scored = []
        for key, cv in chunks:
            if allowed(qid, key):
                qa, ca = np.array(qv), np.array(cv, dtype=np.float32).astype(float)
                norm = np.linalg.norm(qa) * np.linalg.norm(ca)
                scored.append((-round(float(qa @ ca / norm), 9) if norm else 0.0, key))
        out[qid] = [(key, round(-s, 4)) for s, key in sorted(scored)[:k]]
    return out


def _frames(spark, dims=4):
    qs = list(enumerate(_vectors(9, dims, 1)))
    cs = [((f"c{i % 3}", f"d{i % 5}", i), v) for i, v in enumerate(_vectors(60, dims, 2))]
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>")
    c = spark.createDataFrame([(*k, v) for k, v in cs], "collection string, document string, chunk_index int, embedding array<float>").repartition(5)
    return qs, cs, q, c


def _collect(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(((r.collection, r.document, r.chunk_index), r.score + 0.0))
    return got


def test_shipped_and_blockwise_search_equal_brute_force(spark, monkeypatch):
    qs, cs, q, c = _frames(spark)
    want = _brute(qs, cs, 7)
    assert _collect(retrieval.dense_top_k(q, c, 7)) == want
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(retrieval, "SHARD_CHUNKS", 11)
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 10)
    assert _collect(retrieval.dense_top_k(q, c, 7, max_shipped_bytes=0)) == want


def test_filters_per_query(spark):
    qs, cs, q, c = _frames(spark)
    filtered = q.withColumn("filter_collection", F.when(F.col("query_id") > 0, F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")))).withColumn(
        "filter_document", F.when(F.col("query_id") % 2 == 0, "d%")).withColumn("filter_exclude", F.when(F.col("query_id") % 4 == 1, "d_"))

    def allowed(qid, key):
        if qid > 0 and key[0] != f"c{qid % 3}":
            return False
        return True  # "d%" takes all in; "d_" holds no % and so equals no document

    assert _collect(retrieval.dense_top_k(filtered, c, 7)) == _brute(qs, cs, 7, allowed)


def test_vectors_of_another_length_stop_the_search(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([("c", "d", 0, [1.0, 0.0, 0.0]), ("c", "d", 1, [1.0] * 5), ("c", "e", 0, None)], "collection string, document string, chunk_index int, embedding array<float>")
    with pytest.raises(Exception, match="another length"):
        retrieval.dense_top_k(q, c, 3).collect()
    assert len(retrieval.dense_top_k(q, c.filter("chunk_index = 0"), 3).collect()) == 1


def test_sweep_refuses_modes_it_does_not_know():
    with pytest.raises(ValueError, match="sideways"):
        modes.sweep({}, [{"mode": "sideways+rerank", "top_k": 1}])
    with pytest.raises(ValueError, match="scorer"):
        modes.sweep({}, [{"mode": "dense+rerank", "top_k": 1}])


def test_sweep_reranks_as_deep_as_each_cell_says(spark):
    dense = _list(spark, [(1, i, f"d{i:02d}", 1 - i / 100) for i in range(1, 51)])
    cells = modes.grid({"mode": ["dense", "dense+rerank"], "rerank_candidates": [20, 50]}, {"top_k": 3, "score_threshold": 0.0})
    hits = modes.sweep({"dense": dense}, cells, lambda h: h.withColumn("relevance", F.col("rank") / 100))
    got = {}
    for r in hits.orderBy("cell", "rank").collect():
        got.setdefault(r.cell, []).append(r.document)
    assert got == {0: ["d01", "d02", "d03"], 1: ["d01", "d02", "d03"], 2: ["d20", "d19", "d18"], 3: ["d50", "d49", "d48"]}


@pytest.mark.parametrize("shipped", [retrieval.MAX_SHIPPED_BYTES, 0])
def test_all_vector_lengths_in_one_pass(spark, shipped):
    _, _, q, c = _frames(spark)
    both = retrieval.dense_top_k(q, c, 5, shipped, dims=[2, 3])
    for dim in (2, 3):
        alone = retrieval.dense_top_k(q.withColumn("embedding", F.slice("embedding", 1, dim)), c.withColumn("embedding", F.slice("embedding", 1, dim)), 5)
        assert _collect(both.filter(F.col("dim") == dim)) == _collect(alone)


def test_empty_query_table(spark):
    _, _, q, c = _frames(spark)
    assert retrieval.dense_top_k(q.limit(0), c, 3).count() == 0


def test_sparse_cosine(spark):
    chunks = {("c", "d", 0): {1: 1.0, 2: 2.0}, ("c", "d", 1): {2: 1.0}, ("c", "d", 2): {9: 1.0}}
    query = {1: 1.0, 2: 1.0}
    c = spark.createDataFrame([(*k, d, w) for k, v in chunks.items() for d, w in v.items()], "collection string, document string, chunk_index int, dim int, weight double")
    q = spark.createDataFrame([(5, d, w) for d, w in query.items()], "query_id long, dim int, weight double")
    got = _collect(retrieval.sparse_top_k(q, c, 5))[5]
    assert got == [(("c", "d", 0), round(3 / math.sqrt(10), 4)), (("c", "d", 1), round(1 / math.sqrt(2), 4))]


def test_lexical_needs_all_words_and_falls_back(spark):
    c = spark.createDataFrame([("c", "d", i, t) for i, t in enumerate(["red fox", "red hen runs", "blue fox fox"])], "collection string, document string, chunk_index int, content string")
    q = spark.createDataFrame([(1, "Red fox"), (2, "hen fox"), (3, "absent"), (4, "fox absent")], "query_id long, query string")
    got = _collect(retrieval.lexical_top_k(q, c, 10))
    assert [k[2] for k, _ in got[1]] == [0]
    assert {k[2] for k, _ in got[2]} == {0, 1, 2}
    assert 3 not in got
    assert [k[2] for k, _ in got[4]] == [2, 0]


def _list(spark, rows):
    return spark.createDataFrame([(q, r, "c", d, 0, s) for q, r, d, s in rows], "query_id long, rank int, collection string, document string, chunk_index int, score double")


def test_fusion_rules(spark):
    dense = _list(spark, [(1, 1, "a", 0.8), (1, 2, "b", 0.4), (2, 1, "a", -0.1)])
    sparse = _list(spark, [(1, 1, "b", 0.5), (1, 2, "z", 0.25), (2, 1, "b", 0.5)])
    rrf = {(r.query_id, r.document): (r.rank, r.score) for r in fusion.reciprocal_rank(dense, sparse).collect()}
    assert rrf[(1, "b")] == (1, round(1 / 62 + 1 / 61, 6)) and rrf[(1, "a")] == (2, round(1 / 61, 6))
    assert rrf[(2, "a")] == (1, round(1 / 61, 6)) and rrf[(2, "b")] == (2, round(1 / 61, 6))  # tie: dense first
    cc = {(r.query_id, r.document): r.score for r in fusion.convex(dense, sparse, 0.8).collect()}
    assert cc[(1, "a")] == 0.8 and cc[(1, "b")] == 0.6 and cc[(1, "z")] == 0.1
    assert (2, "a") not in cc and cc[(2, "b")] == 0.2  # a list without a positive score does not count


def test_rerank_depth_is_capped_and_scores_rounded(spark):
    dense = _list(spark, [(1, i, f"d{i:03d}", 1 - i / 100) for i in range(1, 51)])
    hits = modes.retrieve("dense+rerank-0.6b", {"dense": dense}, 4, rerank_candidates=90, score_pairs=lambda h: h.withColumn("relevance", F.col("rank") / 7))
    assert [(r.rank, r.document, r.score) for r in hits.orderBy("rank").collect()] == [(i + 1, f"d{50 - i:03d}", round((50 - i) / 7, 6)) for i in range(4)]


def test_rank_metrics_with_duplicates_and_empty_lists(spark):
    hits = _list(spark, [(1, 1, "x", 1.0), (1, 2, "a", 0.9), (1, 3, "b", 0.8)])
    expected = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "b", 0), (2, "q", 0)], "query_id long, document string, chunk_index int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in evaluation.rank_metrics(queries, hits, expected, 3).collect()}
    gain = 1 / math.log2(3) + 1 / math.log2(4)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert abs(got[1].ndcg - gain / ideal) < 1e-12 and got[1].mrr == 0.5 and abs(got[1].recall - 2 / 3) < 1e-12
    assert (got[2].ndcg, got[2].mrr, got[2].recall) == (0.0, 0.0, 0.0) and got[3].recall == 0.0


def test_snippets_ignore_letter_case(spark):
    hits = _list(spark, [(1, 1, "x", 1.0), (1, 2, "a", 0.9)]).withColumn("content", F.when(F.col("rank") == 2, "The Quick fox").otherwise("none"))
    quotes = spark.createDataFrame([(1, 0, "quick FOX"), (1, 1, "missing")], "query_id long, pos int, quote string")
    assert {(r.pos, r.rank, r.found) for r in evaluation.snippet_match(quotes, hits).collect()} == {(0, 2, True), (1, None, False)}


@pytest.mark.parametrize("sent, rows", [(evaluation.MAX_SENT_BYTES, evaluation.PACKED_ROWS), (600, 5)])
def test_quotes_meet_the_lists_of_all_cells_at_once(spark, monkeypatch, sent, rows):
    """Against plain Python: repeated, far and null positions, null and empty quotes, texts side by side, cells without lists, more cells than a word has bits."""
    monkeypatch.setattr(evaluation, "MAX_SENT_BYTES", sent)
    monkeypatch.setattr(evaluation, "PACKED_ROWS", rows)
    r, cells = random.Random(11), 70
    text = lambda n: "".join(r.choice("aBä") for _ in range(r.randint(0, n)))
    hits = [(r.randrange(0, cells, 3), q, rank, text(6)) for q in range(6) for rank in range(1, 9)]
    hits += [hits[0], (3, 0, 9, None), (3, None, 1, "ab"), (6, 9, 1, "unasked"), (9, 1, None, "zz")]
    place = lambda: r.choice([None, -3, 0, 1, 2, 2**20 - 1, 2**20, 2**20 + 1, 2**40 + 5, *range(10, 30)])
    quotes = [(q, place(), r.choice([None, "", text(3), text(3)])) for q in (0, 1, 2, 3, 4, 7) for _ in range(40)] + [(1, 500, "zZ")]
    listed = spark.createDataFrame([(c, q, k, f"t{i}", t) for i, (c, q, k, t) in enumerate(hits)], "cell long, query_id long, rank int, document string, content string")
    asked = spark.createDataFrame(quotes, "query_id long, pos long, quote string")
    matches = evaluation.snippet_match(asked, listed, ["cell", "query_id"], cells)
    ranks = {}
    for c, q, k, t in hits:
        if t is not None and k is not None:
            ranks.setdefault((q, t.lower()), set()).add((c, k))
    at = lambda q, quote: sorted(p for (x, t), found in ranks.items() if x == q and quote is not None and quote.lower() in t for p in found)
    got = [(m.query_id, m.pos, sorted((p >> evaluation.RANK_BITS, p & (2**evaluation.RANK_BITS - 1)) for p in m.places)) for m in matches.collect()]
    assert sorted(got, key=str) == sorted([(q, p, at(q, quote)) for q, p, quote in quotes], key=str)
    share = {(m.cell, m.query_id): m.share for m in evaluation.found_share(matches, "share", ["cell", "query_id"], cells).collect()}
    each = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("cell", F.col("cell").cast("long"))
    plain = evaluation.found_share(evaluation.snippet_match(each, listed, ["cell", "query_id"]), "share", ["cell", "query_id"]).collect()
    assert len(plain) == 6 * cells and share == {(m.cell, m.query_id): m.share for m in plain}


def test_shares_of_cells_without_quotes_or_lists(spark):
    hits = spark.createDataFrame([], "cell long, query_id long, rank int, content string")
    quotes = spark.createDataFrame([(1, 0, "a")], "query_id long, pos long, quote string")
    share = lambda q: sorted(map(tuple, evaluation.found_share(evaluation.snippet_match(q, hits, cells=2), "share", cells=2).collect()))
    assert share(quotes) == [(0, 1, 0.0), (1, 1, 0.0)] and share(quotes.limit(0)) == []


def test_sweep_fuses_once_for_each_value(spark, monkeypatch):
    """Cells of other depths share a fused list; each equals the mode run alone."""
    _, _, q, c = _frames(spark)
    lists = {"dense": retrieval.dense_top_k(q, c, 9), "sparse": retrieval.dense_top_k(q, c.filter("chunk_index % 2 = 0"), 6)}
    cells = modes.grid({"mode": ["hybrid", "cc"], "top_k": [2, 5], "alpha": [0.5, 0.8], "rrf_k": [60]}, {"score_threshold": 0.0})
    alone = {x["cell"]: sorted(map(tuple, modes.retrieve(x["mode"], lists, x["top_k"], x["alpha"], x["rrf_k"]).collect())) for x in cells}
    fused = []
    for name in ("reciprocal_rank", "convex"):
        monkeypatch.setattr(fusion, name, lambda dense, *given, f=getattr(fusion, name): fused.append(dense.count()) or f(dense, *given))
    hits = modes.sweep(lists, cells).collect()
    assert {k: sorted((h.query_id, h.rank, h.collection, h.document, h.chunk_index, h.score) for h in hits if h.cell == k) for k in alone} == alone
    assert fused == [9 * 9, 2 * 9 * 9]


def test_rows_get_the_number_of_their_cell(spark):
    rows = spark.createDataFrame([("dense", 8, 1), ("hybrid", 64, 2), ("dense", 9, 3), (None, 8, 4)], "mode string, dim int, query_id long")
    cells = modes.grid({"mode": ["dense", "hybrid"], "dim": [8, 64]}, {})
    assert sorted((r.cell, r.query_id) for r in modes.numbered(rows, cells, ["mode", "dim"]).collect()) == [(0, 1), (3, 2)]


def test_dimension_sweep_takes_each_quote_once(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.125) for _ in range(64)], i % 3) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    given, plain = [], evaluation.snippet_match
    monkeypatch.setattr(evaluation, "snippet_match", lambda quotes, *rest: given.append(quotes.count()) or plain(quotes, *rest))
    got = {(x.mode, x.dim): x for x in catalog.r10c(spark, str(tmp_path)).collect()}
    keys, cells = ["mode", "dim", "query_id"], modes.grid({"mode": ["dense", "hybrid"], "dim": catalog.DIMS}, {})
    each = modes.with_cells(catalog.quotes(spark, str(tmp_path)), cells, ["mode", "dim"]).withColumn("dim", F.col("dim").cast("int"))
    hits = catalog.with_content(spark, str(tmp_path), catalog.dimension_hits(spark, str(tmp_path)))
    shares = evaluation.found_share(plain(each, hits, keys), "snippet_recall", keys).collect()
    assert given == [catalog.quotes(spark, str(tmp_path)).count()] and len(got) == 8
    for (mode, dim), x in got.items():
        mine = [s.snippet_recall for s in shares if (s.mode, s.dim) == (mode, dim)]
        assert len(mine) == x.queries and abs(sum(mine) / len(mine) - x.snippet_recall) < 1e-6
        assert (x.full_snippet_match, x.zero_snippet_match) == (mine.count(1.0), mine.count(0.0))


def test_encoder_batches_and_prefix(spark):
    seen = []

    def load():
        def encode(texts):
            assert len(texts) <= 2
            return [[float(len(t))] for t in texts]
        return encode

    df = spark.createDataFrame([("x" * n,) for n in (1, 2, 20000)], "t string").coalesce(1)
    got = sorted(r.embedding[0] for r in encoders.embed(df, "t", load, "ab", 2).collect())
    assert got == [3.0, 4.0, 20002.0]
    cut = sorted(r.embedding[0] for r in encoders.embed(df, "t", load, "ab", 2, limited=True).collect())
    assert cut == [3.0, 4.0, 12002.0]


def test_sparse_encoding_keeps_256_dimensions(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(2000)))], "id long, t string")
    rows = encoders.sparse_encode(df, ["id"], "t", 256).collect()
    assert len(rows) == 256 and all(r.weight >= round(math.log(2), 6) for r in rows)
    assert len(encoders.as_map(encoders.sparse_encode(df, ["id"], "t", 256), ["id"]).first().sparse_embedding) == 256


def _worded(n=700):
    words = [f"w{k}" for k in range(40)]
    # "every" is in all chunks, "half" in every second one; the others thin out.
    return [" ".join(["every"] + ["half"] * (i % 2) + [w for j, w in enumerate(words) if (i * 7 + j * j) % (j + 2) == 0] * (1 + i % 3)) for i in range(n)]


def _bm25(texts, query, k):
    docs = [t.split() for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    asked = list(dict.fromkeys(query.lower().split()))
    idf = {w: math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) for w in asked if (df := sum(w in d for d in docs))}
    scored = []
    for i, d in enumerate(docs):
        here = [w for w in idf if w in d]
        if here:
            score = sum(idf[w] * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in here)
            scored.append((len(here) < len(asked), -round(score, 9), i))
    scored.sort()
    if scored and not scored[0][0]:
        scored = [s for s in scored if not s[0]]
    return [(i, round(-s, 4)) for _, s, i in scored[:k]]


@pytest.mark.parametrize("shard, block, sent", [(postings.SHARD_CHUNKS, postings.BLOCK_QUERIES, postings.MAX_SENT), (150, 2, 0)])
def test_postings_equal_a_full_scan(spark, monkeypatch, shard, block, sent):
    """Small shards, blocks of two queries and shuffled terms give the same; so do a pruned and a full search."""
    for name, value in (("SHARD_CHUNKS", shard), ("BLOCK_QUERIES", block), ("MAX_SENT", sent), ("FIRST_RANGES", 1)):
        monkeypatch.setattr(postings, name, value)
    texts = _worded()
    c = spark.createDataFrame([("c", "d", i, t) for i, t in enumerate(texts)] + [("c", "e", 0, None), ("c", "e", 1, "")],
                              "collection string, document string, chunk_index int, content string").repartition(3)
    asked = {1: "every", 2: "every half w3", 3: "w1 w2 w3 w4 w5", 4: "w39 absent", 5: "every absent", 6: "half w17 w31 w38", 7: "absent"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    store = retrieval.kept_store(retrieval.lexical_store(c))
    got = _collect(retrieval.lexical_top_k(q, None, 10, store))
    want = {i: _bm25([*texts, "", ""], t, 10) for i, t in asked.items()}
    assert {i: [(key[2], score) for key, score in hits] for i, hits in got.items()} == {i: w for i, w in want.items() if w}


def test_a_pruned_search_skips_ranges():
    """Most ranges promise less than the tenth best score and are never scored."""
    table = pa.table({"document": [f"d{i:06d}" for i in range(100_000)],
                      "_terms": pa.array([["often"] + ["rare"] * 30 * (i // 1000 == 37) for i in range(100_000)], pa.list_(pa.string()))})
    rows = pa.Table.from_batches(list(postings._inverted(table, ["document"], 0, None)))
    rows = rows.append_column("queries", pa.array([[]] * rows.num_rows, pa.list_(pa.int64())))
    shard = postings.Shard(rows, postings.Saturation(1.2, 0.75, 1.0))
    scored = []
    zeros = np.zeros
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(postings.np, "zeros", lambda n, *a: (scored.append(n), zeros(n, *a))[1])
        found, _ = shard.with_any(["often", "rare"], [0.1, 5.0], 10)
    assert sorted(found.tolist()) == list(range(37_000, 37_010)) and sum(n for n in scored if n >= postings.RANGE * 8) <= 2 * 16 * postings.RANGE


def test_sparse_store_of_texts(spark):
    """The store made from texts answers like the one made from their vectors."""
    c = spark.createDataFrame([("c", "d", i, t) for i, t in enumerate(_worded(200))], "collection string, document string, chunk_index int, content string")
    q = spark.createDataFrame([(1, "every w3 w3 w9"), (2, "half w30")], "query_id long, query string")
    asked = encoders.sparse_encode(q, ["query_id"], "query", 3)
    store = retrieval.kept_store(encoders.sparse_store(c, retrieval.KEY, "content", 3))
    assert _collect(retrieval.sparse_top_k(asked, None, 7, store)) == _collect(retrieval.sparse_top_k(asked, encoders.sparse_encode(c, retrieval.KEY, "content", 3), 7))


def test_shards_of_one_large_batch_are_bounded(spark, monkeypatch):
    """A batch of many long texts is cut by its terms, not only by its rows."""
    monkeypatch.setattr(postings, "SHARD_TERMS", 100)
    lists = [["w"] * n for n in (60, 40, 1, 250, 30, 30, 30, 30)] + [None, []]
    batch = pa.RecordBatch.from_pydict({"_terms": pa.array(lists, pa.list_(pa.string()))})
    cut = list(postings._portions(batch))
    assert [(part.num_rows, n) for part, n in cut] == [(2, 100), (1, 1), (1, 250), (3, 90), (3, 30)]
    assert pa.Table.from_batches([part for part, _ in cut]).column("_terms").to_pylist() == lists


def test_only_expected_chunks_that_are_listed_are_shuffled(spark):
    """The distinct expected rows of a query are never gathered; equal results for both ways of sending the listed ones."""
    queries = spark.range(20).withColumnRenamed("id", "query_id")
    expected = queries.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.lit(499)))).select("query_id", F.lit("d").alias("document"), "chunk_index")
    hits = queries.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("query_id", "rank", F.lit("d").alias("document"), (F.col("rank") * 200).alias("chunk_index"))
    got = evaluation.rank_metrics(queries, hits, expected, 4)
    rows = got.collect()
    assert len(rows) == 20 and all(r.mrr == 1.0 and abs(r.recall - 2 / 500) < 1e-12 for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan


def _ranked_block(qv, cv, k, batch=500):
    n = len(qv)
    asked = pa.table({"query_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(qv), pa.list_(pa.float64())), **{f: pa.nulls(n, pa.string()) for f in retrieval.FILTERS}})
    rows = pa.table({"collection": ["c"] * len(cv), "document": [f"d{i:06d}" for i in range(len(cv))], "chunk_index": pa.array([0] * len(cv), pa.int32()), "embedding": pa.array(list(cv), pa.list_(pa.float32()))})
    block, batches = retrieval._QueryBlock(asked, [None]), rows.to_batches(max_chunksize=batch)
    tracemalloc.start()
    out = pa.Table.from_batches(block.best(iter(batches), k))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for q, d, s in zip(*(out.column(c).to_pylist() for c in ("query_id", "document", "raw"))):
        got.setdefault(q, []).append((-s, int(d[1:])))
    return {q: sorted(x) for q, x in got.items()}, peak


def test_lists_of_many_queries_are_held_in_arrays(monkeypatch):
    """2,000 lists of 50 take some MB, not an object for each entry; equal to all scores sorted."""
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 2**15)
    monkeypatch.setattr(retrieval, "SPARE_KEYS", 100)
    r = np.random.default_rng(3)
    qv, cv = r.normal(size=(2000, 8)), r.normal(size=(3000, 8)).astype(np.float32)
    got, peak = _ranked_block(qv, cv, 50)
    unit = cv.astype(float) / np.linalg.norm(cv.astype(float), axis=1, keepdims=True)
    for q in range(0, 2000, 191):
        scores = np.round(unit @ (qv[q] / np.linalg.norm(qv[q])), 9)
        assert [i for _, i in got[q]] == np.lexsort((np.arange(3000), -scores))[:50].tolist()
    assert peak < 16e6


def test_many_copies_keep_the_first_keys():
    r = np.random.default_rng(5)
    base = r.normal(size=(3, 8))
    got, _ = _ranked_block(base, np.repeat(base, 2000, axis=0).astype(np.float32), 10)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: list(range(2000 * q, 2000 * q + 10)) for q in range(3)}


def test_modes_search_each_list_once(spark):
    """What is fused and reranked is read from the lists, not searched for again."""
    _, _, q, c = _frames(spark)
    lists = {"dense": retrieval.dense_top_k(q, c, 7), "sparse": retrieval.dense_top_k(q, c, 5)}
    score = lambda h: h.withColumn("relevance", F.col("rank") / 7)
    cells = modes.grid({"mode": ["dense", "cc+rerank"]}, {"top_k": 3, "alpha": 0.8, "rrf_k": 60, "score_threshold": 0.0, "rerank_candidates": 5})
    for hits in (modes.mode_table(["dense", "hybrid", "cc+rerank"], lists, 5, score_pairs=score), modes.sweep(lists, cells, score)):
        assert "MapInArrow" not in hits._jdf.queryExecution().executedPlan().toString() and hits.count() > 0


def test_well_filled_lists_are_searched_by_a_matrix(monkeypatch):
    """The same chunks and scores as list by list; terms of negative weight are left to the lists."""
    r = np.random.default_rng(7)
    table = pa.table({"document": [f"d{i:04d}" for i in range(900)], "_terms": pa.array([sorted(r.choice(20, 6, replace=False).tolist()) for _ in range(900)], pa.list_(pa.int32())),
                      "_weights": pa.array([r.choice([0.25, 0.5, 1.0], 6).tolist() for _ in range(900)], pa.list_(pa.float64()))})
    rows = pa.Table.from_batches(list(postings._inverted(table, ["document"], 0, None)))
    rows = rows.append_column("queries", pa.array([[]] * rows.num_rows, pa.list_(pa.int64())))
    shard = postings.Shard(rows, None)
    assert shard.filled()
    monkeypatch.setattr(postings, "SCORE_CELLS", 2000)
    asked = [([1, 2, 3], [0.5, 0.25, 1.0]), ([7], [1.0]), ([0, 19], [1.0, 1.0])]
    for (terms, factors), (found, scores) in zip(asked, shard.with_any_of(asked, 10)):
        want, expected = shard.with_any(terms, factors, 10)
        order = np.lexsort((want, -expected))[:10]
        assert found.tolist() == want[order].tolist() and scores.tolist() == expected[order].tolist()
    later = []
    shard.best({"query_id": 1, "n_terms": 0, "terms": [{"term": 1, "weight": -1.0}]}, 10, False, later)
    assert not later


def test_vectors_are_encoded_once(spark):
    df = encoders.embed(spark.createDataFrame([("a b",), ("c",)], "t string"), "t", encoders.HashedTerms)
    kept = df.filter(F.exists("embedding", lambda v: v > 0))
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and kept.count() == 2
