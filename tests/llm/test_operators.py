"""The operators beside brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import glob
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.llm import boosted_rules, components, hnsw, labelled, mixing, piece_scan, queries, sharding, token_files, trie_counts, trie_join, unigram, unit_ids, vote_classifier, warc, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = np.random.RandomState(5)
PROSE = [" ".join("w%d" % k for k in RANDOM.randint(0, 400, n)) for n in (3, 5, 40, 60, 80, 120, 300)]
EDITED = [p.replace(" ", "\n", 3) for p in PROSE] + [" ".join([*p.split()[:-2], "x", "y"]) for p in PROSE]
TEXTS = [None, "", " \t\n", "a", "A b C", *PROSE, *PROSE[2:5], *EDITED, PROSE[3].upper(), "a b a b " * 700, "é ß 日本 #$ | \U0001f600\n\n", "x" * 5000]
COLUMNS = "doc_id long, text string, source string, size long, shard int, score double, kept boolean, id long, ids string, low long, row string"


@pytest.fixture(scope="module")
def docs(spark):
    """Columns besides the first three bear names that the operators use themselves."""
    rows = [(k, t, [None, "a", "b", "ü"][k % 4], 7, 1, 0.5, None, 3, "z", 9, None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def shingle_set(text, width=5):
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not found:
        return set()
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)} if len(found) >= width else {tuple(found)}


def spanned(nodes, links):
    up = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def test_word_numbers():
    for text in [t for t in TEXTS if t is not None]:
        want = WORD.findall(text)
        got = words.word_numbers(text.encode()).tolist()
        assert len(got) == len(want)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
    assert b"".join(words.pieces(b"ab cd " * 50, 16)) == b"ab cd " * 50


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 9), (20, 21), (7, 7), (21, 20)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    want = spanned({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if n != 7}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_join(docs, none, block):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in trie_join.jaccard_join(docs, block=block).collect()}
    sets = {k: shingle_set(t) for k, t in enumerate(TEXTS)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root, count = spanned(sets, links), collections.Counter(x for e in links for x in e)
    assert got == {k: (len(s), root[k], count[k]) for k, s in sets.items()}
    if block == 3:
        assert trie_join.jaccard_join(none).count() == 0


def test_jaccard_join_of_repeated_rows_and_null_ids(spark):
    """Overlaps around a third to nine tenths; every row twice, ids shared by two texts, and sets that only rows without id have."""
    random = np.random.RandomState(9)
    base = [["v%d" % k for k in random.randint(0, 5000, 120)] for _ in range(4)]
    texts = [" ".join([*b[:cut], *("z%d" % k for k in random.randint(0, 5000, 120 - cut))]) for b in base for cut in (45, 60, 75, 90, 105, 112, 116, 118, 120)]
    ids = [None if k % 4 == 1 else k - 1 if k % 9 == 6 else k for k in range(len(texts))]
    ids[25:27] = [None, None]
    rows = list(zip(ids, texts)) * 2 + [(ids[0], texts[0])] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root, count = spanned(range(len(rows)), links), collections.Counter(x for e in links for x in e)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[root[k]] = min(i, names.get(root[k], i))
    want = sorted(((i, len(sets[k]), names.get(root[k]), count[k]) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, trie_join.jaccard_join(table).collect()), key=str) == want
    assert any(i is None and len({rows[b][1] for a, b in links + [(b, a) for a, b in links] if a == k}) > 1 for k, (i, _) in enumerate(rows))


def test_an_ngram_of_every_text_is_spread(spark):
    """One passage stands in all texts and another in a third; both are dealt to several salts, and the links are those of brute force."""
    random = np.random.RandomState(13)
    texts = [" ".join(["p q r s t", *("w%d" % k for k in random.randint(0, 900, 9)), *["f g h i j"] * (n % 3 == 0)]) for n in range(240)]
    texts += [t + " end" for t in texts[::6]] + texts[:20]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        rows = spark.range(4000).selectExpr("id AS low", "explode(array(-1L, id, id + 1, id + 2)) AS token").where("token < 4000")
        sizes = trie_join._dealt(rows).groupBy("token", "salt").count()
        assert sizes.where("token = -1").count() >= 10 and sizes.agg({"count": "max"}).first()[0] < 2 * 16000 / 48
        edges = trie_join._edges(rows)
        assert edges.groupBy("b").count().agg({"count": "max"}).first()[0] < 2000
        assert components.components(edges).select("component").distinct().count() == 1
        got = {r.doc_id: (r.component_id, r.n_links) for r in trie_join.jaccard_join(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root, count = spanned(range(len(sets)), links), collections.Counter(x for e in links for x in e)
    assert got == {k: (root[k], count[k]) for k in range(len(sets))} and len(links) > 40


def test_trie_finds_all_partners():
    lists = [np.array(sorted(RANDOM.choice(30, RANDOM.randint(0, 20), replace=False)), np.int64) for _ in range(120)] + [np.arange(10)] * 3
    sizes = np.array([len(x) + RANDOM.randint(0, 3) for x in lists])
    trie = trie_join.Trie(lists, sizes)
    for x, n in zip(lists, sizes):
        mask = np.zeros(30, bool)
        mask[x] = True
        want = [k for k, y in enumerate(lists) if 7 * len(set(x) & set(y)) >= 3 * (n + sizes[k])]
        assert sorted(trie.partners(mask, len(x), int(n)).tolist()) == want


@pytest.mark.parametrize("shard", [8192, 15])
def test_near_duplicate_vectors(spark, shard):
    base = RANDOM.standard_normal((30, 8))
    vectors = [(base[k % 30] + 0.12 * RANDOM.standard_normal(8)).tolist() for k in range(120)]
    rows = [(k, [float(np.float32(x)) for x in v], k % 2, 1, "q") for k, v in enumerate(vectors)]
    rows += [(200, rows[0][1], 0, 1, "q"), (201, rows[0][1], 0, 1, "q"), (202, rows[0][1], None, 1, "q"), (203, None, 0, 1, "q"), (204, [0.0] * 8, 0, 1, "q"), (205, [float("nan")] + [1.0] * 7, 0, 1, "q"),
             (206, [None] + [1.0] * 7, 0, 1, "q"), (207, [1.0, 2.0], 0, 1, "q"), (208, [], 0, 1, "q"), (209, [float("inf")] + [1.0] * 7, 0, 1, "q"), (210, [2.0, 4.0], 0, 1, "q")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, first int, component string")
    ok = {r[0]: (r[2], np.array(r[1], float)) for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and cos(ok[a][1], ok[b][1]) >= 0.93]
    root, count = spanned([r[0] for r in rows], links), collections.Counter(x for e in links for x in e)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(table, shard=shard, beam=4).collect()}
    assert len(links) > 50 and got == {k: (count[k], c, c == k) for k, c in root.items()}
    if shard == 15:
        assert hnsw.near_duplicates(table.limit(0)).count() == 0


def test_graph_widens_until_the_audit_passes():
    x = hnsw.unit(RANDOM.standard_normal((600, 16)))
    graph = hnsw.Graph(x, links=4, beam=8)
    who, node, _ = graph.audited(x, 0.55, 1, 600)
    assert len(set(zip(who.tolist(), node.tolist()))) == (x @ x.T >= 0.55).sum()


def test_an_audit_without_links_does_not_pass():
    """A graph without ways, asked by vectors of which three have a link, none of them in the first sample."""
    random = np.random.RandomState(3)
    graph, q = hnsw.Graph(hnsw.unit(random.standard_normal((700, 24)))), hnsw.unit(random.standard_normal((700, 24)))
    places = np.setdiff1d(np.arange(700), np.linspace(0, 699, 64).astype(np.int64))[[5, 90, 300]]
    q[places] = graph.exact[[650, 20, 333]]
    for layer in graph.layers:
        layer[:] = -1
    want = set(zip(*(x.tolist() for x in np.nonzero(q @ graph.exact.T >= 0.93))))
    assert len(want) == 3
    who, node, _ = graph.audited(q, 0.93, 4, 64)
    assert set(zip(who.tolist(), node.tolist())) == want


def test_rare_links_come_through_the_graph(monkeypatch):
    """Of 3,000 vectors few have a link; the result is that of all pairs, and only the audits' samples were compared."""
    random = np.random.RandomState(11)
    x = random.standard_normal((3000, 32))
    x[2000:2040] = x[100:140] + 0.05 * random.standard_normal((40, 32))
    x = hnsw.unit(x)
    graph, compared, real = hnsw.Graph(x), [0], hnsw.Graph.passes
    monkeypatch.setattr(hnsw.Graph, "passes", lambda self, found, *rest: (compared.__setitem__(0, compared[0] + rest[-1]), real(self, found, *rest))[1])
    found, width = graph.asked(graph.exact, 0.93, hnsw.BEAM, hnsw.AUDIT)
    assert (found == (x @ x.T >= 0.93)).all() and found.sum() == 3080
    assert width < len(x) and compared[0] < len(x) / 5


def test_a_full_shard_of_copies_needs_little_memory():
    """All pairs of 4,096 vectors link: 16.8 million, one bit each."""
    import tracemalloc

    random = np.random.RandomState(12)
    x = hnsw.unit(np.ones((4096, 16)) + 0.01 * random.standard_normal((4096, 16)))
    graph, n = hnsw.Graph(x[:600]), len(x)
    graph.exact, graph.x = x, x.astype(np.float32)
    graph.layers = [np.stack([np.roll(np.arange(n), k) for k in (1, 2, 3, 5, 8, 13, 21, 34)], axis=1)]
    graph.entry, graph.top = 0, 0
    tracemalloc.start()
    found, _ = graph.asked(graph.exact, 0.93, hnsw.BEAM, hnsw.AUDIT)
    np.fill_diagonal(found, False)
    links = hnsw._counted(found, np.full(n, 2), np.full(n, 2))[0]
    roots = hnsw._tied(found, np.arange(n) + 7, np.arange(n) + 7)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == 2 * (n - 1)).all() and (roots == 7).all() and peak < 300e6


def test_shards_ask_each_other():
    """One node of the first shard's graph has no way in; its link is found from its own side."""
    random = np.random.RandomState(4)
    base = random.standard_normal((2000, 8))
    shards = [[(base + 0.002 * k * random.standard_normal(base.shape))[i].tolist() for i in range(2000)] for k in (0, 1)]
    rows = [hnsw._index(hnsw.pd.DataFrame({"label": "a", "dim": 8, "shard": k, "shards": 2, "order": range(2000), "first": range(10_000 * k, 10_000 * k + 2000), "copies": 1, "vector": shards[k]})) for k in (0, 1)]
    lost = int(np.setdiff1d(np.arange(1, 2000), np.linspace(0, 1999, 64).astype(np.int64))[200])
    assert lost != rows[0]["entry"][0]
    rows[0].at[0, "layers"] = [np.where(x == lost, -1, x).astype(np.int32).tobytes() for x in (np.frombuffer(b, np.int32) for b in rows[0]["layers"][0])]
    found = hnsw._ask(0.999, 48, 64)(hnsw.pd.concat(rows))
    assert len(found) == 4000 and set(found.loc[found["id"].isin([lost, 10_000 + lost]), "root"]) == {lost} and (found["links"] == 1).all()


def test_every_node_of_a_graph_can_be_reached():
    near = np.repeat(RANDOM.standard_normal((8, 6)), 60, axis=0) + 0.01 * RANDOM.standard_normal((480, 6))
    graph = hnsw.Graph(hnsw.unit(near), links=2, beam=4)
    reached = {graph.entry}
    front = reached
    while front:
        front = {int(n) for f in front for n in graph.layers[0][f] if n >= 0} - reached
        reached |= front
    assert len(reached) == 480


def test_quality_rules_base_and_carry(docs, none):
    forest = boosted_rules.grow(np.zeros((0, 10)), np.zeros(0), np.zeros(0), list(boosted_rules.FEATURES.values()))
    got = {r.doc_id: r for r in boosted_rules.quality_rules(docs, forest, carry="all").collect()}
    for k, text in enumerate(TEXTS):
        found = WORD.findall(text or "")
        windows = [tuple(found[i:i + 8]) for i in range(len(found) - 7)]
        many = collections.Counter(windows)
        repeated = len({i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(8)})
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated)
        row = got[k]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 20 or 100 * repeated > 30 * want[0])
        assert row.kept == (not row.base_failed and row.score >= 0.5) and row["all"].text == text and row["all"].kept is None
    assert boosted_rules.quality_rules(none, forest, carry="all").count() == 0


def test_forest_is_monotone_and_accurate():
    x = RANDOM.random_sample((2000, 3))
    y = ((x[:, 0] + 0.1 * RANDOM.standard_normal(2000) < 0.5) ^ (x[:, 1] > 0.9)).astype(float)
    forest = boosted_rules.grow(x, y, np.ones(2000), [-1, 0, 1])
    probe = RANDOM.random_sample((200, 3))
    for f, sign in ((0, -1), (2, 1)):
        line = [forest.score(np.where(np.arange(3) == f, v, probe)) for v in np.linspace(0, 1, 30)]
        assert (sign * np.diff(np.array(line), axis=0) >= -1e-12).all()
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.8
    one, node = forest.score(probe[:1])[0], forest.start
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(probe[0, feature[at]] > threshold[at])
        node += value[at - len(feature)]
    assert one == pytest.approx(1 / (1 + np.exp(-node)))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = labels.select("doc_id", "quality")
    rules = queries.op7_quality_rules(spark, "/root/testdata/sf0.01").where(labelled.held_out("doc_id")).join(truth, "doc_id").toPandas()
    votes = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(truth, "doc_id").where("held_out").toPandas()
    assert ((rules["score"] >= 0.5) == rules["quality"]).mean() > 0.93
    assert (votes["predicted"] == votes["quality"]).mean() > 0.93
    assert votes["score"].between(0, 1).all() and docs.count() == 1000


def test_labels_of_held_out_rows_are_never_used(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(len(TEXTS))] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, id int")
    other = labels.withColumn("quality", F.when(labelled.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (vote_classifier.classify(docs, vote_classifier.fit(docs, x)).toPandas().sort_values("doc_id") for x in (labels, other))
    assert (a["score"].to_numpy() == b["score"].to_numpy()).all()
    assert {int(k): bool(h) for k, h in zip(a["doc_id"], a["held_out"])} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(len(TEXTS))}


def test_votes_match_brute_force(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(TEXTS))], "doc_id long, quality int")
    model = vote_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in vote_classifier.classify(docs, model, carry="c").collect()}
    for k in range(len(TEXTS)):
        counts = vote_classifier.term_counts(TEXTS[k])
        if not counts.sum():
            assert got[k] == 0.0
            continue
        z = model.latent(counts[None])[0]
        near = sorted(((float(z @ v), w, y) for v, w, y in zip(model.vectors, model.weight, model.label)), reverse=True)[:vote_classifier.NEIGHBOURS]
        votes = [(max(c, 0) ** vote_classifier.POWER * w, y) for c, w, y in near]
        assert got[k] == pytest.approx(sum(v * y for v, y in votes) / sum(v for v, _ in votes), abs=1e-4)
    assert vote_classifier.classify(none, model).count() == 0
    empty = vote_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in vote_classifier.classify(docs, empty).collect()} == {0.0, 0.5}


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size = {k: len(WORD.findall(t or "")) for k, t in enumerate(TEXTS)}
    total = collections.Counter()
    for k, s in source.items():
        total[s] += size[k]
    names = sorted((s for s in total if s is not None), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, want = set(), {}
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        want = {s: 2 * total[s] if s in full else left * weight[s] / sum(weight[t] for t in names if t not in full) for s in names}
        over = {s for s in names if s not in full and want[s] >= 2 * total[s]}
        if not over:
            break
        full |= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(want[s])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names) and len(rows) == len(TEXTS)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    twice = docs.union(docs).union(docs.limit(3).withColumn("text", F.lit("more words under an old id")))
    assert mixing.repeated(twice).count() == sum(r.copies for r in mixing.mix(twice).collect())
    assert mixing.mix(none).count() == 0


def test_rounding_over_levels(spark):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.lit("s").alias("source"))
    more = docs.withColumn("source", F.lit("t")).withColumn("doc_id", F.col("doc_id") + 20_000)
    found = mixing.mix(docs.union(more)).groupBy("target").agg(F.sum("taken").alias("taken"), F.avg("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) <= 50 for r in found) and sum(r.taken for r in found) == pytest.approx(1.5 * 510_000, abs=100)


def test_sharding(spark, docs, none):
    many = docs.select("doc_id", "text").union(spark.range(100, 3000).select("id", F.when(F.col("id") < 1500, "one text that many share").otherwise(F.repeat(F.lit("z"), (F.col("id") % 97).cast("int")))))
    rows = sharding.assign(many).collect()
    by_id = {r.doc_id: r.text for r in many.collect()}
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        data = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(by_id) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(40))
    mean = sum(size.values()) / 40
    assert all(abs(size[k] - mean) <= 5700 for k in range(40))
    assert sorted((r.doc_id, r.shard) for r in rows) == sorted((r.doc_id, r.shard) for r in sharding.assign(many.repartition(5)).collect())
    assert sharding.assign(none).count() == 0


def test_groups_of_equal_texts_share_a_shard(spark):
    """Groups of one and a half ranges, half a shard and nine tenths of one stay whole; one of two shards is cut, so sizes stay near equal."""
    shards, singles = 10, 20_000
    text = lambda group: F.concat(F.lit("group text number "), F.col("group").cast("string"))
    width = 40  # bytes of a row with its text, about
    whole = singles * 100 / shards
    groups = [(1, 1.5 / sharding.RANGES), (2, 0.5), (3, 0.9), (4, 2.0), (5, 0.5), *[(6 + k, 0.02) for k in range(30)]]
    plan = spark.createDataFrame([(g, max(2, int(share * whole / width))) for g, share in groups], "group long, n int")
    copies = plan.select(text(None).alias("text"), F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    rows = copies.select("text").union(spark.range(singles).select(F.rpad(F.concat(F.lit("single "), "id"), 84, "x")))
    docs = rows.repartition(6).select(F.monotonically_increasing_id().alias("doc_id"), "text").cache()
    docs.count()
    got = sharding.assign(docs, shards).join(docs, "doc_id").select("text", "shard", "size", "slot").collect()
    places, sizes = collections.defaultdict(set), collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        places[r.text].add(r.shard)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert {t for t, p in places.items() if len(p) > 1} == {"group text number 4"}
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[k] - mean) < 0.02 * mean for k in range(shards)), sizes
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(TEXTS) and len(glob.glob(f"{tmp_path}/s/out_shard=*")) == back.select("out_shard").distinct().count()


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    tokenizer, path = Tokenizer.from_file(queries.BYTE_BPE), str(tmp_path / "d")
    token_files.write_dataset(docs, path, queries.BYTE_BPE, file_ids=500)
    rows = {r.id: r for r in token_files.read_dataset(spark, path, queries.BYTE_BPE).collect()}
    sums = {r.id: r.crc32 for r in token_files.read_dataset(spark, path, queries.BYTE_BPE, digest=True).collect()}
    at, whole = 0, []
    for k, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        data = np.array(ids, "<u4").tobytes()
        assert (rows[k].start, rows[k].n, bytes(rows[k].ids), sums[k]) == (at, len(ids), data, zlib.crc32(data))
        at += len(ids)
        whole += ids
    flat = np.concatenate([np.fromfile(f, "<u2") for f in sorted(glob.glob(f"{path}/ids/part-*"))])
    offsets = np.concatenate([np.fromfile(f, "<u8") for f in sorted(glob.glob(f"{path}/offsets/part-*"))])
    assert flat.tolist() == whole and offsets.tolist() == sorted(r.start for r in rows.values())
    token_files.write_dataset(none, f"{path}0", queries.BYTE_BPE)
    assert token_files.read_dataset(spark, f"{path}0", queries.BYTE_BPE).count() == 0


def test_ids_in_between_are_packed_beside_a_sample(spark, tmp_path):
    """Short documents with phrases in common, a few words of their own each; what waits on disk is well below the ids' own size."""
    random = np.random.RandomState(8)
    phrases = [" ".join("".join(chr(97 + c) for c in random.randint(0, 26, 5)) for _ in range(12)) for _ in range(60)]
    texts = [" ".join(phrases[k] for k in random.randint(0, 60, 4)) + f" {k}" for k in range(600)]
    path = str(tmp_path / "d")
    token_files.write_dataset(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), path, queries.BYTE_BPE)
    packed = spark.read.parquet(f"{path}/encoded").agg(F.sum(F.octet_length("ids")), F.sum("n")).first()
    assert packed[0] < 0.25 * 2 * packed[1]
    sums = {r.id: r.crc32 for r in token_files.read_dataset(spark, path, queries.BYTE_BPE, digest=True).collect()}
    encoder = unit_ids.ByteUnits(queries.BYTE_BPE, False)
    assert sums == {k: zlib.crc32(np.append(encoder.encode([t])[0], 0).astype("<u4")) for k, t in enumerate(texts)}


def test_changed_offsets_fail_the_read(spark, docs, tmp_path):
    path = str(tmp_path / "d")
    token_files.write_dataset(docs, path, queries.BYTE_BPE, file_ids=500)
    for name in glob.glob(f"{path}/offsets/.*.crc"):
        open(name, "wb").close()
    name = sorted(glob.glob(f"{path}/offsets/part-*"))[0]
    offsets = np.fromfile(name, "<u8")
    offsets[1] += 1
    offsets.tofile(name)
    with pytest.raises(Exception, match="disagree"):
        token_files.read_dataset(spark, path, queries.BYTE_BPE).collect()


def test_word_encoder_equals_the_library():
    encoder = unit_ids.ByteUnits(queries.BYTE_BPE, False)
    cases = ["", "a", " a", "a ", "a  b", "a \n b", "\na b", "x  y z", "don't  stop", " ", "\n", "Ġ a Ġb", "a Ġ b", "a <|endoftext|> b <|endoftext|>c", "日本 語 é", "a\tb c", "1 2 3", "a\x1c b", *filter(None, TEXTS)]
    want = [encoder.tokenizer.encode(c, add_special_tokens=False).ids for c in cases]
    ids, bounds, _ = encoder.encode(cases)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


@pytest.mark.parametrize("chunk", [piece_scan.CHUNK, 40])
def test_pieces(spark, docs, none, chunk):
    odd = ["▁a ▁\n\n  x\t\r", "a" * 300, "".join(RANDOM.choice(list("ab"), 400)), "".join(RANDOM.choice(list("ab c\n"), 400)), "日本語\U0001f600 " * 30, " " * 300]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")).cache()
    vocab, texts = unigram.Vocabulary(queries.PIECES), {r.doc_id: r.text for r in both.collect()}
    encoded = piece_scan.encode(both, queries.PIECES, chunk=chunk).cache()
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert ids == {k: vocab.encode(t) for k, t in texts.items()}
    assert {r.doc_id: r.text for r in piece_scan.decode(encoded, queries.PIECES).collect()} == {k: t or "" for k, t in texts.items()}
    assert all(r.text_crc32 == r.source_crc32 and r.n_tokens == len(ids[r.doc_id]) for r in piece_scan.round_trip(encoded, queries.PIECES).collect())
    counts = {r.doc_id: r.n_tokens for r in trie_counts.token_counts(both, queries.PIECES, nodes=50).collect()}
    assert counts == {k: len(x) for k, x in ids.items()}
    if chunk == 40:
        assert piece_scan.encode(none, queries.PIECES).count() == trie_counts.token_counts(none, queries.PIECES).count() == 0


def test_paths_are_best():
    """Against a plain quadratic search over whole texts, and the piece library's decoder."""
    from sentencepiece import SentencePieceProcessor

    vocab, library = unigram.Vocabulary(queries.PIECES), SentencePieceProcessor(model_file=queries.PIECES)
    for text in ["the cat sat on  the mat", "abab abc\nab", "un  mañana ßx", "zzzz 😀 q", PROSE[2]]:
        s, best = " " + text, [0]
        for p in range(1, len(s) + 1):
            ways = [best[q] + vocab.score[s[q:p]] for q in range(p) if s[q:p] in vocab.score]
            if s[p - 1] not in vocab.score:
                ways.append(best[p - 1] - unigram.BYTE_COST * len(s[p - 1].encode()))
            best.append(max(ways))
        ids = vocab.encode(text)
        own = sum(vocab.score.get(vocab.bytes_of[k].decode(errors="ignore"), -unigram.BYTE_COST) if k not in vocab.byte_id else -unigram.BYTE_COST for k in ids)
        assert own == best[-1] and library.decode(ids) == text


def test_scan_is_associative():
    stack = RANDOM.randint(-50, 0, (11, 4, 4))
    want, runs = stack[0], [stack[0]]
    for m in stack[1:]:
        want = piece_scan.product(want, m)
        runs.append(want)
    assert (piece_scan.prefixes(stack) == np.stack(runs)).all()


def test_warc(spark, tmp_path):
    html = ["<html><title>T &amp;\n x</title><script>no</script><p>a&nbsp;b<br>c<a href='x'>d</a><!-- gone --></p></html>", None, "", "raw\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nno record", "é" * 3000]
    pages = spark.createDataFrame([(k, f"http://x/{k}\r\nHost: y" if k else None, h, "q") for k, h in enumerate(html)], "page_id long, url string, html string, block string")
    records = warc.responses(pages)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_records(records.union(warc.derive(records).select(*records.columns)), path, compression)
        back = warc.read_records(spark, path)
        rows = sorted(map(tuple, back.where("record_type = 'response'").select(*records.columns).collect()))
        assert rows == sorted(map(tuple, records.collect())) and back.count() == 15
    made = warc.derive(back).collect()
    source = {r.record_id: r for r in records.collect()}
    text = {r.source_key: r.block for r in made if r.record_type == "conversion"}
    assert text["0"] == "T &\nx\na b\ncd" and text["1"] == text["2"] == ""
    for r in made:
        assert r.source_block_digest == source[r.refers_to].block_digest and r.payload_digest == source[r.refers_to].payload_digest
        assert r.target_uri == source[r.refers_to].target_uri and "\n" not in (r.target_uri or "") and r.content_length == len(r.block.encode())
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_pipeline_keeps_one_row_a_component(spark):
    """Repeated rows, rows without an id, ids of two texts, and columns that differ among rows of one id and text."""
    import corpus_pipeline

    a, b, c, d, e = (" ".join("%s%d" % (x, k) for k in range(60)) for x in "abcde")
    near = lambda t: t.rsplit(" ", 2)[0] + " p q"
    rows = [(1, a, "s"), (1, a, "s"), (2, near(a), "s"), (None, near(a) + " r", "s"), (None, b, "s"), (None, b, "s"), (None, near(b), "t"), (None, c, "s"),
            (4, d, "s"), (4, e, "s"), (4, e, "t"), (6, near(e), "s"), (7, "", "s"), (7, "", "s"), (None, None, "s"), (9, "short text", "s"), (None, "other short text", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [corpus_pipeline.near_duplicates(spark, t, SF) for t in (table.repartition(5), table.repartition(2), table.limit(0))]
    assert got[0].columns == table.columns and got[2].count() == 0
    found = [sorted(map(tuple, g.collect()), key=str) for g in got[:2]]
    assert found[0] == found[1]
    by_text = collections.Counter((i, t) for i, t, _ in found[0])
    other = (None, b) if (None, b) in by_text else (None, near(b))
    assert by_text == {(1, a): 1, other: 1, (None, c): 1, (4, d): 1, (4, e): 1, (7, ""): 2, (None, None): 1, (9, "short text"): 1, (None, "other short text"): 1}
    out = corpus_pipeline.encoding(spark, got[0], SF).collect()
    assert len(out) == len(found[0]) and all(r.exact for r in out)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            sets = {r.doc_id: shingle_set(r.text) for r in before.collect()}
            links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert ids == set(spanned(sets, links).values())
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    vocab = unigram.Vocabulary(queries.PIECES)
    assert all(r.exact for r in out) and sorted((r.doc_id, r.ids) for r in out) == sorted((r.doc_id, vocab.encode(r.text)) for r in kept.collect())
    assert corpus_pipeline.run(spark, SF).count() == len(out)


def test_plain_text_replaces_literals_and_puts_no_space_back(spark):
    odd = [" a  b ", "a\t b\f\r\nc", "a \n \n b\n", "a \u2028", "a\n\u0085", "&amp;lt;&amp;amp;nbsp;", "x&#39;&quot;&nbsp;y", "<p>1 &lt; 2</p>\n<br> 3", "$1 \\ &gt;", "", None]
    given = spark.createDataFrame([(x,) for x in odd], "html string")
    one_by_one = F.col("html")
    for pattern, place in warc.TO_TEXT:
        one_by_one = F.regexp_replace(one_by_one, pattern, place)
    found = given.select("html", one_by_one.alias("told"), warc.plain_text(F.col("html")).alias("made"))
    assert all(r.told == r.made for r in found.collect())
    plan = given.select(warc.plain_text(F.col("html")).alias("made"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 8


def test_pipeline_encodes_and_decodes_in_stages_of_their_own(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some text"), (None, ""), (3, None), (3, "x y")], "doc_id long, text string")
    out = corpus_pipeline.encoding(spark, docs, SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id or 0, r.n_tokens > 0, r.exact) for r in out.collect()) == [(0, False, True), (1, True, True), (3, False, True), (3, True, True)]


def test_carried_texts_are_sent_once(spark, docs, none):
    """Rows that come along hold the text; it is not sent a second time beside them, whatever the case of the names."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(TEXTS))], "doc_id long, quality int")
    forest, model = boosted_rules.fit(docs, labels), vote_classifier.fit(docs, labels)
    for run in (lambda d, **k: boosted_rules.quality_rules(d, forest, **k), lambda d, **k: vote_classifier.classify(d, model, **k)):
        out = run(docs, id_col="DOC_ID", text_col="Text", carry="c")
        node = out._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "MapInArrow":
            node = node.children().head()
        assert node.children().head().output().size() == 1
        plain, rows = {r.doc_id: r for r in run(docs).collect()}, out.collect()
        assert sorted((r.c.doc_id, r.c.text or "") for r in rows) == [(k, t or "") for k, t in enumerate(TEXTS)]
        assert all(r.DOC_ID == r.c.doc_id and r.score == pytest.approx(plain[r.c.doc_id].score, abs=1e-6) for r in rows)
        assert run(none, carry="c").count() == 0
