"""Chunking against a plain specification, and invariants of overlaps and merges."""

import collections
import random
import re
import statistics

import pyarrow as pa
from pyspark.sql import functions as F

from sondeo.functions import text
from sondeo.operators import chunking


def sample_texts(n=120, seed=3):
    r = random.Random(seed)
    bits = ["\n\n", "\n", ". ", "! ", "? ", " ", "word", "longerword", "x" * 35, "\t", "é", "  ", " "]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 160))) for _ in range(n)] + ["", " ", " " * 90, "y" * 300]


def test_cut_points_by_hand():
    assert chunking.cut_points("short", 10) == [0, 5]
    assert chunking.cut_points("aa bb. cc dd", 8) == [0, 7, 12]
    assert chunking.cut_points("aaaa bbbb", 6) == [0, 5, 9]
    assert chunking.cut_points("one\n\ntwo three\n\n", 12) == [0, 5, 16, 16]


def test_cut_text_by_hand():
    assert chunking.cut_text("", 10, 3) == [] and chunking.cut_text("  \n ", 10, 3) == []
    assert chunking.cut_text("aa bb cc dd", 6, 0) == ["aa bb", "cc dd"]
    assert chunking.cut_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert chunking.cut_text("y" * 25, 10, 0) == ["y" * 10, "y" * 10, "y" * 5]
    assert chunking.cut_text("y" * 10 + "\t" * 10 + "z" * 5, 10, 0) == ["y" * 10, "z" * 5]
    assert chunking.cut_text("First. Second one. Third", 12, 0) == ["First.", "Second one.", "Third"]


def test_cutter_keeps_its_bounds():
    for body in sample_texts():
        plain = chunking.cut_text(body, 30, 0)
        assert "".join("".join(plain).split()) == "".join(body.split())
        assert all(0 < len(c) <= 30 and c == c.strip() for c in plain)
        for size, overlap in ((30, 8), (25, 25), (2000, 400)):
            chunks = chunking.cut_text(body, size, overlap)
            assert all(0 < len(c) <= size + overlap and c in body for c in chunks if "\t" not in body)
            starts = [body.find(c) for c in chunks]
            assert not starts or "\t" in body or starts[0] == len(body) - len(body.lstrip())
            assert set("".join(chunks)) - set(body) == set()
            points = chunking.cut_points(body, size)
            assert points == sorted(points) and (points[0], points[-1]) == (0, len(body))


def test_chunk_rows_are_numbered(spark):
    bodies = sample_texts(30)
    docs = spark.createDataFrame([("c", f"d{i}", b) for i, b in enumerate(bodies)], "collection string, document string, content string")
    rows = chunking.chunk_documents(docs, 30, 8).collect()
    for i, body in enumerate(bodies):
        mine = sorted((r.chunk_index, r.content, r.total_chunks) for r in rows if r.document == f"d{i}")
        assert [m[0] for m in mine] == list(range(len(mine))) and all(m[2] == len(mine) for m in mine)
        assert [m[1] for m in mine] == chunking.cut_text(body, 30, 8)


def spec_overlap(a, b, cap):
    return next((n for n in range(min(len(a), len(b), cap), 0, -1) if a[-n:] == b[:n]), 0)


TOLERANT = [("one  two", "one two three", 7), ("x one two", "one \n two three", 9), ("abc", "xyz", 0), ("end ", "  next", 2), ("a b", "a b", 3), ("", "a", 0)]


def spec_tolerant(a, b, cap):
    """On texts with white space runs as one blank; the length is up to where the next character or run starts in ``b``."""
    flat = [[(" " if m[0].isspace() else m[0], m.start()) for m in re.finditer(r"\s+|\S", t)] for t in (a, b)]
    n = spec_overlap(*("".join(c for c, _ in f) for f in flat), cap)
    return n and [*(at for _, at in flat[1]), len(b)][n]


def test_three_overlap_variants(spark):
    from sondeo.catalog import queries
    from sondeo.catalog.tables import _pairs

    sf = "/root/testdata/sf0.001"
    want, unmatched = collections.defaultdict(list), {}
    for p in _pairs(spark, sf).collect():
        right = p.text2.replace(" ", "  ")
        a, b, c = spec_overlap(p.text1, right, 300), spec_overlap(p.text1, right, 2000), spec_tolerant(p.text1, right, 2000)
        for name, value in zip("abc", (a, b, c)):
            want[p.collection, name].append((value, b != c, c == 0))
        if b != c or c == 0:
            unmatched[p.collection, p.document, p.chunk_index] = (b, c, c == 0, b != c, p.text1[-chunking.EXCERPT:], right[:chunking.EXCERPT])
    got = {(r.collection, r.variant): r for r in queries()["c07_variant_summary"](spark, sf).collect()}
    assert set(got) == set(want)
    for key, rows in want.items():
        values, row = [v for v, _, _ in rows], got[key]
        assert (row.n, row.min, row.max, row.median, row.disagreeing, row.residual) == (
            len(rows), min(values), max(values), statistics.median(values), sum(d for _, d, _ in rows), sum(z for _, _, z in rows))
        assert abs(row.mean - sum(values) / len(values)) < 0.051 and abs(row.zero_pct - 100 * values.count(0) / len(values)) < 0.051
    assert {tuple(r[:3]): tuple(r[3:]) for r in queries()["c07_unmatched_pairs"](spark, sf).collect()} == unmatched
    assert any(r[3] and not r[2] for r in unmatched.values()) and any(r[2] for r in unmatched.values())


def test_overlaps_match_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(150):
        a = "".join(r.choice("ab \n") for _ in range(r.randrange(0, 40)))
        b = a[len(a) - r.randrange(0, len(a) + 1):] + "".join(r.choice("ab \n") for _ in range(r.randrange(0, 20)))
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "id int, text1 string, text2 string")
    got = df.select("id", text.longest_overlap(F.col("text1"), F.col("text2"), 12).alias("n"), chunking.tolerant_overlap(12)("text1", "text2").alias("t")).collect()
    for row in got:
        _, a, b = rows[row.id]
        assert row.n == spec_overlap(a, b, 12)
        if not any(x.isspace() and y.isspace() for t in (a, b) for x, y in zip(t, t[1:])):
            flat = [t.replace("\n", " ") for t in (a, b)]
            assert row.t == spec_overlap(*flat, 12)
    cases = spark.createDataFrame(TOLERANT, "a string, b string, n int").select("n", chunking.tolerant_overlap(12)("a", "b").alias("t")).collect()
    assert [r.t for r in cases] == [r.n for r in cases]


def test_merge_rebuilds_continuous_text(spark):
    body = " ".join(f"This is sentence number {i} in a long continuous paragraph about testing." for i in range(400))
    chunks = chunking.cut_text(body)
    assert len(chunks) >= 3
    found = [spec_overlap(a, b, chunking.OVERLAP) for a, b in zip(chunks, chunks[1:])]
    assert any(n > 300 for n in found) and all(n <= chunking.OVERLAP for n in found)
    cases = [chunks, ["apples.", "spacecraft."], ["x" * 5000, "x" * 5000], [], ["one"]]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, parts array<string>")
    merged, apart, cut, none, one = (r.text for r in rows.select("k", chunking.merge_texts(F.col("parts")).alias("text")).orderBy("k").collect())
    assert len(merged) == len(chunks[0]) + sum(len(c) - n if n else 2 + len(c) for c, n in zip(chunks[1:], found))
    assert merged.count(chunks[1][:60]) == 1
    assert (apart, cut, none, one) == ("apples.\n\nspacecraft.", "x" * 9600, "", "one")


def test_merged_expansion(spark):
    chunks = spark.createDataFrame([("c", "d", i, t) for i, t in enumerate(["one two", "two three", "four"])], "collection string, document string, chunk_index int, content string")
    anchors = spark.createDataFrame([("c", "d", 1, 50, 1), ("c", "d", 2, None, -3)], "collection string, document string, chunk_index int, before int, after int")
    got = chunking.merge_expanded(chunking.expand_anchors(anchors, chunks), ["anchor_index"]).collect()
    assert {(r.anchor_index, r.chunks_returned, r.content) for r in got} == {(1, 3, "one two three\n\nfour"), (2, 1, "four")}


def test_chunks_are_not_copied_for_every_word(spark):
    """Only words that a quote is looked up by take the text of a chunk along."""
    rows = [("c", "d", i, " ".join(f"w{i}x{j}" for j in range(40)) + "   end") for i in range(6)]
    chunks = spark.createDataFrame(rows, "collection string, document string, chunk_index int, content string")
    quotes = spark.createDataFrame(
        [(1, "c", "d", 2, "w2x3  w2x4 w2x5"), (2, "c", "d", 3, "w3x39 end w4x0"), (3, "c", "d", 1, "w1x7"), (4, "c", "d", 0, "w0x1 no w0x2"), (5, "c", "gone", 0, "w0x1 w0x2 w0x3")],
        "quote_id long, collection string, document string, chunk_index int, quote string")
    got = chunking.quote_coverage(quotes, chunks)
    made = {r.quote_id: (r.status, r.matched_chunk_index, r.index_match, r.doc_found) for r in got.collect()}
    assert made == {1: ("single", 2, True, True), 2: ("boundary", 3, None, True), 3: ("single", 1, True, True), 4: ("missing", None, None, True), 5: ("missing", None, None, False)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate" in line]
    assert generated and not any("_two#" in line.split("), [", 1)[-1] for line in generated), generated


def test_texts_are_cut_once_behind_the_join(spark):
    """No filter on the chunks is moved below the join, where it would cut the texts that the join drops."""
    docs = spark.createDataFrame([("c", f"d{i}", "aa bb cc dd") for i in range(20)], "collection string, document string, content string")
    cut = chunking.chunk_documents(docs.repartition(2).join(docs.filter("document = 'd3'").select("document"), "document", "left_semi"), 6, 0)
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.chunk_index, r.content, r.total_chunks) for r in cut.collect()) == [(0, "aa bb", 2), (1, "cc dd", 2)]


def test_batches_are_cut_in_slices():
    texts = pa.array(["x" * 60, "y" * 50, None, "", "z" * 500, "u", "v"])
    cut = list(chunking.slices(texts.slice(0), 100))
    assert [len(c) for c in cut] == [2, 3, 2] and pa.concat_arrays(cut).equals(texts)
    assert list(chunking.slices(texts.slice(0, 0), 100)) == []
