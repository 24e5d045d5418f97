"""Alignment, runs and packing, and the unit encoders below them, beside plain Python."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sondeo.llm import gap_packing, queries, repeats, token_alignment, unit_ids

SF = "/root/testdata/sf0.001"
RANDOM = random.Random(8)
WORDS = ["the", "The", "can't", "'s", "it's", "a", "x2", "2x", "naïve", "日本語", "#$%", "e.g.", "\U0001f600", "é", " ", "▁", "<|endoftext|>", "<0x0A>", "<s>", "tt\x1f", "　z",
         "İ", "ß", "̸", "≠", "ö", "...", "''s", "%'s", "a'b", "«q»"]
SPACES = [" ", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "   ", "\x0b", "\x0c "]
MIXED = ["".join(RANDOM.choice(WORDS) + RANDOM.choice(SPACES) for _ in range(RANDOM.randint(0, 40))) for _ in range(150)]
MIXED += [RANDOM.choice(SPACES) + t + RANDOM.choice(WORDS) for t in MIXED[:60]]
MIXED += ["".join(RANDOM.choice(WORDS + SPACES) for _ in range(30)) for _ in range(150)]
TEXTS = [None, "", " ", "\n\n", "word", "a b c " * 900, "日本" * 3000, "<|endoftext|>", "x" * 3000, *MIXED[:60], MIXED[3], MIXED[3]]
COLUMNS = "doc_id long, text string, row long, ids string, key long, pairs string, group long, item long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 9 else None, t, 1, "i", 2, "p", 3, 4) for k, t in enumerate(TEXTS)] + [(4, "word", 1, "i", 2, "p", 3, 4)] * 3
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


def texts_of(encoder, texts):
    ids, bounds, fair = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])], fair


@pytest.mark.parametrize("kind, file, plain", [(unit_ids.ByteUnits, "byte_bpe_50k.json", True), (unit_ids.ByteUnits, "byte_bpe_50k.json", False), (unit_ids.WordUnits, "word_bpe_49k.json", False)])
def test_units_equal_the_library(kind, file, plain):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    library.encode_special_tokens = plain
    encoder = kind(public_tokenizers.path(file), plain)
    texts = MIXED + [t or "" for t in TEXTS]
    for _ in range(2):
        for at in range(0, len(texts), 50):
            assert texts_of(encoder, texts[at:at + 50])[0] == [library.encode(t, add_special_tokens=False).ids for t in texts[at:at + 50]]


def test_pieces_equal_the_library(monkeypatch):
    monkeypatch.setattr(unit_ids, "KEPT_UNITS", 40)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder = unit_ids.PieceUnits(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in MIXED + TEXTS if t]
    for at in range(0, len(texts), 20):
        some = texts[at:at + 20]
        found, fair = texts_of(encoder, [" " + t for t in some])
        assert found == model.encode(some)
        spelled = [b"".join(unit_ids.piece_bytes(model, k) for k in x) for x in found]
        assert fair.tolist() == [s == b" " + t.encode() for s, t in zip(spelled, some)]


@pytest.mark.parametrize("kind, given", [(unit_ids.ByteUnits, ("byte_bpe_50k.json", True)), (unit_ids.PieceUnits, ("piece_bpe_32k.model",))])
def test_new_units_are_learnt_a_few_at_a_time(kind, given, monkeypatch):
    whole, few = (kind(public_tokenizers.path(given[0]), *given[1:]) for _ in range(2))
    texts = [" " + t for t in MIXED if t]
    expected, sizes, ids_of = whole.encode(texts), [], few.ids_of
    monkeypatch.setattr(unit_ids, "LEARNT_UNITS", 7)
    monkeypatch.setattr(few, "ids_of", lambda units: sizes.append(len(units)) or ids_of(units))
    for _ in range(2):
        assert all((x == y).all() for x, y in zip(few.encode(texts), expected, strict=True))
    assert len(sizes) > 7 and max(sizes) == 7 and sum(sizes) == len(few.first) == len(whole.first)


def test_a_block_of_alignments_needs_little_memory():
    aligner = token_alignment.Aligner(queries.BYTE_BPE, queries.PIECES)
    text = [" ".join(RANDOM.choice(["some", "words", "of", "every", "sort", str(k)]) for k in range(400)) for _ in range(400)]
    found = aligner.align(text)
    tracemalloc.start()
    aligner.written(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 56 * (len(found["a"]) + len(found["b"]))


def test_merge_pieces_find_all_common_ends():
    for _ in range(200):
        a, b = (np.array(sorted(RANDOM.sample(range(1, 60), RANDOM.randint(0, 40)))) for _ in range(2))
        for steps in (1, 2, 3, 7, 1000):
            i, j = token_alignment.common_ends(a, b, steps)
            assert [(a[x], b[y]) for x, y in zip(i, j)] == [(v, v) for v in sorted(set(a.tolist()) & set(b.tolist()))]


def aligned(texts):
    """Groups of each text as ((A ids, B ids), ...), by plain loops."""
    one = Tokenizer.from_file(queries.BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    from tokenizers.decoders import ByteLevel  # noqa: F401
    letters = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    places = {chr(x): x for x in letters} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters)}
    out = []
    for text in texts:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(places[c] for c in one.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and two.is_byte(t) else p.replace("▁", " ").encode() for t, p in ((t, two.id_to_piece(t)) for t in b)]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            out.append(())
            continue
        groups, x, y, at_a, at_b, mine, theirs = [], 0, 0, 0, 0, [], []
        while x < len(a) or y < len(b):
            if at_a <= at_b:
                at_a += len(a_bytes[x])
                mine.append(a[x])
                x += 1
            else:
                at_b += len(b_bytes[y])
                theirs.append(b[y])
                y += 1
            if at_a == at_b:
                groups.append((tuple(mine), tuple(theirs)))
                mine, theirs = [], []
        out.append(tuple(groups))
    return out


def test_alignment(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    groups = aligned([r.text for r in rows])
    counts = collections.Counter((g[0][-1], g[1][-1]) for found in groups for g in found)
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for row, found in zip(rows, groups):
        links = [(g[0][-1], g[1][-1]) for g in found]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        want.append((row.doc_id, sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), len(links), sum(counts[x] == highest[x[1]] for x in links),
                     sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    got = token_alignment.alignment_counts(docs, queries.BYTE_BPE, queries.PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want)
    whole = token_alignment.align(docs, queries.BYTE_BPE, queries.PIECES).collect()
    assert order((r.doc_id, len(r.a_ids), len(r.b_ids), len(r.a_ends)) for r in whole) == order((w[0], w[1], w[2], w[3]) for w in want)
    by_id = {r.doc_id: r for r in whole if r.doc_id is not None and r.doc_id != 4}
    for row, found in zip(rows, groups):
        if row.doc_id in by_id:
            r, a, b, cut = by_id[row.doc_id], 0, 0, []
            for i, j in zip(r.a_ends, r.b_ends):
                cut.append((tuple(r.a_ids[a:i + 1]), tuple(r.b_ids[b:j + 1])))
                a, b = i + 1, j + 1
            assert tuple(cut) == found
    assert token_alignment.alignment_counts(docs.limit(0), queries.BYTE_BPE, queries.PIECES).count() == 0


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i > first and i - first + q >= max(6, 4 * q):
                part = w[first - q:i]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((first - q, len(part), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    for _ in range(400):
        texts = []
        for _ in range(RANDOM.randint(0, 3)):
            w = []
            for _ in range(RANDOM.randint(0, 6)):
                part = [RANDOM.randint(0, RANDOM.choice([1, 2, 5])) for _ in range(RANDOM.randint(1, 20))]
                w += (part * RANDOM.randint(1, 7))[:RANDOM.randint(1, 140)]
            texts.append(w)
        flat = np.array([x for w in texts for x in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found = repeats.runs(flat, np.repeat(np.arange(len(texts)), [len(w) for w in texts]))
        want, base = [], 0
        for w in texts:
            want += [(base + s, length, q) for s, length, q in brute_runs(w)]
            base += len(w)
        assert list(zip(*(x.tolist() for x in found))) == want


def run_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    text = "".join("%d,%d,%d\n" % r for r in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs(spark, docs):
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, " ".join("w%d" % (j % (3 + k)) for j in range(60)) + " z" * (k % 9)) for k in range(80)], "doc_id long, text string"))
    got = repeats.detect(many.withColumns({"start": F.lit(1), "n_runs": F.lit("x")}))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((run_row(r.doc_id, r.text) for r in many.collect()), key=str)
    assert repeats.detect(docs.limit(0)).count() == 0


def test_a_long_text_of_one_word_takes_one_pass(spark):
    """Every lag of such a text matches everywhere: 300,000 words would be 10^10 pairs."""
    text = "a " * 300_000 + " ".join("q%d" % (k % 50_000) for k in range(250_000))
    (row,) = repeats.detect(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (2, 0, 300_000, 1)


def test_pack_prefers_the_least_squares():
    gaps = gap_packing.Gaps(10)
    for gap in (4, 4, 7, 6):
        gaps.move(0, 0, gap)
    # Into 4: 4+1+1 -> 1+1+1 and gap 1; into 6: 4+1 and gap 3; into 7: makes a third 4.
    assert gaps.place(3) == 4
    assert gaps.place(6) == 6
    assert gaps.place(8) == 0


@pytest.mark.parametrize("group", [200, 10_000])
def test_packed_sequences(spark, group):
    sizes = [RANDOM.choice([1, 1, 2, 5, 40, 90, 100]) for _ in range(1500)] + [100] * 20
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size int").repartition(5)
    found = gap_packing.placed(items, 100, group).collect()
    assert sorted(r.item for r in found) == list(range(len(sizes)))
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence].append((r.offset, sizes[r.item]))
    for parts in sequences.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 100
    fills = []
    for size in sorted(sizes, reverse=True):
        best = min((k for k, f in enumerate(fills) if f + size <= 100), key=lambda k: -fills[k], default=None)
        if best is None:
            fills.append(size)
        else:
            fills[best] += size
    assert len(sequences) <= len(fills) * 1.03 + 3
    assert sorted(map(tuple, gap_packing.placed(items.repartition(2), 100, group).collect())) == sorted(map(tuple, found))
    assert gap_packing.placed(items.limit(0), 100, group).count() == 0


def test_packed_documents(spark, docs, tmp_path):
    library = Tokenizer.from_file(queries.WORD_BPE)
    got = gap_packing.pack_documents(docs, queries.WORD_BPE, capacity=64, group=50)
    rows = got.collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, at // 64, at, len(ids[at:at + 64]), np.array(ids[at:at + 64], "<u4").tobytes()) for at in range(0, len(ids), 64)]
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    total = sum(w[3] for w in want)
    assert -(-total // 64) <= len({r.sequence_id for r in rows}) <= -(-total // 64) + 3
    gap_packing.write_sequences(got, str(tmp_path / "out"))
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert r.n_tokens * 4 == len(r.ids) and r.n_tokens <= 64
        assert [d.offset for d in r.documents] == np.cumsum([0, *(d.length for d in r.documents)]).tolist()[:-1]
    assert gap_packing.pack_documents(docs.limit(0), queries.WORD_BPE).count() == 0


@pytest.mark.parametrize("name", ["op11_token_alignment", "op12_periodic_runs", "op13_gap_packing"])
def test_queries_take_every_row(spark, name):
    got = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.select("doc_id").distinct().count() == n
    if name == "op12_periodic_runs":
        rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        found = {r.doc_id: tuple(r) for r in got.collect()}
        some = [k for k, t in rows.items() if len(t or "") < 5000]
        assert [found[k] for k in some] == [run_row(k, rows[k]) for k in some]
