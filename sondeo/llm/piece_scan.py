"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A document of at most CHUNK characters is encoded in one go. A longer one is cut into chunks wherever they end. A piece may reach over
the cut by fewer characters than the longest piece has; how far is the state at a cut, and a chunk is a matrix: the best score
from each state at its start to each one at its end. Max-plus products of matrices are associative, so all prefixes of a document's
chunks come from a scan that doubles its reach at every step. With the scores of the states it starts from, each chunk finds by
itself the best path into each state at its end. Going back through the chunks only looks up which state each path came in by."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import cut, needed, tidy
from sondeo.llm.unigram import NONE, PRE_TOKEN, Vocabulary, vocabulary

CHUNK = 65_536


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    out = np.max(a[..., :, :, None] + b[..., None, :, :], axis=-2)
    return np.where(out < NONE // 2, NONE // 2, out)


def prefixes(matrices: np.ndarray) -> np.ndarray:
    """Products of all leading runs of a stack: each step combines every run with the one that ends where it begins."""
    out, reach = matrices.copy(), 1
    while reach < len(out):
        out[reach:] = product(out[:-reach].copy(), out[reach:])
        reach *= 2
    return out


def _breaks(s: str, end: int, states: int) -> tuple[int, int]:
    """The first forced break at or after all states at the chunk's start, and the last one up to its end; (-1, -1) if there are none."""
    forced = [m.start() for m in PRE_TOKEN.finditer(s) if 0 < m.start() <= end]
    inner = [p for p in forced if p >= states - 1 and (s[p] == "\n" or s[p - 1] == "\n" or (s[p] == " " and s[p - 1] != " "))]
    return (inner[0], inner[-1]) if inner else (-1, -1)


def transfer(vocab: Vocabulary, s: str, end: int) -> np.ndarray:
    """The matrix of the chunk ``s[:end]``; the rest of ``s`` is what a piece may reach into."""
    states = vocab.longest
    out = np.full((states, states), NONE // 2, np.int64)
    first, last = _breaks(s, end, states)
    head = first if first >= 0 else end
    tail = np.full(states, NONE // 2, np.int64)
    if first >= 0:
        rest = s[last:]
        best = [0] + [NONE] * len(rest)
        vocab.forward(rest, best, end - last)
        reached = best[end - last:end - last + states]
        middle = sum(vocab.solve(t)[0] for t in PRE_TOKEN.findall(s[first:last]))
        tail[:len(reached)] = [middle + x if x != NONE else NONE // 2 for x in reached]
    for state in range(min(states, head + 1)):
        part = s[state:first] if first >= 0 else s[state:]
        best = [0] + [NONE] * len(part)
        vocab.forward(part, best, head - state)
        if first >= 0:
            if best[-1] != NONE:
                out[state] = np.maximum(best[-1] + tail, NONE // 2)
        else:
            reached = best[end - state:end - state + states]
            out[state, :len(reached)] = [x if x != NONE else NONE // 2 for x in reached]
    return out


def backtrace(vocab: Vocabulary, s: str, end: int, scores: list[int]) -> tuple[list[int], list[list[int] | None]]:
    """For each state at the chunk's end: the state at its start that the best path comes from, and the path's ids."""
    states = vocab.longest
    best = [x if x > NONE // 4 else NONE for x in scores[:len(s) + 1]]
    best += [NONE] * (len(s) + 1 - len(best))
    back = vocab.forward(s, best, end)
    entries, ids = [0] * states, [None] * states
    for state in range(min(states, len(s) - end + 1)):
        if best[end + state] != NONE and (state == 0 or back[end + state] > state):
            entries[state], ids[state] = vocab.trace(s, back, end + state)
    return entries, ids


def _cut_up(frames: Iterator[pa.RecordBatch], chunk: int, states: int) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for key, value in zip(batch.column(0), batch.column(1)):
            s = " " + value.as_py()
            starts = list(range(0, max(len(s) - chunk, 1), chunk)) if len(s) > chunk else [0]
            ends = [*starts[1:], len(s)]
            for k, (a, b) in enumerate(zip(starts, ends)):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([k], pa.int64()), pa.array([s[a:b + states - 1]]), pa.array([b - a], pa.int64())], ["key", "k", "s", "size"])


def _scan(table: pa.Table, states: int) -> pa.Table:
    """One document's matrices; each chunk's scores of the states it starts from, when the document starts in state 0."""
    table = table.sort_by("k")
    stack = np.stack([np.frombuffer(x, np.int64).reshape(states, states) for x in table.column("matrix").to_pylist()])
    start = np.full(states, NONE // 2, np.int64)
    start[0] = 0
    scores = np.vstack([start, prefixes(stack)[:-1, 0, :]])
    return pa.table({"key": table.column("key"), "k": table.column("k"), "scores": pa.array(list(scores), pa.list_(pa.int64()))})


def _walk_back(table: pa.Table) -> pa.Table:
    """One document's tables of where paths come in; the state at each chunk's end on the best path, which ends in state 0."""
    table = table.sort_by("k")
    state, exits = 0, []
    for entries in reversed(table.column("entries").to_pylist()):
        exits.append(state)
        state = int(entries[state])
    return pa.table({"key": table.column("key"), "k": table.column("k"), "state": pa.array(exits[::-1], pa.int64())})


def encode_giants(rows: DataFrame, model: str, chunk: int) -> DataFrame:
    """``key, ids`` for rows ``key long, text`` of long texts."""
    states = vocabulary(model).longest
    chunks = cut(rows.mapInArrow(lambda frames: _cut_up(frames, chunk, states), "key long, k long, s string, size long").repartition("key", "k"))

    def matrices(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            found = [transfer(vocabulary(model), s, n).tobytes() for s, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["key", "k", "matrix"])

    def paths(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            found = [backtrace(vocabulary(model), s, n, v) for s, n, v in zip(*(batch.column(c).to_pylist() for c in ("s", "size", "scores")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array([e for e, _ in found], pa.list_(pa.int32())),
                                              pa.array([i for _, i in found], pa.list_(pa.list_(pa.int32())))], ["key", "k", "entries", "ids"])

    scores = chunks.mapInArrow(tidy(matrices), "key long, k long, matrix binary").groupBy("key").applyInArrow(lambda t: _scan(t, states), "key long, k long, scores array<long>")
    traced = cut(chunks.join(scores, ["key", "k"]).mapInArrow(tidy(paths), "key long, k long, entries array<int>, ids array<array<int>>"))
    exits = traced.select("key", "k", "entries").groupBy("key").applyInArrow(_walk_back, "key long, k long, state long")
    chosen = traced.join(exits, ["key", "k"]).select("key", "k", F.element_at("ids", (F.col("state") + 1).cast("int")).alias("ids"))
    return chosen.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``id_col, ids, source_crc32``: every row's whole text as piece ids, and the checksum of the text's UTF-8 bytes.

    Null and empty texts have an empty list; repeated rows are encoded alike; an empty table gives an empty result. Columns other
    than the two named are not read. Lone surrogates do not occur in a column of texts."""
    given = needed(docs, id=id_col, text=text_col).withColumn("crc", F.crc32(F.coalesce("text", F.lit(""))))
    kind = dict(given.dtypes)["id"]
    length = F.coalesce(F.length("text"), F.lit(0))

    def small(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [np.frombuffer(vocabulary(model).packed(t), "<i4") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), part.column(2)], ["id", "ids", "crc"])

    whole = given.where(length < chunk).mapInArrow(tidy(small), f"id {kind}, ids array<int>, crc long")
    long = cut(given.where(length >= chunk).withColumn("key", F.monotonically_increasing_id()))
    found = encode_giants(long.select("key", "text"), model, chunk)
    giants = long.select("key", "id", "crc").join(found, "key").select("id", "ids", "crc")
    return whole.union(giants).withColumnsRenamed({"id": id_col, "crc": "source_crc32"})


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` from ids; null as from an empty list, which is the empty text. Control ids stand for nothing."""
    given = needed(rows, id=id_col, ids=ids_col)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [vocabulary(model).decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return given.mapInArrow(tidy(read), f"id {dict(given.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def round_trip(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """What `encode` gave, with ``n_tokens, ids_crc32`` (of little-endian 32-bit ids) and ``text_crc32`` of the text that the ids decode to."""
    given = encoded.select(F.col(f"`{id_col}`").alias("id"), "ids", "source_crc32")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for x in part.column(1):
                    ids = x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)
                    text = b"".join(map(vocabulary(model).bytes_of.__getitem__, ids.tolist()))[1:]
                    out.append((len(ids), zlib.crc32(ids.astype("<i4")), zlib.crc32(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.int64()) for c in zip(*out)]], [*part.schema.names, "n_tokens", "ids_crc32", "text_crc32"])

    return given.mapInArrow(tidy(read), f"id {dict(given.dtypes)['id']}, ids array<int>, source_crc32 long, n_tokens long, ids_crc32 long, text_crc32 long").withColumnRenamed("id", id_col)
