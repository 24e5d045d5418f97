"""A store of postings for batch search by weighted terms: words of texts, or dimensions of sparse vectors.

The store is a table with a row per term and shard. A shard is a bounded stretch of the scanned chunks, numbered in key order; a posting
list holds the numbers of the chunks that have the term, their weights, and for every RANGE chunk numbers the largest weight (and the
shortest length) in it. One more row per shard, without term, holds the keys. Building reads each chunk once and shuffles
nothing; a frequent term is spread over shards as its chunks are.

A search reads the lists of asked terms only. In each shard a query first scores the ranges that promise most; when what the
next range could reach falls below the k-th score found, it ends. So a shard sends k rows per query on, and no (query, chunk) row is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sondeo.functions.best import SCORE_CELLS, Best
from sondeo.session import checkpointed

#: Chunks, and terms of chunks, in a shard; chunk numbers in a range; queries that meet a shard together.
SHARD_CHUNKS, SHARD_TERMS, RANGE, BLOCK_QUERIES = 65536, 1_000_000, 128, 1024
#: Ranges scored first; each further step takes twice as many.
FIRST_RANGES = 16
#: (query, term) rows up to which they are sent to all tasks; more are shuffled.
MAX_SENT = 1_000_000
SLACK = 1e-7
#: Lists of at most so many terms are made a matrix if they fill at least one cell in so many.
MATRIX_TERMS, MATRIX_CELLS = 4096, 16

_LISTS = "shard long, term {term}, n long, chunks binary, weights binary, lengths binary, tops binary, lows binary, keys binary, total long"


# -- building ------------------------------------------------------------------------------------------------------------

Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def build(chunks: DataFrame, keys: list[str], terms: str, weights: str | None = None, weigh: Weigh | None = None) -> DataFrame:
    """The store of ``chunks``: ``terms`` is an array column, ``weights`` one beside it. Without weights a term weighs as often as it
    occurs; ``weigh`` may turn chunk numbers, term numbers and these counts into a mask of postings to keep and their weights. Lengths
    (numbers of terms) are kept where counts are. Null arrays count as empty. Write the result before searching it more than once."""
    kind = dict(chunks.select(F.col(terms)).dtypes)[terms].removeprefix("array<").removesuffix(">")
    given = chunks.select(*keys, F.col(terms).alias("_terms"), *([F.col(weights).alias("_weights")] if weights else []))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 24, [], 0
        for frame in frames:
            for part, n in _portions(frame):
                if held and (size + n > SHARD_TERMS or sum(x.num_rows for x in held) + part.num_rows > SHARD_CHUNKS):
                    yield from _inverted(pa.Table.from_batches(held), keys, shard, weigh)
                    shard, held, size = shard + 1, [], 0
                held.append(part)
                size += n
        if size or any(x.num_rows for x in held):
            yield from _inverted(pa.Table.from_batches(held), keys, shard, weigh)

    return given.mapInArrow(run, _LISTS.format(term=kind))


def _portions(frame: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The rows of a batch in portions of a shard's chunks and terms at most, with their terms; a row of more terms is one of its own."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(frame.column("_terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < frame.num_rows:
        end = max(at + 1, min(at + SHARD_CHUNKS, int(np.searchsorted(upto, upto[at] + SHARD_TERMS, "right")) - 1))
        yield frame.slice(at, end - at), int(upto[end] - upto[at])
        at = end


def _inverted(table: pa.Table, keys: list[str], shard: int, weigh: Weigh | None) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks().sort_by([(c, "ascending") for c in keys])
    lists = table.column("_terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[code] * max(len(size), 1) + np.repeat(np.arange(len(size)), size)
    whole = "_weights" not in table.column_names
    if whole:
        place, weight = np.unique(place, return_counts=True)
    else:
        by = np.argsort(place, kind="stable")
        weight = table.column("_weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)[by]
        place = place[by]
    term, chunk = place // max(len(size), 1), place % max(len(size), 1)
    if weigh is not None:
        kept, weight = weigh(chunk, term, weight)
        term, chunk, weight = term[kept], chunk[kept], weight[kept]
    first = np.searchsorted(term, np.arange(len(order) + 1))
    starts = np.flatnonzero(np.diff(term * (1 << 32) + chunk // RANGE, prepend=-1))
    tops = np.maximum.reduceat(np.abs(weight), starts) if len(starts) else np.empty(0)
    lows = np.minimum.reduceat(size[chunk], starts) if len(starts) else np.empty(0, np.int64)
    range_first = np.searchsorted(starts, first)
    sliced = lambda values, kind, at: pa.array([values[a:b].astype(kind).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
    none, n = pa.nulls(len(order), pa.binary()), np.diff(first)
    words = words.take(pa.array(order))
    empty_lists = n == 0
    named = ["shard", "term", "n", "chunks", "weights", "lengths", "tops", "lows", "keys", "total"]
    lists_of = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(order), shard)), words, pa.array(n), sliced(chunk, "<i4", first), sliced(weight, "<f8", first),
         sliced(size[chunk], "<i4", first) if whole else none, sliced(tops, "<f8", range_first), sliced(lows, "<i4", range_first) if whole else none, none,
         pa.nulls(len(order), pa.int64())], names=named)
    yield lists_of.filter(pa.array(~empty_lists)) if empty_lists.any() else lists_of
    sink = pa.BufferOutputStream()
    stored = table.select(keys)
    with pa.ipc.new_stream(sink, stored.schema) as writer:
        writer.write_table(stored)
    empty = pa.nulls(1, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, words.type), pa.array([len(size)]), *[empty] * 5, pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                                      pa.array([int(size.sum())])], names=named)


def corpus(store: DataFrame) -> DataFrame:
    """One row ``n_chunks, mean_length``."""
    heads = store.filter(F.col("term").isNull())
    return heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), (F.sum("total") / F.sum("n")).alias("mean_length"))


def frequencies(store: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df`` of the terms in ``terms`` that some chunk has."""
    return store.select("term", "n").join(_sent(terms.select("term").distinct(), terms.count()), "term").groupBy("term").agg(F.sum("n").alias("df"))


def _sent(few: DataFrame, rows: int) -> DataFrame:
    """``few``, sent to all tasks if it has no more than MAX_SENT rows."""
    return F.broadcast(few) if rows <= MAX_SENT else few


# -- searching -----------------------------------------------------------------------------------------------------------

class Saturation:
    """What a term's occurrences weigh: k1 bounds repeats, b says how far long chunks count less."""

    def __init__(self, k1: float, b: float, mean_length: float):
        self.k1, self.b, self.mean = k1, b, mean_length

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))


class Shard:
    """The asked posting lists of one shard."""

    def __init__(self, rows: pa.Table, weigh: Saturation | None):
        self.lists: dict = {}
        self.queries: list[dict] = []
        for row in rows.to_pylist():
            if row["term"] is None:
                self.keys = pa.ipc.open_stream(row["keys"]).read_all()
                self.queries = row["queries"]
                continue
            weight, top = np.frombuffer(row["weights"], "<f8"), np.frombuffer(row["tops"], "<f8")
            if weigh is not None:
                # A range promises what its most occurrences would weigh in its shortest chunk.
                weight, top = weigh(weight, np.frombuffer(row["lengths"], "<i4")), weigh(top, np.frombuffer(row["lows"], "<i4"))
            chunks = np.frombuffer(row["chunks"], "<i4")
            ranges = chunks // RANGE
            starts = np.flatnonzero(np.diff(ranges, prepend=-1))
            self.lists[row["term"]] = (chunks, weight, ranges[starts], np.append(starts, len(chunks)), top)

    def with_all(self, terms: list, factors: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that have all terms, and their scores. The shortest list is looked up in the others, so its length bounds the work."""
        order = sorted(range(len(terms)), key=lambda t: len(self.lists[terms[t]][0]))
        found = self.lists[terms[order[0]]][0]
        for t in order[1:]:
            chunks = self.lists[terms[t]][0]
            found = found[chunks[np.minimum(np.searchsorted(chunks, found), len(chunks) - 1)] == found]
        score = np.zeros(len(found))
        for term, factor in zip(terms, factors):
            chunks, weight = self.lists[term][:2]
            score += factor * weight[np.searchsorted(chunks, found)]
        return found, score

    def with_any(self, terms: list, factors: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """At least the best ``k`` chunks by score (ties by number) among those that have a term, all ranges skipped that hold none."""
        lists = [self.lists[t] for t in terms]
        promise = np.zeros(-(-self.keys.num_rows // RANGE))
        touched = np.zeros(len(promise), bool)
        for (_, _, ranges, _, top), factor in zip(lists, factors):
            promise[ranges] += abs(factor) * top
            touched[ranges] = True
        order = np.argsort(-promise, kind="stable")
        order = order[touched[order]]
        found, scores, at, step = np.empty(0, np.int64), np.empty(0), 0, FIRST_RANGES
        place = np.empty(len(promise), np.int64)
        while at < len(order):
            if len(scores) >= k and promise[order[at]] < np.partition(scores, len(scores) - k)[len(scores) - k] - SLACK:
                break
            some = np.sort(order[at:at + step])
            at, step = at + step, 2 * step
            place[:] = -1
            place[some] = np.arange(len(some))
            total, hit = np.zeros(len(some) * RANGE), np.zeros(len(some) * RANGE, bool)
            for (chunks, weight, ranges, bounds, _), factor in zip(lists, factors):
                mine = np.flatnonzero(place[ranges] >= 0)
                if len(mine) == len(ranges):
                    inside = slice(None)
                else:
                    first, n = bounds[mine], bounds[mine + 1] - bounds[mine]
                    inside = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                picked = chunks[inside]
                slot = place[picked // RANGE] * RANGE + picked % RANGE
                total[slot] += factor * weight[inside]
                hit[slot] = True
            slots = np.flatnonzero(hit)
            found = np.concatenate([found, some[slots // RANGE] * RANGE + slots % RANGE])
            scores = np.round(np.concatenate([scores, total[slots]]), 9)
            if len(scores) > k:
                best = np.lexsort((found, -scores))[:k]
                found, scores = found[best], scores[best]
        return found, scores

    def filled(self) -> bool:
        """Whether most chunks have many of the asked terms: then no range can be skipped, and a product of matrices costs less than the
        lists do one by one. Weights that are not positive do not show in a product whether a term is there."""
        held = sum(len(chunks) for chunks, *_ in self.lists.values())
        return (0 < len(self.lists) <= MATRIX_TERMS and MATRIX_CELLS * held >= len(self.lists) * self.keys.num_rows
                and all((weight > 0).all() for _, weight, *_ in self.lists.values()))

    def with_any_of(self, asked: list[tuple[list, list[float]]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``with_any`` finds, for many (terms, factors above zero): asked terms by chunks, in tiles of chunks."""
        place = {term: i for i, term in enumerate(self.lists)}
        vectors = np.zeros((len(asked), len(place)))
        for i, (terms, factors) in enumerate(asked):
            np.add.at(vectors[i], [place[t] for t in terms], factors)
        best, n = Best(vectors, k, positive=True), self.keys.num_rows
        tile = max(1, SCORE_CELLS // len(place))
        for start in range(0, n, tile):
            matrix = np.zeros((min(tile, n - start), len(place)))
            for i, (chunks, weight, *_) in enumerate(self.lists.values()):
                inside = slice(*np.searchsorted(chunks, [start, start + len(matrix)]))
                matrix[chunks[inside] - start, i] = weight[inside]
            best.add(matrix, np.arange(start, start + len(matrix)))
        for rows, scores in zip(best.rows, best.scores):
            yield rows[rows >= 0], scores[rows >= 0]

    def best(self, query: dict, k: int, all_first: bool, later: list | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
        """The best ``k`` chunks, and whether they are whole. A query for any term that ``later`` may take is put there instead."""
        here = [t for t in query["terms"] if t["term"] in self.lists]
        terms, factors = [t["term"] for t in here], [t["weight"] for t in here]
        if all_first and terms and len(terms) == query["n_terms"]:
            found, score = self.with_all(terms, factors)
            if len(found):
                score = np.round(score, 9)
                best = np.lexsort((found, -score))[:k]
                return found[best], score[best], True
        if not terms:
            return np.empty(0, np.int64), np.empty(0), False
        whole = not all_first or len(terms) == query["n_terms"] == 1
        if later is not None and min(factors) > 0:
            later.append((query["query_id"], terms, factors, whole))
            return np.empty(0, np.int64), np.empty(0), False
        found, score = self.with_any(terms, factors, k)
        return found, score, whole


def _scored(k: int, all_first: bool, weigh: Saturation | None, keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, weigh)
        ids, chunks, scores, whole = [], [np.empty(0, np.int64)], [np.empty(0)], []
        later: list | None = [] if shard.filled() else None

        def take(query_id, found: np.ndarray, score: np.ndarray, complete: bool) -> None:
            ids.extend([query_id] * len(found))
            whole.extend([complete] * len(found))
            chunks.append(found)
            scores.append(score)

        for query in shard.queries:
            take(query["query_id"], *shard.best(query, k, all_first, later))
        if later:
            for (query_id, _, _, complete), (found, score) in zip(later, shard.with_any_of([(t, f) for _, t, f, _ in later], k)):
                take(query_id, found, score, complete)
        taken = shard.keys.take(pa.array(np.concatenate(chunks)))
        return pa.table({"query_id": pa.array(ids, rows.schema.field("queries").type.value_type.field("query_id").type), **{c: taken.column(c) for c in keys},
                         "raw": np.concatenate(scores), "whole": pa.array(whole, pa.bool_())})
    return run


def search(store: DataFrame, asked: DataFrame, k: int, keys: list[tuple[str, str]], all_first: bool = False, weigh: Saturation | None = None) -> DataFrame:
    """``query_id, keys, raw, whole``: for every query and shard its best ``k`` chunks, the best ``k`` of all shards among them.

    ``asked`` has query_id, term, weight, n_terms; a chunk scores the products of weights over the terms it has, rounded to nine digits.
    With ``all_first`` chunks that have all of a query's terms are whole, and a shard that has such chunks gives no others.
    ``keys`` are the stored key columns with their types. Queries meet the shards in blocks of bounded size."""
    asked = checkpointed(asked)  # made once, read for the blocks, the lists and the queries
    queries, rows = asked.agg(F.count_distinct("query_id"), F.count("*")).first()
    blocks = max(1, -(-queries // BLOCK_QUERIES))
    placed = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    term = F.struct("term", F.col("weight").cast("double").alias("weight"))
    each = placed.groupBy("_block", "query_id", "n_terms").agg(F.sort_array(F.collect_list(term)).alias("terms"))
    packed = each.groupBy("_block").agg(F.collect_list(F.struct("query_id", "n_terms", "terms")).alias("queries"))
    heads = store.filter(F.col("term").isNull()).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "_block")
    lists = store.join(_sent(placed.select("term", "_block").distinct(), rows), "term")
    columns = ["_block", "shard", "term", "chunks", "weights", "lengths", "tops", "lows", "keys"]
    met = lists.select(*columns, F.lit(None).cast(heads.schema["queries"].dataType).alias("queries")).unionByName(heads.select(*columns, "queries"))
    names = [c for c, _ in keys]
    schema = f"query_id {dict(asked.dtypes)['query_id']}, {', '.join(f'{c} {t}' for c, t in keys)}, raw double, whole boolean"
    return met.groupBy("_block", "shard").applyInArrow(_scored(k, all_first, weigh, names), schema)
