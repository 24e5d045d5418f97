"""Batch retrieval: every query of a table against every chunk of another, exact top-k."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondeo.functions import ordered
from sondeo.functions.best import Best
from sondeo.operators import filters, postings
from sondeo.session import checkpointed, scratch_folder, tidy

# Candidate depths and list lengths of the search modes.
CANDIDATES = 50
RERANK_CANDIDATES = 30
RERANK_TOP_K = 4
RRF_K = 60
ALPHA = 0.8
BM25_K1 = 1.2
BM25_B = 0.75

KEY = ["collection", "document", "chunk_index"]
FILTERS = ["filter_collection", "filter_document", "filter_exclude"]

MAX_SHIPPED_BYTES = 32 * 2**20   # query vectors sent to every executor; beyond it they are shuffled in blocks
MAX_KEPT = 1_000_000             # (query, chunk) entries one task may keep while it reads its chunks
BLOCK_QUERIES = 16384
SHARD_CHUNKS = 2**19             # chunks that stream past one block, about
SCORE_CELLS = 2**21              # scores held at once while one batch is ranked
SPARE_KEYS = 2**18               # keys of rows that have left all lists, before they are dropped


# -- dense ---------------------------------------------------------------------------------------------------------------

def dense_top_k(
    queries: DataFrame, chunks: DataFrame, k: int, max_shipped_bytes: int = MAX_SHIPPED_BYTES, dims: list[int] | None = None
) -> DataFrame:
    """(query_id, rank, key, score): cosine similarity rounded to four digits, all chunks scored.

    With ``dims`` there is one list per query and vector length, named by the column dim: the first ``dim`` components
    of both sides are compared, and all lengths are ranked in the same pass over the chunks.

    ``queries`` has query_id (long), embedding and optionally filter_collection, filter_document, filter_exclude.
    Vectors stay in Arrow buffers; each task keeps its best k per query in arrays, so only those reach the final ranking.

    The query side is measured first. If it is small, every task gets it whole and chunks do not move. Otherwise
    queries are cut into bounded blocks, and in each task a shard of the chunks streams past one block.
    """
    for name in FILTERS:
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast("string"))
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), *FILTERS).filter(
        filters.has_vector(F.col("embedding")))
    c = chunks.select(*KEY, F.col("embedding").cast("array<float>").alias("embedding")).filter(filters.has_vector(F.col("embedding")))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"),
                 F.count_if(F.col("filter_collection").isNull()).alias("open")).first()
    if size["n"] and not size["open"]:
        c = c.join(q.select(F.col("filter_collection").alias("collection")).distinct(), "collection", "left_semi")
    schema = "dim int, query_id long, collection string, document string, chunk_index int, raw double"
    lengths = dims or [None]
    if size["n"] * ((size["dims"] or 0) * 8 + 64) * len(lengths) <= max_shipped_bytes and size["n"] * k * len(lengths) <= MAX_KEPT:
        shipped = queries.sparkSession.sparkContext.broadcast(_QueryBlock(q.toArrow(), lengths))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from shipped.value.best(batches, k)

        local = c.sortWithinPartitions(*KEY).mapInArrow(tidy(score), schema)
    else:
        local = _blockwise(q, c, k, size["n"], schema, lengths)
    names = ["dim", "query_id"] if dims else ["query_id"]
    best = ordered.top_k(local, names, [F.desc("raw"), *[F.asc(x) for x in KEY]], k)
    return best.select(*names, "rank", *KEY, F.round("raw", 4).alias("score"))


def _blockwise(q: DataFrame, c: DataFrame, k: int, n_queries: int, schema: str, lengths: list[int | None]) -> DataFrame:
    """Query blocks against chunk shards, a pair to a partition: its queries come first and are held, its chunks stream past them."""
    blocks = -(-n_queries // BLOCK_QUERIES)
    cores = q.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-max(c.count(), 1) // SHARD_CHUNKS), -(-2 * cores // blocks))
    block, shard = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), F.pmod(F.xxhash64(*KEY), F.lit(shards))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    left = q.withColumn("_shard", every(shards)).select(
        (F.col("_shard") * blocks + block).cast("int").alias("_pair"), F.lit(0).alias("_kind"), "query_id", F.col("embedding").alias("_asked"), *FILTERS,
        none("collection", "string"), none("document", "string"), none("chunk_index", "int"), none("embedding", "array<float>"))
    right = c.withColumn("_block", every(blocks)).select(
        (shard * blocks + F.col("_block")).cast("int").alias("_pair"), F.lit(1).alias("_kind"), none("query_id", "long"), none("_asked", "array<double>"),
        *[none(f, "string") for f in FILTERS], "collection", "document", F.col("chunk_index").cast("int").alias("chunk_index"), "embedding")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(_runs(batches), lambda run: run[0]):
            asked: list[pa.RecordBatch] = []
            for _, kind, part in parts:
                if kind:
                    if asked:
                        table = pa.Table.from_batches(asked).select(["query_id", "_asked", *FILTERS]).rename_columns(["query_id", "embedding", *FILTERS])
                        yield from _QueryBlock(table, lengths).best(chain([part], (p for _, _, p in parts)), k)
                    break
                asked.append(part)

    placed = left.unionByName(right).repartitionById(blocks * shards, F.col("_pair"))
    return placed.sortWithinPartitions("_pair", "_kind", *KEY).mapInArrow(tidy(score), schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The rows in stretches of one pair and kind."""
    for batch in batches:
        pair, kind = (batch.column(name).to_numpy() for name in ("_pair", "_kind"))
        edges = np.flatnonzero((np.diff(pair) != 0) | (np.diff(kind) != 0)) + 1
        for start, end in pairwise([0, *edges.tolist(), batch.num_rows]):
            if end > start:
                yield int(pair[start]), int(kind[start]), batch.slice(start, end - start)


_SCORED = pa.schema([("dim", pa.int32()), ("query_id", pa.int64()), ("collection", pa.string()), ("document", pa.string()),
                     ("chunk_index", pa.int32()), ("raw", pa.float64())])


class _QueryBlock:
    """Query vectors grouped by their filter, scaled for every vector length, and the ranking of chunk batches against them."""

    def __init__(self, table: pa.Table, lengths: list[int | None]):
        places: dict[tuple, list[int]] = {}
        for i, f in enumerate(zip(*[table.column(f).to_pylist() for f in FILTERS])):
            places.setdefault(f, []).append(i)
        self.groups = []
        for f, at in places.items():
            some = table.take(pa.array(at)).combine_chunks()
            sizes = pc.list_value_length(some.column("embedding")).unique().to_pylist()
            if len(sizes) > 1:
                raise ValueError(f"query vectors of several lengths: {sorted(sizes)}")
            vectors = pc.list_flatten(some.column("embedding")).to_numpy().reshape(len(at), -1)
            self.groups.append((f, some.column("query_id").combine_chunks(), vectors.shape[1], {d: _unit(vectors[:, :d]) for d in lengths}))

    def best(self, batches, k: int) -> Iterator[pa.RecordBatch]:
        """The best ``k`` of every query. Rows come in key order, so that of equal scores the earlier stay."""
        held = [{d: Best(vectors, k) for d, vectors in scaled.items()} for _, _, _, scaled in self.groups]
        keys, first = _Keys([best for lists in held for best in lists.values()]), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            numbered = pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*KEY, "embedding"]), pa.array(np.arange(first, first + batch.num_rows))],
                                                  names=[*KEY, "embedding", "_row"])
            entered = [np.empty(0, np.int64)]
            for (flt, _, width, _), lists in zip(self.groups, held):
                rows = _matching(numbered, flt)
                if rows.num_rows:
                    entered += _rank_batch(rows, width, lists)
            keys.keep(batch, first, np.unique(np.concatenate(entered)))
            first += batch.num_rows
        for (_, ids, _, _), lists in zip(self.groups, held):
            for dim, best in lists.items():
                query, place = np.nonzero(best.rows >= 0)
                for start in range(0, len(query), 10000):
                    some = query[start:start + 10000], place[start:start + 10000]
                    columns = [pa.nulls(len(some[0]), pa.int32()) if dim is None else pa.array(np.full(len(some[0]), dim, np.int32)), ids.take(pa.array(some[0])),
                               *keys.of(best.rows[some]), pa.array(best.scores[some])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _SCORED)], schema=_SCORED)


class _Keys:
    """Chunk keys of the rows in some list, by number. Rows that have left all lists are dropped when they are many."""

    def __init__(self, lists: list[Best]):
        self.lists, self.numbers, self.tables, self.limit = lists, [], [], SPARE_KEYS

    def keep(self, batch: pa.RecordBatch, first: int, numbers: np.ndarray) -> None:
        if len(numbers):
            self.numbers.append(numbers)
            self.tables.append(pa.Table.from_batches([batch]).select(KEY).take(pa.array(numbers - first)))
        if sum(map(len, self.numbers)) > self.limit:
            self._join()
            used = np.isin(self.numbers[0], np.concatenate([best.rows.ravel() for best in self.lists]))
            self.numbers, self.tables = [self.numbers[0][used]], [self.tables[0].filter(pa.array(used))]
            self.limit = SPARE_KEYS + 2 * len(self.numbers[0])

    def of(self, numbers: np.ndarray) -> list[pa.Array]:
        self._join()
        taken = self.tables[0].take(pa.array(np.searchsorted(self.numbers[0], numbers))).combine_chunks()
        return [taken.column(c).combine_chunks() for c in KEY]

    def _join(self) -> None:
        self.numbers, self.tables = [np.concatenate(self.numbers)], [pa.concat_tables(self.tables).combine_chunks()]


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matching(batch: pa.RecordBatch, flt: tuple) -> pa.RecordBatch:
    collection, include, exclude = flt

    def like(pattern: str):
        documents = batch.column("document")
        return pc.match_like(documents, pattern) if "%" in pattern else pc.equal(documents, pattern)

    masks = []
    if collection:
        masks.append(pc.equal(batch.column("collection"), collection))
    if include:
        masks.append(like(include))
    if exclude:
        masks.append(pc.invert(like(exclude)))
    for mask in masks[1:]:
        masks[0] = pc.and_(masks[0], mask)
    return batch.filter(masks[0]) if masks else batch


def _rank_batch(batch: pa.RecordBatch, width: int, lists: dict[int | None, Best]) -> list[np.ndarray]:
    """Ranks the batch against all queries; gives the numbers of the rows that entered a list."""
    lengths = pc.list_value_length(batch.column("embedding"))
    if lengths.null_count:
        batch, lengths = batch.filter(pc.is_valid(lengths)), lengths.drop_null()
    if not batch.num_rows:
        return []
    odd = pc.not_equal(lengths, width)
    if pc.any(odd).as_py():
        row = batch.filter(odd).slice(0, 1).select(KEY).to_pylist()[0]
        raise ValueError(f"a vector of another length than the queries' {width}: {row}")
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole, rows = flat.reshape(batch.num_rows, -1), batch.column("_row").to_numpy()
    return [best.add(_unit(whole[:, :dim]), rows, SCORE_CELLS) for dim, best in lists.items()]


def truncated(embedding: Column, dims: int) -> Column:
    """First ``dims`` components, scaled to unit length when their norm is above zero."""
    head = F.slice(embedding, 1, dims)

    def scale(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
        bound = F.struct(v.alias("v"), norm.alias("n"))
        return F.transform(F.array(bound), lambda b: F.when(
            b["n"] > 0, F.transform(b["v"], lambda x: x.cast("double") / b["n"])).otherwise(b["v"].cast("array<double>")))[0]

    return F.transform(F.array(head), scale)[0]


# -- sparse --------------------------------------------------------------------------------------------------------------

def exploded_map(df: DataFrame, keys: list[str], sparse: str) -> DataFrame:
    """Sparse vectors stored as map<int, float> to (keys, dim, weight)."""
    return df.select(*keys, F.explode(sparse).alias("dim", "weight")).withColumn("weight", F.col("weight").cast("double"))


KEY_TYPES = [("collection", "string"), ("document", "string"), ("chunk_index", "int")]


def sparse_store(chunks: DataFrame) -> DataFrame:
    """The postings of sparse vectors in long form (key, dim, weight), scaled to unit length. A vector has at most as many rows as
    active dimensions, so collecting it is bounded."""
    vectors = chunks.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("dim", "weight"))).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    scaled = vectors.withColumn("_norm", norm).select(
        *KEY, F.col("_v.dim").alias("dims"), F.transform("_v", lambda x: x["weight"] / F.col("_norm")).alias("weights"))
    return postings.build(scaled.withColumn("chunk_index", F.col("chunk_index").cast("int")), KEY, "dims", "weights")


def sparse_top_k(queries: DataFrame, chunks: DataFrame | None, k: int, store: DataFrame | None = None) -> DataFrame:
    """Cosine of sparse vectors in long form: queries (query_id, dim, weight), chunks (key, dim, weight).

    Chunks that share no dimension with a query would score 0 and are left out. Pass ``store``, written by ``sparse_store``, to search
    it many times; without one it is built for this search and used in passing."""
    asked = queries.withColumn("_norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("query_id")))).select(
        "query_id", F.col("dim").alias("term"), (F.col("weight") / F.col("_norm")).alias("weight"), F.lit(0).alias("n_terms"))
    store = store if store is not None else kept_store(sparse_store(chunks))
    found = postings.search(store, asked, k, KEY_TYPES)
    best = ordered.top_k(found, ["query_id"], [F.desc("raw"), *[F.asc(x) for x in KEY]], k)
    return best.select("query_id", "rank", *KEY, F.round("raw", 4).alias("score"))


def kept_store(store: DataFrame, path: str | None = None) -> DataFrame:
    """The store, written once; below the shared folder if no path is given."""
    path = path or scratch_folder(store.sparkSession)
    store.write.parquet(path)
    return store.sparkSession.read.parquet(path)


# -- lexical -------------------------------------------------------------------------------------------------------------

def explode_words(df: DataFrame, keys: list[str], words: str, out: str = "term") -> DataFrame:
    """One row per word. The outer form keeps Spark from deriving a size filter that would run the regular expression
    again, and before rows are spread; empty lists drop out afterwards."""
    return df.select(*keys, F.explode_outer(words).alias(out)).filter(F.col(out).isNotNull())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def lexical_store(chunks: DataFrame) -> DataFrame:
    """The postings of the words of ``content``. Texts are cut once, here."""
    return postings.build(chunks.select(*KEY, terms(F.col("content")).alias("_t")).withColumn("chunk_index", F.col("chunk_index").cast("int")), KEY, "_t")


def lexical_top_k(queries: DataFrame, chunks: DataFrame | None, k: int, store: DataFrame | None = None) -> DataFrame:
    """BM25 over chunks that hold all words of the query; where none does and the query has several words, any word.

    Pass ``store``, written by ``lexical_store``, to search it many times; without one it is built for this search."""
    store = store if store is not None else kept_store(lexical_store(chunks))
    asked = queries.select("query_id", F.array_distinct(terms(F.col("query"))).alias("_t")).withColumn("n_terms", F.size("_t"))
    words = checkpointed(explode_words(asked, ["query_id", "n_terms"], "_t"))
    corpus = postings.corpus(store).first()
    idf = F.log(1 + (corpus["n_chunks"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = words.join(postings.frequencies(store, words), "term").select("query_id", "term", idf.alias("weight"), "n_terms")
    weigh = postings.Saturation(BM25_K1, BM25_B, corpus["mean_length"] or 1.0)
    found = postings.search(store, weighted, k, KEY_TYPES, all_first=True, weigh=weigh)
    # Chunks with all words come first; where the best row is one of them, the others of its query drop out.
    best = ordered.top_k(found, ["query_id"], [F.desc("whole"), F.desc("raw"), *[F.asc(x) for x in KEY]], k)
    any_whole = F.max("whole").over(Window.partitionBy("query_id"))  # at most k rows
    kept = best.withColumn("_any", any_whole).filter(F.col("whole") | ~F.col("_any"))
    return kept.select("query_id", "rank", *KEY, F.round("raw", 4).alias("score"))


# -- reranking -----------------------------------------------------------------------------------------------------------

def apply_rerank(scored: DataFrame, k: int, keys: list[str] = ["query_id"]) -> DataFrame:
    """Candidates with an outside score, ``relevance``, ordered by it, best first; score rounded to six digits."""
    best = ordered.top_k(scored.withColumnRenamed("rank", "_was"), keys, [F.desc("relevance"), F.asc("_was")], k)
    return best.withColumn("score", F.round("relevance", 6)).drop("relevance", "_was")


def production_search(queries: DataFrame, chunks: DataFrame, score_pairs, candidates: int = RERANK_CANDIDATES, k: int = RERANK_TOP_K) -> DataFrame:
    """Dense candidates, reranked, cut to k, positive scores only. ``score_pairs`` adds ``relevance`` to the candidates."""
    return filters.positive_scores(apply_rerank(score_pairs(dense_top_k(queries, chunks, candidates)), k))


def with_ranks(hits: DataFrame, keys: list[str] = ["query_id"], tie: list[str] = KEY) -> DataFrame:
    """1-based positions by falling score. A result list is as long as its search depth."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *[F.asc(c) for c in tie])))
