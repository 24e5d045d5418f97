"""Model steps as batch functions over Arrow: bring your own encoder or scorer; small deterministic ones are bundled."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondeo.operators import postings
from sondeo.operators.filters import encoder_input
from sondeo.operators.retrieval import explode_words, terms
from sondeo.session import tidy

# Prefixes of stored and asked texts, sparse vocabulary and its active share.
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "Instruct: Given a search query, retrieve relevant passages that answer the query\nQuery: "
SPARSE_DIMS = 30522
MAX_ACTIVE_DIMS = 256
BATCH = 32
HANDED_ON = 1024  # vectors that are held before they are handed on, about


class HashedTerms:
    """Counts of words in hashed positions, unit length. Needs no model file; equal on every executor."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for i, body in enumerate(texts):
            for word in body.lower().split():
                out[i, zlib.crc32(word.encode()) % self.dims] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0).tolist()


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list]], prefix: str = "", batch: int = BATCH, limited: bool = False) -> DataFrame:
    """Adds ``embedding``. ``load`` runs once per task; texts reach the encoder ``batch`` at a time.

    Texts go in whole. ``limited`` is for an encoder with an input limit: they are cut to `filters.encoder_input`'s."""

    some = -(-HANDED_ON // batch) * batch

    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load()
        for part in parts:
            for first in range(0, len(part), some):
                end = min(first + some, len(part))
                vectors = (encoder(part.slice(i, min(batch, end - i)).to_pylist()) for i in range(first, end, batch))
                yield pa.concat_arrays([pa.array(v, pa.list_(pa.float32()), from_pandas=True) for v in vectors])

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(encode)(parts)

    # Not to be repeated: a filter on the vectors would else be moved below and encode every text a second time.
    run = run.asNondeterministic()
    return df.withColumn("embedding", run(encoder_input(F.col(text), prefix) if limited else F.concat(F.lit(prefix), F.col(text))))


def score_pairs(candidates: DataFrame, query: str, content: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = BATCH) -> DataFrame:
    """Adds ``relevance`` of (query, content) by an outside scorer; pairs are independent, so no query is gathered."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = load()
        for queries, contents in parts:
            pairs = list(zip(queries, contents))
            scores: list[float] = []
            for start in range(0, len(pairs), batch):
                scores.extend(scorer(pairs[start:start + batch]))
            yield pd.Series(scores, dtype="float64")

    return candidates.withColumn("relevance", run(F.col(query), F.col(content)))


def term_overlap(query: Column, content: Column) -> Column:
    """Bundled scorer as a plain expression: share of the query's distinct words that the content holds."""
    asked = F.array_distinct(terms(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, terms(content))) / F.size(asked))


def sparse_encode(df: DataFrame, keys: list[str], text: str, active: int | None = None) -> DataFrame:
    """(keys, dim, weight): words hashed to dimensions, weight ln(1 + count) rounded to six digits; the ``active`` heaviest, or all.

    Dimensions of one text are bounded by the vocabulary, so ranking them per text is too.
    """
    words = explode_words(df.select(*keys, terms(F.col(text)).alias("_t")), keys, "_t", "_w")
    dim = (F.conv(F.left(F.md5("_w"), F.lit(8)), 16, 10).cast("long") % SPARSE_DIMS).cast("int")
    counts = words.groupBy(*keys, dim.alias("dim")).agg(F.count("*").alias("_n"))
    weighted = counts.select(*keys, "dim", F.round(F.log(1.0 + F.col("_n")), 6).alias("weight"))
    if active is None:
        return weighted
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), F.asc("dim"))
    return weighted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= active).drop("_r")


def dimensions(text: Column) -> Column:
    """The hashed dimension of every word, as ``sparse_encode`` hashes them."""
    return F.transform(terms(text), lambda w: (F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("long") % SPARSE_DIMS).cast("int"))


def sparse_store(df: DataFrame, keys: list[str], text: str, active: int | None = None) -> DataFrame:
    """The postings of ``sparse_encode``'s vectors, scaled to unit length, straight from the texts: no row per word is made."""
    def damped(chunk: np.ndarray, dim: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = np.round(np.log(1.0 + count), 6)
        order = np.lexsort((dim, -weight, chunk))
        first = np.searchsorted(chunk[order], chunk[order])
        kept = np.empty(len(order), bool)
        kept[order] = np.arange(len(order)) - first < (len(order) if active is None else active)
        squares = np.bincount(chunk[kept], weights=weight[kept] ** 2, minlength=int(chunk.max(initial=0)) + 1)
        return kept, weight / np.sqrt(squares[chunk], out=np.ones(len(chunk)), where=squares[chunk] > 0)

    return postings.build(df.select(*keys, dimensions(F.col(text)).alias("dims")), keys, "dims", weigh=damped)


def as_map(sparse: DataFrame, keys: list[str]) -> DataFrame:
    """Long form to map<int, float>; at most 256 entries per text."""
    return sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("dim", F.col("weight").cast("float")))).alias("sparse_embedding"))
