"""Cutting documents into overlapping chunks, and quality measures over chunk tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondeo.functions import heavy, ordered, text
from sondeo.session import checkpointed, tidy

# Separators from coarse to fine, default sizes, bucket edges of the size histogram.
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", " "]
CHUNK_SIZE = 2000
OVERLAP = 400
SIZE_BUCKETS = ["0-500", "500-1000", "1000-1500", "1500-2000", "2000+"]

DOC = ["collection", "document"]
BLOCK_CHUNKS = 1024  # chunks of one document that a window task sees at once
SLICE_BYTES = 2**20  # text that is cut before its chunks are handed on, about


# -- cutting ----------------------------------------------------------------------------------------------------------

def cut_points(body: str, size: int) -> list[int]:
    """Offsets where the text may be cut, both ends included. Spans longer than ``size`` are cut behind every separator of one
    kind, then what is still too long behind those of the next; a separator that closes its span leaves an empty span after it."""
    points = [0, len(body)]
    for separator in map(re.compile, map(re.escape, SEPARATORS)):
        wide = [(a, b) for a, b in zip(points, points[1:]) if b - a > size]
        points = sorted(points + [m.end() for a, b in wide for m in separator.finditer(body, a, b)])
    return points


def cut_text(body: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks as windows over the cut points: a window that would grow past ``size`` is closed at its last point, and the next one
    starts at a word inside its last ``overlap`` characters. Spans without separators are cut by length, blank slices left out."""
    points, spans = cut_points(body, size), []
    for a, b in zip(points, points[1:]):
        hard = [body[i:min(i + size, b)] for i in range(a, b, size)] if b - a > size else None
        spans += [body[a:b]] if hard is None else [x for x in hard if not x.isspace()]
    kept, start, last, windows = "".join(spans), 0, 0, []
    for end in accumulate(map(len, spans)):
        if end - start > size:
            windows.append((start, last))
            start = _word_start(kept, max(start, last - max(overlap, 0)), last)
        last = end
    return [x for x in (kept[a:b].strip() for a, b in [*windows, (start, last)]) if x]


def _word_start(body: str, low: int, high: int) -> int:
    """Offset behind the first blank of ``body[low:high]``; ``low`` if there is none before its last character."""
    return body.find(" ", low, max(high - 1, low)) + 1 or low


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, content: str = "content") -> DataFrame:
    """(collection, document, content) to chunk rows with index and total; an empty document yields none.

    The cutter is a sequential scan of one text, so it runs as an Arrow batch function over rows, in the partitions the
    documents come in (see ``sources.corpus.spread`` for scans with too few of them). Of a batch only a slice is held as
    Python texts and chunks.
    """

    def cut_slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in (part for bodies in batches for part in slices(bodies, SLICE_BYTES)):
            yield pa.array([cut_text(b, size, overlap) if b else [] for b in some.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(cut_slices)(batches)

    cut_up = docs.select(*DOC, cut(F.col(content)).alias("_chunks"))
    return enrich(cut_up, "_chunks")


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in order, in slices that end where they reach ``size`` bytes; no text is cut."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "left")) + 1
        yield texts.slice(at, end - at)
        at = end


def enrich(docs: DataFrame, chunks: str) -> DataFrame:
    """One row per array element with a 0-based index and the number of elements. The outer form keeps Spark from deriving a size
    filter that would cut all texts once more, before rows are spread and before any join that keeps few of them."""
    return docs.select(
        *DOC, F.size(chunks).alias("total_chunks"), F.posexplode_outer(chunks).alias("chunk_index", "content")
    ).filter(F.col("chunk_index").isNotNull()).select(*DOC, "chunk_index", "total_chunks", "content")


# -- statistics -------------------------------------------------------------------------------------------------------

def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Number, integer mean, smallest and largest size per document, and overall (document null)."""
    sized = chunks.select(*DOC, F.length("content").alias("size"))
    return sized.groupingSets([DOC, []], *DOC).agg(
        F.count("*").alias("num_chunks"), F.floor(F.sum("size") / F.count("*")).alias("avg_chunk_size"),
        F.min("size").alias("min_chunk"), F.max("size").alias("max_chunk"),
    )


def size_bucket(size: Column) -> Column:
    return (
        F.when(size < 500, SIZE_BUCKETS[0]).when(size < 1000, SIZE_BUCKETS[1]).when(size < 1500, SIZE_BUCKETS[2])
        .when(size < 2000, SIZE_BUCKETS[3]).otherwise(SIZE_BUCKETS[4])
    )


def size_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks per fixed size bucket with shares; empty buckets appear with zero."""
    every = chunks.sparkSession.createDataFrame([(b,) for b in SIZE_BUCKETS], "bucket string")
    counts = chunks.groupBy(size_bucket(F.length("content")).alias("bucket")).agg(F.count("*").alias("n"))
    total = F.sum("count").over(Window.partitionBy())  # five rows
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("count")).select(
        "bucket", "count",
        F.when(total > 0, F.round(100.0 * F.col("count") / total, 1)).otherwise(0.0).alias("percent"),
    )


# -- neighbours -------------------------------------------------------------------------------------------------------

def neighbour_pairs(chunks: DataFrame) -> DataFrame:
    """Each chunk with the content of the next stored chunk of its document."""
    block = F.floor(F.col("chunk_index") / BLOCK_CHUNKS)
    paired = ordered.next_row(
        chunks.select(*DOC, "chunk_index", "content"), DOC, ["chunk_index"], block, F.struct("content"), "_next"
    )
    return paired.filter(F.col("_next").isNotNull()).select(
        *DOC, "chunk_index", F.col("content").alias("text1"), F.col("_next.content").alias("text2")
    )


def overlaps(pairs: DataFrame, cap: int = OVERLAP, out: str = "overlap") -> DataFrame:
    return pairs.withColumn(out, text.longest_overlap(F.col("text1"), F.col("text2"), cap))


def tolerant_overlap(cap: int):
    """Overlap length in raw characters of the right text, white space runs counted as one blank while matching."""

    @F.pandas_udf("int")
    def measure(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_tolerant(a, b, cap) for a, b in zip(left, right)], dtype="int32")

    return measure


# Characters of each text that a report of unmatched pairs shows.
EXCERPT = 150
_RUN = re.compile(r"\s+")


def _tolerant(left: str, right: str, cap: int) -> int:
    tail = _RUN.sub(" ", left)[-cap:]
    head = _RUN.sub(" ", right)[:cap]
    size = min(len(tail), len(head))
    while size and not tail.endswith(head[:size]):
        size -= 1
    if not size:
        return 0
    # The raw length is where the normalised character number ``size`` starts: walk runs and single characters.
    position = 0
    for token in re.finditer(r"\s+|\S", right):
        if position == size:
            return token.start()
        position += 1
    return len(right)


def overlap_summary(pairs: DataFrame, variants: list[str], exact: str, tolerant: str) -> DataFrame:
    """Per collection and variant: pairs, zero share, extremes, mean, median; disagreeing and residual pairs.

    Medians keep one counter per distinct length, and lengths are bounded by the cap.
    """
    stacked = pairs.select(
        "collection", F.explode(F.array(*[
            F.struct(F.lit(v).alias("variant"), F.col(v).alias("value"),
                     (F.col(exact) != F.col(tolerant)).alias("differs"), (F.col(tolerant) == 0).alias("residual"))
            for v in variants
        ])).alias("r")
    ).select("collection", "r.*")
    return stacked.groupBy("collection", "variant").agg(
        F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("value") == 0) / F.count("*"), 1).alias("zero_pct"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 1).alias("mean"),
        F.median("value").alias("median"), F.count_if("differs").alias("disagreeing"),
        F.count_if("residual").alias("residual"),
    )


def unmatched_pairs(pairs: DataFrame, exact: str, tolerant: str, excerpt: int = EXCERPT) -> DataFrame:
    """The pairs behind the two counts of ``overlap_summary``, with the end of the left and the start of the right text."""
    residual, differs = F.col(tolerant) == 0, F.col(exact) != F.col(tolerant)
    return pairs.filter(residual | differs).select(
        *DOC, "chunk_index", F.col(exact).alias("exact"), F.col(tolerant).alias("tolerant"), residual.alias("residual"), differs.alias("differs"),
        F.right("text1", F.lit(excerpt)).alias("tail1"), F.left("text2", F.lit(excerpt)).alias("head2"))


def overlap_extremes(pairs: DataFrame, column: str) -> DataFrame:
    """Pairs with the smallest and the largest overlap above zero per collection; first by key on ties."""
    key = F.struct("document", "chunk_index")
    nonzero = pairs.filter(F.col(column) > 0)
    return nonzero.groupBy("collection").agg(
        F.min(F.struct(F.col(column).alias("v"), key.alias("k"))).alias("lo"),
        F.min(F.struct((-F.col(column)).alias("v"), key.alias("k"))).alias("hi"),
    ).select(
        "collection", F.col("lo.v").alias("min_overlap"), F.col("lo.k.document").alias("min_document"),
        F.col("lo.k.chunk_index").alias("min_chunk_index"), (-F.col("hi.v")).alias("max_overlap"),
        F.col("hi.k.document").alias("max_document"), F.col("hi.k.chunk_index").alias("max_chunk_index"),
    )


def expand_anchors(anchors: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Stored chunks around each anchor. Every wanted index becomes a row, so the join is an equality on the chunk key."""
    def clamp(c: str) -> Column:
        return F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(limit))

    wanted = anchors.withColumn(
        "wanted_index", F.explode(F.sequence(F.col("chunk_index") - clamp("before"), F.col("chunk_index") + clamp("after")))
    ).withColumnRenamed("chunk_index", "anchor_index").withColumnRenamed("wanted_index", "chunk_index")
    return wanted.join(chunks.select(*DOC, "chunk_index", "content"), [*DOC, "chunk_index"])


def merge_texts(contents: Column, cap: int = OVERLAP) -> Column:
    """An array of texts as one: each loses what it shares with the end of all before it; a blank line where nothing is shared."""
    def joined(merged: Column, following: Column) -> Column:
        shared = F.array(text.longest_overlap(merged, following, cap))
        rest = F.transform(shared, lambda n: F.when(n > 0, F.substring(following, n + 1, F.length(following))).otherwise(F.concat(F.lit("\n\n"), following)))
        return F.concat(merged, rest[0])

    return F.when(F.size(contents) > 0, F.aggregate(F.slice(contents, 2, F.greatest(F.size(contents), F.lit(1))), contents[0], joined)).otherwise("")


def merge_expanded(expanded: DataFrame, keys: list[str], cap: int = OVERLAP) -> DataFrame:
    """One merged text per anchor; an anchor has at most 21 chunks."""
    gathered = expanded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("_parts"))
    return gathered.select(*keys, F.size("_parts").alias("chunks_returned"), merge_texts(F.col("_parts.content"), cap).alias("content"))


# -- quotes -----------------------------------------------------------------------------------------------------------

def quote_coverage(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``single``, ``boundary`` or ``missing`` per quote (quote_id, collection, document, chunk_index, quote).

    Only chunks of documents with quotes are looked at. A quote meets the chunks that hold its rarest inner word; quotes of one or two
    words meet all chunks of their document, which are spread where they are many. A chunk is repeated only for words that quotes of its
    document are looked up by, not for every word.
    """
    # The white space pattern carries no state, so normalising both sides once before the join is enough.
    # Quotes, and the chunks of their documents, are made once; both are read several times below.
    q = checkpointed(quotes.select("quote_id", *DOC, "chunk_index", text.normalize_ws(F.col("quote")).alias("_q")))
    word = F.xxhash64("_anchor").alias("_word")
    anchored = checkpointed(heavy.with_anchor(q, "quote_id", F.split("_q", " ")).select("quote_id", "_q", *DOC, word))
    sized = checkpointed(chunks.select(*DOC, "chunk_index", "content").join(q.select(*DOC).distinct(), DOC, "left_semi"))
    nxt = sized.select(*DOC, (F.col("chunk_index") - 1).alias("chunk_index"), F.col("content").alias("_after"))
    # A chunk's own text is the start of the text that its successor ends.
    texts = sized.join(nxt, [*DOC, "chunk_index"], "left").select(
        *DOC, F.col("chunk_index").alias("_index"), F.length(text.normalize_ws(F.col("content"))).alias("_own"),
        text.normalize_ws(F.concat("content", F.lit(" "), F.coalesce("_after", F.lit("")))).alias("_two"),
        F.col("_after").isNotNull().alias("_followed"),
    )
    # Words travel as hashes, without their texts; a text follows only for words that anchor a quote of its document. Equal hashes of
    # different words propose a text in vain.
    on = [*DOC, "_word"]
    of = F.xxhash64(*DOC).alias("_of")
    every = texts.select(of, "_index", heavy.every_anchor(F.split("_two", " ")).alias("_anchor")).select("_of", "_index", word)
    named = every.join(anchored.select(of, "_word").distinct(), ["_of", "_word"], "left_semi").distinct()
    parted = texts.withColumn("_of", of).join(named, ["_of", "_index"]).drop("_of")
    whole = sized.select(*DOC, F.xxhash64(F.lit("")).alias("_word"))
    own = F.left("_two", F.col("_own"))
    held = heavy.spread_join(parted, anchored, on, ["_index"], sketched=whole).groupBy("quote_id").agg(
        F.min(F.when(own.contains(F.col("_q")), F.col("_index"))).alias("single_index"),
        F.min(F.when(F.col("_followed") & F.col("_two").contains(F.col("_q")), F.col("_index"))).alias("boundary_index"),
    )
    known = sized.select(*DOC).distinct().withColumn("_doc", F.lit(True))
    found = q.select("quote_id", *DOC).join(known, DOC).join(held, "quote_id", "left").select("quote_id", "single_index", "boundary_index", "_doc")
    joined = q.drop("_q").join(found, "quote_id", "left")
    status = F.when(F.col("single_index").isNotNull(), "single").when(
        F.col("boundary_index").isNotNull(), "boundary").otherwise("missing")
    return joined.select(
        "quote_id", *DOC, F.col("chunk_index").alias("expected_chunk_index"), status.alias("status"),
        F.coalesce("single_index", "boundary_index").alias("matched_chunk_index"),
        F.when(F.col("single_index").isNotNull(), F.col("single_index") == F.col("chunk_index")).alias("index_match"),
        F.coalesce("_doc", F.lit(False)).alias("doc_found"),
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    every = coverage.sparkSession.createDataFrame([("single",), ("boundary",), ("missing",)], "status string")
    counts = coverage.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(~F.col("index_match")).alias("index_mismatches")
    )
    total = F.sum("count").over(Window.partitionBy())  # three rows
    return every.join(counts, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("count"),
        F.coalesce("index_mismatches", F.lit(0)).alias("index_mismatches"),
    ).withColumn("share", F.when(total > 0, F.round(F.col("count") / total, 4)).otherwise(0.0))


def drifted_quotes(quotes: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Quotes that their named chunk no longer holds. By default ``%`` and ``_`` in a quote act as wildcards."""
    held = chunks.select(*DOC, "chunk_index", F.col("content").alias("_content"))
    joined = quotes.join(held, [*DOC, "chunk_index"], "left")
    found = (
        F.col("_content").contains(F.col("quote")) if strict
        else F.like(F.col("_content"), F.concat(F.lit("%"), F.col("quote"), F.lit("%")))
    )
    return joined.filter(~F.coalesce(found, F.lit(False))).drop("_content")


def redundant_hits(hits: DataFrame) -> DataFrame:
    """Hits whose chunk directly follows another hit of the same list and document."""
    before = hits.select("query_id", *DOC, (F.col("chunk_index") + 1).alias("chunk_index"), F.col("rank").alias("neighbour_rank"))
    return hits.join(before, ["query_id", *DOC, "chunk_index"])
