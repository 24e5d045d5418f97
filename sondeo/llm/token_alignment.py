"""Two tokenizers' ids of the same texts, aligned where tokens of both end at one byte.

The ends of A's tokens and those of B's are two rising sequences; aligning them is merging them. A merge of n steps is cut into
independent pieces of equal work along diagonals: the k-th diagonal holds all (i, j) with i + j = k * STEPS, and a binary search on it finds
where the merge passes. Each piece then finds the ends that both its slices hold; a pair of equal ends that a diagonal parts is added
at the seam. Ends found, in order, cut the tokens into groups, which run on over pieces.

Ids that are linked are counted over the corpus by blocks: a block of texts lists its distinct pairs once, the counts of all blocks are summed, and
each block gets the sums of its own pairs back, so that neither a frequent pair nor a long text makes a large key or row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.common import cut, needed, new_folder, tidy
from sondeo.llm.unit_ids import ByteUnits, PieceUnits, batches, encoder

#: Merge steps of a piece.
STEPS = 1 << 15
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d how many elements of ``a`` are among the first d of the merge of two sorted arrays, ``a`` before equals of ``b``."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        m, d = middle[open_], diagonals[open_]
        earlier = a[m] <= b[d - 1 - m]
        low[open_] = np.where(earlier, m + 1, low[open_])
        high[open_] = np.where(earlier, high[open_], m)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in two rising arrays of all values that both hold, in order."""
    diagonals = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    i = crossings(a, b, diagonals)
    j = diagonals - i
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist()):
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0] and j1 > j0:
            left.append(np.array([i0 - 1]))
            right.append(np.array([j0]))
        mine, theirs = a[i0:i1], b[j0:j1]
        if len(mine) and len(theirs):
            at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            hit = np.flatnonzero(theirs[at] == mine)
            left.append(i0 + hit)
            right.append(j0 + at[hit])
    return np.concatenate(left), np.concatenate(right)


class Aligner:
    """Both tokenizers, and how many bytes each of their ids spells."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.a, self.b = encoder(ByteUnits, bytes_path, True), encoder(PieceUnits, pieces_path)
        size = self.a.tokenizer.get_vocab_size()
        # One character of a byte-level vocabulary's entry stands for one byte.
        self.a_bytes = np.array([len(self.a.tokenizer.id_to_token(k) or "") for k in range(size)], np.int64)
        self.b_bytes = np.array([len(x) for x in self.b.spelling], np.int64)
        self.most = 10 ** len(str(max(size, len(self.b_bytes)) - 1))
        self.digits = np.array([list(str(k).ljust(len(str(self.most)) - 1).encode()) for k in range(max(size, len(self.b_bytes)))], np.uint8)
        self.width = (self.digits != 32).sum(axis=1).astype(np.int8)

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """``a, b``: ids of all texts that both spell, one after the other; ``a_at, b_at``: where each text's begin; ``i, j``: the places of
        tokens that end together; ``link_at``: where each text's of these begin. Other texts have no tokens."""
        spaced = [" " + t if t else "" for t in texts]
        a, a_at, _ = self.a.encode(spaced)
        b, b_at, fair = self.b.encode(spaced)
        if not fair.all():
            a, b = a[np.repeat(fair, np.diff(a_at))], b[np.repeat(fair, np.diff(b_at))]
            a_at, b_at = (np.concatenate([[0], np.cumsum(np.diff(at) * fair)]) for at in (a_at, b_at))
        i, j = common_ends(np.cumsum(self.a_bytes[a]), np.cumsum(self.b_bytes[b]))
        return {"a": a, "b": b, "a_at": a_at, "b_at": b_at, "i": i, "j": j, "link_at": np.searchsorted(i, a_at)}

    def written(self, found: dict[str, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Groups of all texts as ``a1,a2|b1;a3|b2,b3;`` in decimal, and where each text's begin."""
        n_a, n_b = (np.diff(np.append(-1, found[k])) for k in ("i", "j"))
        before_b, with_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
        place_a = np.repeat(before_b.astype(np.int32), n_a) + np.arange(len(found["a"]), dtype=np.int32)
        place_b = np.repeat(with_a.astype(np.int32), n_b) + np.arange(len(found["b"]), dtype=np.int32)
        ids = np.empty(len(place_a) + len(place_b), np.int32)
        ids[place_a], ids[place_b] = found["a"], found["b"]
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[found["i"]]], mark[place_b[found["j"]]] = ord("|"), ord(";")
        del place_a, place_b
        width = self.width[ids]
        ends = np.cumsum(width, dtype=np.int64) + np.arange(1, len(ids) + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = mark
        for k in range(self.digits.shape[1]):
            some = np.flatnonzero(width > k)
            out[ends[some] - (width[some] + (1 - k))] = self.digits[ids[some], k]
        return out.tobytes(), np.append(0, ends)[found["a_at"] + found["b_at"]]


def _aligned(bytes_path: str, pieces_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = encoder(Aligner, bytes_path, pieces_path)
        for batch in batches(frames, 1, BLOCK_BYTES):
            found = aligner.align([x or "" for x in batch.column(1).to_pylist()])
            lists = []
            for name, at in (("a", "a_at"), ("b", "b_at"), ("i", "link_at"), ("j", "link_at")):
                values = found[name].astype(np.int64)
                if name in "ij":
                    start = found[{"i": "a_at", "j": "b_at"}[name]][:-1]
                    values = values - np.repeat(start, np.diff(found["link_at"]))
                lists.append(pa.ListArray.from_arrays(pa.array(found[at].astype(np.int32)), pa.array(values.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "a_ids", "b_ids", "a_ends", "b_ends"])
    return run


def align(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, a_ids, b_ids, a_ends, b_ends``, one row per row of ``docs``: both tokenizers' ids, and of each group the places of its last
    token in either. Texts that are null, empty or not spelled by both have empty arrays. An empty table gives an empty result."""
    given = needed(docs, id=id_col, text=text_col)
    found = given.mapInArrow(_aligned(bytes_path, pieces_path), f"id {dict(given.dtypes)['id']}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")
    return found.withColumnRenamed("id", id_col)


def _blocks(bytes_path: str, pieces_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = encoder(Aligner, bytes_path, pieces_path)
        number = TaskContext.get().partitionId() << 40
        for batch in batches(frames, 1, BLOCK_BYTES):
            found = aligner.align([x or "" for x in batch.column(1).to_pylist()])
            text, at = aligner.written(found)
            digests = [hashlib.sha256(text[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            pairs = found["a"][found["i"]].astype(np.int64) * len(aligner.b_bytes) + found["b"][found["j"]]
            distinct, link, count = np.unique(pairs, return_inverse=True, return_counts=True)
            whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            n_a, n_b, n_links = (np.diff(found[k]) for k in ("a_at", "b_at", "link_at"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), whole(n_a, pa.int64()),
                 whole(n_b, pa.int64()), whole(n_links, pa.int64()), whole(digests, pa.string()), pa.array([link.astype("<u4").tobytes()], pa.binary()),
                 whole(distinct, pa.int64()), whole(count, pa.int64())], ["block", "ids", "n_a", "n_b", "n_links", "digests", "links", "pairs", "counts"])
            number += 1
    return run


def _sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts from rows of blocks. ``worth`` has the corpus count of each of a block's pairs, below 0 where it is not its B id's highest."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for frame in frames:
        for k in range(frame.num_rows):
            ids, n_a, n_b, n_links, digests, links, worth = (frame.column(c)[k] for c in range(7))
            of = np.frombuffer(links.as_py(), "<u4")
            value = (worth.values.to_numpy() if worth.is_valid else np.zeros(0, np.int64))[of]
            at = np.concatenate([[0], np.cumsum(n_links.values.to_numpy())])
            best, total = (np.concatenate([[0], np.cumsum(x)])[at] for x in (value > 0, np.abs(value)))
            # A byte ends at most one token of either side, so there are as many groups as links.
            yield pa.RecordBatch.from_arrays([ids.values, n_a.values, n_b.values, n_links.values, n_links.values, pa.array(np.diff(best)), pa.array(np.diff(total)), digests.values], names)


def alignment_counts(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    n_best counts the links whose pair of ids is linked in the corpus as often as any pair with the same B id; count_sum sums the corpus
    counts of all links. A text that is null, empty or not spelled by both tokenizers has no tokens: zeros and an empty digest. Repeated
    rows are counted as often as they come. An empty table gives an empty result. Columns other than the two named are not read.

    Texts are encoded once; their links are written to the shared folder, as places in their block's list of pairs."""
    spark = docs.sparkSession
    given = needed(docs, id=id_col, text=text_col)
    kind, path = dict(given.dtypes)["id"], new_folder(spark, "links")
    schema = f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_links array<long>, digests array<string>, links binary, pairs array<long>, counts array<long>"
    given.mapInArrow(tidy(_blocks(bytes_path, pieces_path)), schema).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    second = encoder(PieceUnits, pieces_path).model.get_piece_size()
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.col("pair") % second))
    worth = cut(pairs.select("pair", F.when(F.col("n") == highest, F.col("n")).otherwise(-F.col("n")).alias("worth")))
    asked = blocks.select("block", F.explode("pairs").alias("pair")).join(worth, "pair")
    told = asked.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pair", "worth"))), lambda x: x["worth"]).alias("worth"))
    rows = blocks.drop("pairs", "counts").join(told, "block", "left").select("ids", "n_a", "n_b", "n_links", "digests", "links", "worth")
    out = rows.mapInArrow(tidy(_sums), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
