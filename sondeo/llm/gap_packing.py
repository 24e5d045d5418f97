"""Packing token sequences by sums of squares.

Documents become token pieces of at most CAPACITY ids; only longer documents are cut. A piece goes where, after it, the squared
counts of open sequences per residual gap sum up to the least; a new sequence is opened where it fits none. Longest pieces come first,
so that short ones fill what is left. Pieces are dealt into groups of bounded size by a hash of their own number, and each group is packed in one
task. Sequences that are still open are then items themselves, and are packed into each other, group by group and level by level, until
one group holds them all or a level closes less than a tenth of them. Work and memory of a task are bounded by GROUP, however many pieces there are or share an id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import cut, needed, new_folder
from sondeo.llm.unit_ids import WordUnits, batches, encoder

CAPACITY, END = 2048, 0
#: Items packed in one task.
GROUP = 32_768


class Gaps:
    """Open sequences by their gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> int:
        """The gap to put ``size`` into (0: a new sequence): of those that it fits, the one that leaves the least sum of squared counts,
        the smaller of two that leave the same."""
        here = self.count[size:]
        fits = np.flatnonzero(here)
        if not len(fits):
            return 0
        after = np.where(fits > 0, 2 * self.count[fits] + 1, 0)
        return size + int(fits[np.argmin(after - 2 * here[fits] + 1)])

    def move(self, sequence: int, before: int, after: int) -> None:
        """``before`` 0: the sequence is new. A sequence without a gap is forgotten."""
        if before:
            self.count[before] -= 1
        if after:
            self.count[after] += 1
            self.stacks[after].append(sequence)


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each size (1 to ``capacity``) its sequence, numbered from 0, and its offset there; and how full each sequence is."""
    gaps = Gaps(capacity)
    sequence, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        gap = gaps.place(size)
        if gap:
            at = gaps.stacks[gap].pop()
        else:
            at = len(fill)
            fill.append(0)
        sequence[k], offset[k] = at, fill[at]
        fill[at] += size
        gaps.move(at, gap, capacity - fill[at])
    return sequence, offset, np.array(fill, np.int64)


def _pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(WordUnits, path, False)
        number = TaskContext.get().partitionId() << 40
        for batch in batches(frames, 1):
            ids, bounds, _ = units.encode([x or "" for x in batch.column(1).to_pylist()])
            n = np.diff(bounds) + 1
            ended = np.full(int(n.sum()), END, "<u4")
            ended[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            per = -(-n // capacity)
            of = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(n[of] - start, capacity)
            edges = np.concatenate([[0], np.cumsum(length)]) * 4
            data = ended.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(of))), batch.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array([data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())], ["row", "id", "piece", "start", "length", "ids"])
            number += len(of)
    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``row, id, piece, start, length, ids``: the token ids of every document (little-endian 32-bit, the end id 0 last) in pieces, each
    with a number of its own. The table is written to the shared folder, so the numbers stay."""
    spark = docs.sparkSession
    given = needed(docs, id=id_col, text=text_col)
    path = new_folder(spark, "pieces")
    found = given.mapInArrow(_pieces(tokenizer, capacity), f"row long, id {dict(given.dtypes)['id']}, piece int, start long, length long, ids binary")
    found.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _packed(capacity: int, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        # The order of a group's rows depends on the shuffle; sorting makes a repeated task agree with the first.
        table = table.sort_by("item")
        item, size = table.column("item").to_numpy(), table.column("size").to_numpy()
        sequence, offset, fill = pack(size, capacity)
        if level:
            first = np.empty(len(fill), np.int64)
            opens = np.flatnonzero(offset == 0)
            first[sequence[opens]] = item[opens]
            names = first[sequence]
        else:
            names = (int(table.column("group")[0].as_py()) << 24) + sequence
        return pa.table({"item": item, "sequence": names, "offset": offset, "fill": fill[sequence]})
    return run


def _level(items: DataFrame, capacity: int, level: int, groups: int) -> DataFrame:
    """``item, sequence, offset, fill`` of ``items (item, size)``, packed in so many groups."""
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
    return cut(dealt.groupBy("group").applyInArrow(_packed(capacity, level), "item long, sequence long, offset long, fill long"))


def placed(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``item, sequence, offset`` for rows ``item, size``: numbers that differ, sizes from 1 to ``capacity``. An item that fills a sequence
    has one of its own, whose number is below 0. An empty table gives an empty result."""
    items = items.select("item", F.col("size").cast("long").alias("size"))
    given = items.where(F.col("size") < capacity)
    count = given.count()
    groups = max(1, -(-count // group))
    first = newest = _level(given, capacity, 0, groups)
    level, moved = 0, None
    while groups > 1:
        level, before = level + 1, count
        open_ = newest.where((F.col("offset") == 0) & (F.col("fill") < capacity)).select(F.col("sequence").alias("item"), F.col("fill").alias("size"))
        count = open_.count()
        if not count or count > 0.9 * before:
            break
        groups = -(-count // group)
        newest = _level(open_, capacity, level, groups)
        step = newest.select(F.col("item").alias("from"), F.col("sequence").alias("to"), F.col("offset").alias("by"))
        if moved is None:
            moved = step
        else:
            later = step.toDF("to", "then", "more")
            moved = moved.join(later, "to", "left").select("from", F.coalesce("then", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
        moved = cut(moved)
    out = first.select("item", "sequence", "offset")
    if moved is not None:
        out = out.join(moved, F.col("sequence") == F.col("from"), "left")
        out = out.select("item", F.coalesce("to", "sequence").alias("sequence"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return out.union(items.where(F.col("size") == capacity).select("item", -1 - F.col("item"), F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``id_col, piece, start, length, ids, sequence_id, offset``, one row per piece of each row of ``docs``.

    A null or empty text has the end id alone. Rows that share an id, or have none, are documents of their own, with piece numbers from 0
    each. Sequences hold no gaps between pieces; only their ends may be empty. An empty table gives an empty result. Columns other than
    the two named are not read."""
    cut_up = pieces(docs, tokenizer, id_col, text_col, capacity)
    places = placed(cut_up.select(F.col("row").alias("item"), F.col("length").alias("size")), capacity, group)
    out = cut_up.join(places, F.col("row") == F.col("item"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids", F.col("sequence").alias("sequence_id"), "offset")


def write_sequences(packed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes what ``pack_documents`` gave below ``path`` as Parquet, a row per sequence: ``sequence_id, n_tokens, ids`` (little-endian
    32-bit) and ``documents``, an array of where each piece lies and what it is."""
    place = F.struct("offset", "length", F.col(f"`{id_col}`").alias("id"), "piece", "ids")
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(place)).alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    documents = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["id"].alias("id"), p["piece"].alias("piece")))
    whole.select("sequence_id", "n_tokens", ids.alias("ids"), documents.alias("documents")).write.parquet(path)
