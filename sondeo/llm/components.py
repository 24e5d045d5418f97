"""Connected components of an edge table: alternating large and small stars, each round cut in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import cut


class Forest:
    """Union-find; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _within_task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        forest = Forest()
        for a, b in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
            forest.join(a, b)
        rows = np.array([(x, root) for x in forest.up if (root := forest.root(x)) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``: component is the smallest node it can be reached from.

    A batch of edges is first reduced to the forest it spans. Then, round by round, every node ties its larger neighbours, and
    then all its neighbours, to the smallest one, until nothing changes. Rounds grow with the logarithm of the longest path.
    Nothing but two numbers a round reaches the driver. Self-edges and repeated edges change nothing; an empty table gives none."""
    given = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    now = cut(given.mapInArrow(_within_task, "a long, b long").distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = cut(tied.union(least.select("u", "m")).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
