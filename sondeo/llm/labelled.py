"""A bounded sample of labelled rows for fitting, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_col: str | Column) -> Column:
    """Rows that no model sees: crc32 of the id as text leaves 2 when divided by 4. False where the id is null."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """``id, label``: at most ``most`` rows of each label 0 and 1 that are not held out, those first in a fixed random order, and
    ``share``, the part of its label's rows that these are. Rows without id or label are left out; of an id labelled twice the smaller label counts."""
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    once = given.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = None
    for value in (0, 1):
        part = once.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    counts = once.groupBy("label").agg(F.count("*").alias("rows"))
    taken = Window.partitionBy("label")
    return chosen.join(counts, "label").select("id", "label", (F.count("*").over(taken) / F.col("rows")).alias("share"))
