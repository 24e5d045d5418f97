"""What the operators of this folder share: the word rule, the shared folder, stable random numbers, tidy workers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``; where none is set, one in the warehouse."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sondeo-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: later work never repeats what made them, also after an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the values of ``parts`` alone."""
    columns = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def needed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; others, whatever they are called, cannot clash."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def place(df: DataFrame, column: str) -> int:
    """Which column, by its number, a name means; without regard to case if none is written so."""
    names = df.columns
    return names.index(column) if column in names else [x.lower() for x in names].index(column.lower())


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, which gives its freed memory back to the system at the end of a task. Workers are kept for later tasks, several to a
    core where a stage has more than one function, and the allocators of idle ones would hold what their last batches took."""

    def tidied(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(frames)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied
