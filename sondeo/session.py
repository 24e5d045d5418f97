"""Session settings for tests and the bench. Library functions never create a session."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sondeo")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df, fallback_dir: str | None = None):
    """Cut the lineage in the shared folder the cluster names; where none is set, in one below the warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(fallback_dir or _shared(spark))
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{_shared(spark)}/sondeo-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names, else one below the warehouse, which driver and executors share too."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sondeo-checkpoints").rstrip("/")


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work``, which gives its freed memory back to the system at the end of a task. Idle workers are kept for later tasks, and their
    allocators would hold what their last batches took."""

    def tidied(parts: Iterator) -> Iterator:
        yield from work(parts)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied
