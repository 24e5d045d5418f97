"""The three jobs whose inputs keep arriving: corpus sync, expand attribution, daily counts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sondeo.operators import sync
from sondeo.operators.loganalytics import EXPAND_WINDOW_US
from sondeo.sources.versioned import VersionedTable


def sync_corpus(documents: DataFrame, chunk_path: str, manifest_path: str, staging_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of arrived documents (collection, document, content, version) is compared by hash and merged.

    A batch that runs twice finds its own hashes and changes nothing. Within a batch the latest version of a document
    counts. Nothing is removed, as a delivery is never the whole corpus.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("collection", "document").agg(F.max_by("content", "version").alias("content"))
        hashed = latest.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
        sync.sync_table(hashed, chunk_path, manifest_path, f"{staging_path}/{epoch}", removals=False)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_versioned(documents: DataFrame, table: VersionedTable, checkpoint: str, **cutting) -> StreamingQuery:
    """As ``sync_corpus``, into a versioned table: a micro-batch rewrites the buckets of its changed documents and is one commit."""

    def merge(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("collection", "document").agg(F.max_by("content", "version").alias("content"))
        table.sync(latest.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)), removals=False, **cutting)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attribution_candidates(expands: DataFrame, listed: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Expands with the latest search within the hour before that listed their chunk, and the latest that listed their document.

    ``expands`` (expand_id, ts, collection, document, chunk_index), ``listed`` (search_id, ts, collection, document,
    chunk_index, hit_rank), both streams. An hour of a bucket of documents is one keyed state; lists are sent to their own hour and the next,
    so an hour sees all it needs. Its events are looked up in time order: no pair of an expand and an older search is formed, and at most two
    candidates an expand leave for every batch that brings something newer. The watermark ends the state of an hour.
    """
    null = lambda kind: F.lit(None).cast(kind)
    key = [F.col("collection").cast("string").alias("collection"), F.col("document").cast("string").alias("document"), F.col("chunk_index").cast("long").alias("chunk_index")]
    hour = F.floor(F.unix_micros("ts") / EXPAND_WINDOW_US)
    e = expands.select("ts", *key, F.col("expand_id"), null("string").alias("search_id"), null("int").alias("hit_rank"), F.array(hour).alias("_hours"))
    s = listed.filter(F.col("search_id").isNotNull()).select("ts", *key, null("string").alias("expand_id"), "search_id", F.col("hit_rank").cast("int").alias("hit_rank"), F.array(hour, hour + 1).alias("_hours"))
    # One watermark for both: the union's.
    events = e.unionByName(s).withWatermark("ts", delay).select("*", F.explode("_hours").alias("_hour")).drop("_hours")
    placed = events.withColumn("_bucket", F.pmod(F.xxhash64("collection", "document"), F.lit(STATE_BUCKETS)).cast("int"))
    return placed.groupBy("_hour", "_bucket").applyInPandasWithState(
        _latest_lists, CANDIDATE, "seen binary", "append", GroupStateTimeout.EventTimeTimeout)


#: Documents are dealt to so many states an hour.
STATE_BUCKETS = 4
CANDIDATE = "expand_id string, expand_ts timestamp, search_id string, search_ts timestamp, hit_rank int, exact boolean"
_EVENT = ["ts", "collection", "document", "chunk_index", "expand_id", "search_id", "hit_rank"]


def _latest_lists(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New expands meet all lists of the hour, expands of earlier batches the new lists only."""
    if state.hasTimedOut:
        state.remove()
        return
    new = pd.concat(list(parts), ignore_index=True)[_EVENT]
    old = pickle.loads(state.get[0]) if state.exists else new.iloc[:0]
    both = pd.concat([old, new], ignore_index=True) if len(old) else new
    is_new, is_list = new["search_id"].notna(), both["search_id"].notna()
    yield _as_of(new[~is_new], both[is_list])
    if len(old) and is_new.any():
        again = _as_of(old[old["search_id"].isna()], new[is_new])
        yield again[again["search_id"].notna()]
    if pd.isna(key[0]):  # events without a time wait for nothing
        return
    state.update((pickle.dumps(both),))
    end = (int(key[0]) + 1) * EXPAND_WINDOW_US // 1000
    state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))


def _as_of(expands: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """The latest list of each expand's chunk, if there is one, and of its document, at most an hour old; null where there is none. Of lists of
    one moment the smallest id and rank count."""
    e = expands[["expand_id", "ts", "collection", "document", "chunk_index"]].rename(columns={"ts": "expand_ts"})
    s = lists.rename(columns={"ts": "search_ts"}).drop(columns="expand_id")
    s = s.dropna(subset=["search_ts", "collection", "document"]).sort_values(["search_ts", "search_id", "hit_rank"])
    timed = e.dropna(subset=["expand_ts", "collection", "document"]).sort_values("expand_ts")
    found = []
    for by, exact in ((["collection", "document", "chunk_index"], True), (["collection", "document"], False)):
        left, right = (timed.dropna(subset=by), s.dropna(subset=by).drop_duplicates([*by, "search_ts"]))
        if len(left) and len(right):
            if "chunk_index" in by:
                left, right = left.astype({"chunk_index": "int64"}), right.astype({"chunk_index": "int64"})
            else:
                right = right.drop(columns="chunk_index")
            near = pd.merge_asof(left, right, left_on="expand_ts", right_on="search_ts", by=by, tolerance=pd.Timedelta(microseconds=EXPAND_WINDOW_US))
            found.append(near[near["search_id"].notna()].assign(exact=exact))
    hit = pd.concat(found, ignore_index=True) if found else e.iloc[:0].assign(search_id=None, search_ts=pd.NaT, hit_rank=None, exact=None)
    none = e[~e["expand_id"].isin(hit["expand_id"])].assign(search_id=None, search_ts=pd.NaT, hit_rank=None, exact=None)
    out = pd.concat([x for x in (hit, none) if len(x)], ignore_index=True) if len(hit) or len(none) else hit
    return out[["expand_id", "expand_ts", "search_id", "search_ts", "hit_rank", "exact"]]


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One row per expand: exact before document, then the latest search, its smallest id and rank."""
    order = F.struct((~F.coalesce("exact", F.lit(False))).alias("inexact"), (-F.unix_micros("search_ts")).alias("age"), "search_id", "hit_rank")
    best = candidates.filter(F.col("search_id").isNotNull()).groupBy("expand_id").agg(F.min(order).alias("b"))
    every = candidates.select("expand_id").distinct()
    kind = F.when(F.col("b").isNotNull(), F.when(F.col("b.inexact"), "document").otherwise("exact"))
    return every.join(best, "expand_id", "left").select("expand_id", F.col("b.search_id").alias("search_id"), kind.alias("kind"), F.col("b.hit_rank").alias("hit_rank"))


def daily_counts(log: DataFrame, kind: str, delay: str = "1 hour") -> DataFrame:
    """Records per kind and day of event time; the day in progress stays open until the watermark passes its end."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("day"), kind, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_at(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete mode: every batch rewrites the small result table."""
    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, epoch: batch.write.mode("overwrite").parquet(path)).start()
