"""Sync in place, in batch and as a stream: idempotent, complete, and careful with partial deliveries."""

import pytest
from pyspark.sql import functions as F

from sondeo.operators import sync
from sondeo.sources.versioned import VersionedTable
from sondeo.streaming import jobs

SCHEMA = "collection string, document string, content string"


def corpus(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))


def state(spark, base):
    chunks = spark.read.schema(sync.CHUNK_SCHEMA).parquet(f"{base}/chunks").collect()
    manifest = spark.read.schema(sync.MANIFEST_SCHEMA).parquet(f"{base}/manifest").collect()
    return sorted((r.collection, r.document, r.content) for r in chunks), sorted((r.collection, r.document) for r in manifest)


def changes(diff):
    return sorted((r.collection, r.document, r.change) for r in diff.collect() if r.change != "unchanged")


def test_sync_in_place(spark, tmp_path):
    base = str(tmp_path)
    run = lambda rows, n, **kw: sync.sync_table(corpus(spark, rows), f"{base}/chunks", f"{base}/manifest", f"{base}/stage{n}", **kw)
    first = [("a", "x", "one"), ("a", "y", "two"), ("b", "z", "three"), ("b", "blank", " ")]
    assert len(changes(run(first, 1))) == 4
    assert state(spark, base) == ([("a", "x", "one"), ("a", "y", "two"), ("b", "z", "three")], [("a", "x"), ("a", "y"), ("b", "blank"), ("b", "z")])
    assert changes(run(first, 2)) == []
    second = [("a", "x", "ONE"), ("a", "w", "four")]
    assert changes(run(second, 3)) == [("a", "w", "added"), ("a", "x", "updated"), ("a", "y", "removed")]
    assert state(spark, base)[0] == [("a", "w", "four"), ("a", "x", "ONE"), ("b", "z", "three")]
    # A collection of the manifest that lost its last file is emptied; one that nobody names stays.
    named = spark.createDataFrame([("a",)], "collection string")
    assert changes(sync.sync_table(corpus(spark, []), f"{base}/chunks", f"{base}/manifest", f"{base}/stage4", collections=named)) == [("a", "w", "removed"), ("a", "x", "removed")]
    assert state(spark, base) == ([("b", "z", "three")], [("b", "blank"), ("b", "z")])


def test_streamed_sync_takes_the_latest_version_and_removes_nothing(spark, tmp_path):
    base = str(tmp_path)
    schema = "collection string, document string, content string, version int"

    def deliver(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        q = jobs.sync_corpus(stream, f"{base}/chunks", f"{base}/manifest", f"{base}/staging", f"{base}/cp")
        q.awaitTermination()

    deliver([("a", "x", "old", 1), ("a", "x", "new", 2), ("a", "y", "two", 1)], 1)
    assert state(spark, base)[0] == [("a", "x", "new"), ("a", "y", "two")]
    deliver([("a", "y", "TWO", 1), ("b", "z", "three", 1)], 2)
    assert state(spark, base)[0] == [("a", "x", "new"), ("a", "y", "TWO"), ("b", "z", "three")]


def test_index_classification(spark):
    now = spark.createDataFrame([("c", "same", "1"), ("c", "changed", "2"), ("c", "whole", "3"), ("c", "part", "4")], "collection string, document string, sha256 string")
    old = spark.createDataFrame([("c", "same", "1"), ("c", "changed", "0")], now.schema)
    progress = spark.createDataFrame([("c", "whole", True), ("c", "part", False), ("c", "changed", True)], "collection string, document string, complete boolean")
    pick = lambda force: {r.document: r.action for r in sync.classify_for_index(now, old, progress, force).collect()}
    assert pick(False) == {"same": "skip", "changed": "index", "whole": "adopt", "part": "index"}
    assert set(pick(True).values()) == {"index"}


def _buckets(base, kind="chunks"):
    return {str(p.relative_to(base / kind)) for p in (base / kind).glob("commit=*/collection=*/bucket=*")}


def test_one_changed_document_rewrites_one_bucket(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), buckets=8)
    rows = [(c, f"d{i}", f"text {c} {i}") for c in "ab" for i in range(60)]
    assert len(changes(table.sync(corpus(spark, rows)))) == 120 and table.version() == 1
    first = _buckets(tmp_path)
    assert len(first) == 16
    assert changes(table.sync(corpus(spark, rows))) == [] and table.version() == 1 and _buckets(tmp_path) == first
    rows[5] = ("a", "d5", "changed")
    assert changes(table.sync(corpus(spark, rows))) == [("a", "d5", "updated")]
    assert len(_buckets(tmp_path) - first) == len(_buckets(tmp_path, "hashes")) - 16 == 1
    assert sorted((r.collection, r.document, r.content) for r in table.chunks().collect()) == sorted(rows)
    old = {(r.collection, r.document): r.content for r in table.chunks(version=1).collect()}
    assert old[("a", "d5")] == "text a 5" and len(old) == 120
    # Without its last document a bucket is read as empty; blank documents keep their hash.
    again = [("a", "d5", "changed"), ("b", "blank", " ")]
    table.sync(corpus(spark, again))
    assert [(r.document, r.content) for r in table.chunks().collect()] == [("d5", "changed")]
    assert sorted(r.document for r in table.hashes().collect()) == ["blank", "d5"]
    assert VersionedTable(spark, str(tmp_path)).buckets == 8


def test_a_run_that_stops_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path), buckets=4)
    table.sync(corpus(spark, [("a", "x", "one"), ("a", "y", "two")]))
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, commit: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.sync(corpus(spark, [("a", "x", "ONE"), ("a", "y", "two")]))
    monkeypatch.undo()
    assert sorted(r.content for r in table.chunks().collect()) == ["one", "two"]
    assert changes(table.sync(corpus(spark, [("a", "x", "ONE"), ("a", "y", "two")]))) == [("a", "x", "updated")]
    assert sorted(r.content for r in table.chunks().collect()) == ["ONE", "two"] and table.version() == 2


def test_streamed_batches_are_commits(spark, tmp_path):
    schema = "collection string, document string, content string, version int"
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=4)

    def deliver(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.sync_versioned(stream, table, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.document, r.content) for r in table.chunks().collect())

    assert deliver([("a", "x", "old", 1), ("a", "x", "new", 2), ("a", "y", "two", 1)], 1) == [("x", "new"), ("y", "two")]
    assert deliver([("a", "y", "TWO", 1)], 2) == [("x", "new"), ("y", "TWO")]
    assert table.version() == 2
