"""A chunk table whose updates rewrite only the buckets they touch.

Documents fall into hash buckets below their collection. An update writes new data for the touched buckets under a commit id of
its own and then one small file into the log; that file is the commit. A reader takes the log up to a version, finds for every bucket
the newest commit that wrote it, and reads those. A run that stops before its log file has changed nothing. One writer at a time.

    chunks/commit=C/collection=A/bucket=7/…   hashes/…   changes/commit=C/…   log/0000000003.json
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sondeo.operators import chunking, sync

DOC = ["collection", "document"]
PLACE = ["commit", "collection", "bucket"]
BUCKETS = 64

_CHUNKS = "collection string, document string, chunk_index int, total_chunks int, content string, commit string, bucket int"
_HASHES = "collection string, document string, sha256 string, commit string, bucket int"
_CHANGES = "collection string, bucket int, commit string"


class VersionedTable:
    """Chunks and document hashes at ``path``. ``buckets`` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.store, self.root = (fs.FileSystem.from_uri(self.path) if urlparse(self.path).scheme else (fs.LocalFileSystem(), self.path))
        log = self._log()
        self.buckets = log[0]["buckets"] if log else buckets

    def _log(self) -> list[dict]:
        """Commits in order. A commit is one short line; their number is bounded by the number of updates."""
        listed = self.store.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        out = []
        for info in sorted(listed, key=lambda i: i.path):
            if info.base_name.endswith(".json"):
                with self.store.open_input_stream(info.path) as file:
                    out.append(json.loads(file.read()))
        return out

    def version(self) -> int:
        """Number of commits so far."""
        return len(self._log())

    def live(self, version: int | None = None) -> DataFrame:
        """``commit, collection, bucket`` of the data that is valid at a version, the last one if none is given."""
        log = self._log()[:version]
        if not log:
            return self.spark.createDataFrame([], "commit string, collection string, bucket int")
        order = F.element_at(F.create_map(*[F.lit(x) for c in log for x in (c["commit"], c["version"])]), F.col("commit"))
        changes = self.spark.read.schema(_CHANGES).parquet(f"{self.path}/changes").withColumn("_v", order).filter(F.col("_v").isNotNull())
        newest = changes.groupBy("collection", "bucket").agg(F.max_by("commit", "_v").alias("commit"))
        return newest.select(*PLACE)

    def _read(self, kind: str, schema: str, version: int | None) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")][:-2]
        if self.store.get_file_info(f"{self.root}/{kind}").type == fs.FileType.NotFound or not self._log():
            return self.spark.createDataFrame([], schema).select(*columns, "bucket")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        live = self.live(version).withColumnRenamed("collection", "_collection")
        # A collection without name is a partition of its own.
        match = (rows.commit == live.commit) & rows.collection.eqNullSafe(live._collection) & (rows.bucket == live.bucket)
        return rows.join(live, match, "left_semi").select(*columns, "bucket")

    def chunks(self, version: int | None = None) -> DataFrame:
        return self._read("chunks", _CHUNKS, version).drop("bucket")

    def hashes(self, version: int | None = None) -> DataFrame:
        return self._read("hashes", _HASHES, version).drop("bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64("document"), F.lit(self.buckets)).cast("int")

    def sync(self, corpus: DataFrame, size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, collections: DataFrame | None = None,
             removals: bool = True) -> DataFrame:
        """Brings the table in step with ``corpus`` (collection, document, sha256, content) and returns the diff; see ``sync.plan_sync``.

        Only added and updated documents are cut. A document without chunks keeps its hash. Where nothing changed there is no commit."""
        commit = uuid.uuid4().hex
        diff_path = f"{self.path}/diffs/{commit}"
        sync.plan_sync(corpus, self.hashes(), collections, removals).write.parquet(diff_path)
        diff = self.spark.read.parquet(diff_path).withColumn("bucket", self._bucket())
        changed = diff.filter(F.col("change") != "unchanged")
        touched = changed.select("collection", "bucket").distinct()
        if changed.isEmpty():
            return diff.drop("bucket")
        arrived = corpus.join(changed.filter("change <> 'removed'").select(*DOC), DOC, "left_semi")
        stale = changed.select(*DOC)
        kept = lambda kind, schema: self._read(kind, schema, None).join(touched, ["collection", "bucket"], "left_semi").join(stale, DOC, "left_anti")
        new_chunks = chunking.chunk_documents(arrived, size, overlap).withColumn("bucket", self._bucket())
        chunks = kept("chunks", _CHUNKS).unionByName(new_chunks.select(*DOC, "chunk_index", "total_chunks", "content", "bucket"))
        hashes = kept("hashes", _HASHES).unionByName(arrived.select(*DOC, "sha256").withColumn("bucket", self._bucket()))
        for kind, rows in (("chunks", chunks), ("hashes", hashes)):
            # One file per bucket, more where a bucket is large.
            rows.hint("rebalance", "collection", "bucket").write.partitionBy("collection", "bucket").parquet(f"{self.path}/{kind}/commit={commit}")
        touched.write.parquet(f"{self.path}/changes/commit={commit}")
        self._commit(commit)
        return diff.drop("bucket")

    def _commit(self, commit: str) -> None:
        version = self.version() + 1
        self.store.create_dir(f"{self.root}/log", recursive=True)
        name = f"{self.root}/log/{version:010d}.json"
        with self.store.open_output_stream(f"{name}.tmp") as file:
            file.write(json.dumps({"version": version, "commit": commit, "buckets": self.buckets}).encode())
        if self.store.get_file_info(name).type != fs.FileType.NotFound:
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")
        self.store.move(f"{name}.tmp", name)
