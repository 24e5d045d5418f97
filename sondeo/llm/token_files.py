"""Token ids as flat binary files with 64-bit document offsets.

A dataset is a folder of three: ``ids``, files of unsigned 16- or 32-bit little-endian numbers (by the vocabulary's size), which put
one after the other in name order are all documents' ids in ascending document order, each document closed by the end id 0;
``offsets``, files of unsigned 64-bit numbers beside them, where each document starts in the whole; and ``index``, Parquet with a row per
document: which number of which offsets file is its own, and how many ids it must have.

Spark's text writer makes the two flat kinds, on any store and with its usual commit: a value goes out byte for byte, followed by a
line separator, and the separator is what every value ends with anyway, the end id 0 or an offset's topmost byte, which is 0.
Readers map both kinds into memory: a document's ids go from its own offset to the next one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondeo.llm.common import cut, needed
from sondeo.llm.unit_ids import ByteUnits, batches, encoder

END = 0
#: Ids in one file, about; it decides how many files there are.
FILE_IDS = 8_000_000
#: What is on disk between encoding and the flat files is packed beside a sample of ids: of so many texts, so many characters of each, so
#: many bytes of ids in all. The sample shapes the packing only; results are the same with any.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_BYTES, LEVEL = 512, 8_192, 512 << 10, 5


def id_kind(path: str) -> np.dtype:
    """The number type of a tokenizer's ids in files."""
    return encoder(ByteUnits, path, False).kind


def _sample(texts: DataFrame, tokenizer: str) -> bytes:
    """Ids of the beginnings of a few texts. At most SAMPLE_TEXTS times SAMPLE_CHARS characters reach the driver."""
    rows = texts.where(F.length("text") > 0).select(F.substring("text", 1, SAMPLE_CHARS)).limit(SAMPLE_TEXTS).collect()
    return encoder(ByteUnits, tokenizer, False).encode([r[0] for r in rows])[0].tobytes()[:SAMPLE_BYTES] if rows else b""


def _shared(sample: bytes) -> dict[str, zstandard.ZstdCompressionDict]:
    """What packer and unpacker are given besides the level: documents of a few kilobytes hold little that repeats inside them."""
    return {"dict_data": zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(sample) >= 8 else {}


def _encoded(path: str, sample: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, shared = encoder(ByteUnits, path, False), _shared(sample.value)
        for x in shared.values():
            x.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, **shared)
        for batch in batches(frames, 1):
            ids, bounds, _ = units.encode([x or "" for x in batch.column(1).to_pylist()])
            data, edges = ids.tobytes(), (bounds * units.kind.itemsize).tolist()
            parts = [data[a:b] for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds) + 1), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                                              pa.array([packer.compress(x) for x in parts], pa.binary())], ["id", "n", "tie", "ids"])
    return run


def _unpacked(sample: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(**_shared(sample.value))
        for whole in frames:
            for at in range(0, whole.num_rows, 256):
                yield pa.RecordBatch.from_arrays([pa.array([unpacker.decompress(x) for x in whole.column(0).slice(at, 256).to_pylist()], pa.binary())], ["value"])
    return run


def write_dataset(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Writes the dataset of all rows below ``path``. Null texts count as empty; rows of one id come by length, then by a checksum of
    their ids; null ids come first. Columns other than the two named are not read. An empty table gives files without documents.

    Texts are encoded once, and packed until they are in place, beside a few documents' ids that all tasks share. Their ids are sorted by range, so what file k holds comes before what file k + 1 holds, and each file's
    base in the whole is the sum of the files before it."""
    spark = docs.sparkSession
    given = needed(docs, id=id_col, text=text_col)
    kind = dict(given.dtypes)["id"]
    width = id_kind(tokenizer).itemsize
    sample = spark.sparkContext.broadcast(_sample(given, tokenizer))
    given.mapInArrow(_encoded(tokenizer, sample), f"id {kind}, n long, tie long, ids binary").write.option("compression", "none").parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    files = max(1, -(-int(encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // file_ids))
    ordered = encoded.repartitionByRange(files, "id").sortWithinPartitions("id", "n", "tie")
    flat = ordered.select("ids").mapInArrow(_unpacked(sample), "value binary")
    flat.select(F.col("value").cast("string").alias("value")).write.option("lineSep", chr(END) * width).text(f"{path}/ids")
    index = _index(encoded.select("id", "n", "tie"), files)
    index.select("id", "part", "nth", "n").write.parquet(f"{path}/index")
    index.select("start").mapInArrow(_offset_bytes, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(f"{path}/offsets")


def flat_files(spark: SparkSession, path: str, width: int) -> list[tuple[str, int]]:
    """Every file of a flat kind with its base, how many numbers of ``width`` bytes the files before it hold, in order. One short row a
    file reaches the driver."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    base = F.coalesce(F.sum("length").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / width
    return [(r[0], int(r[1])) for r in rows.select("path", base.cast("long")).orderBy("path").collect()]


def _local_starts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total, rows = TaskContext.get().partitionId(), 0, 0
    for batch in frames:
        n = batch.column(1).to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int64)), pa.array(rows + np.arange(len(n))), pa.array(ends - n)],
                                         ["id", "n", "part", "nth", "start"])
        total, rows = int(ends[-1]) if len(n) else total, rows + len(n)


def _index(rows: DataFrame, parts: int) -> DataFrame:
    """``id, n, part, nth, start``: running sums inside ranges of ids, and a prefix sum over the ranges' totals. Partition ``part`` of the
    result holds the rows of that number, in order."""
    kind = dict(rows.dtypes)["id"]
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "n", "tie").select("id", "n")
    local = cut(ordered.mapInArrow(_local_starts, f"id {kind}, n long, part long, nth long, start long"))
    sums = local.groupBy("part").agg(F.sum("n").alias("ids"))
    bases = dict(sums.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).collect())

    def placed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            start = batch.column(4).to_numpy() + np.array([bases[p] for p in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(start)], ["id", "n", "part", "nth", "start"])

    return local.mapInArrow(placed, f"id {kind}, n long, part long, nth long, start long")


def _offset_bytes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of offsets without the topmost byte of the last, which the line separator writes."""
    for batch in frames:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype("<u8").tobytes()[:-1]], pa.binary())], ["value"])


def mapped(uri: str, kind: np.dtype) -> np.ndarray:
    """A flat file as an array: memory-mapped where the path is mounted, read otherwise."""
    found = urlparse(uri)
    if found.scheme in ("", "file"):
        return np.memmap(unquote(found.path), kind, mode="r")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read_buffer(), kind)


class Offsets:
    """The offsets files of a dataset as one rising sequence that ends with the number of all ids."""

    def __init__(self, files: list[tuple[str, int]], ids: int):
        self.files, self.ids = files, ids
        self.place = {int(re.search(r"part-(\d+)", name.rsplit("/", 1)[-1])[1]): k for k, (name, _) in enumerate(files)}
        self.name, self.flat = None, np.empty(0, np.uint64)

    def _file(self, k: int) -> np.ndarray:
        if self.name != k:
            self.name, self.flat = k, mapped(self.files[k][0], np.dtype("<u8"))
        return self.flat

    def bounds(self, part: int, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents of one file start and end."""
        k = self.place[part]
        flat = self._file(k)
        start, last = flat[nth].astype(np.int64), nth == len(flat) - 1
        end = flat[np.minimum(nth + 1, len(flat) - 1)].astype(np.int64)
        if last.any():
            later = next((j for j in range(k + 1, len(self.files)) if j + 1 == len(self.files) or self.files[j + 1][1] > self.files[j][1]), None)
            following = self._file(later) if later is not None else []
            end[last] = int(following[0]) if len(following) else self.ids
        return start, end


def read_dataset(spark: SparkSession, path: str, tokenizer: str, digest: bool = False) -> DataFrame:
    """``id, start, n`` and ``ids`` (little-endian 32-bit bytes, the end id included), or with ``digest`` only their ``crc32``.

    start and n come from the memory-mapped offsets, ids from the mapped file that holds them; a file's documents are read in file
    order. Offsets that give a document another length than the index fail the read."""
    index, kind = spark.read.parquet(f"{path}/index"), id_kind(tokenizer)
    id_files, offset_files = flat_files(spark, f"{path}/ids", kind.itemsize), flat_files(spark, f"{path}/offsets", 8)
    names, firsts = [f for f, _ in id_files], np.array([b for _, b in id_files], np.int64)
    size = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ids_in_all = int(size) // kind.itemsize

    def taken(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, file, flat = Offsets(offset_files, ids_in_all), None, None
        for batch in frames:
            part, nth, want = (batch.column(k).to_numpy() for k in (1, 2, 3))
            start, end = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            for p in np.unique(part).tolist():
                some = np.flatnonzero(part == p)
                start[some], end[some] = offsets.bounds(p, nth[some])
            if (end - start != want).any():
                raise ValueError(f"offsets and index of {path} disagree")
            out = []
            for k, s, e in zip((np.searchsorted(firsts, start, side="right") - 1).tolist(), start.tolist(), end.tolist()):
                if k != file:
                    file, flat = k, mapped(names[k], kind)
                ids = flat[s - int(firsts[k]):e - int(firsts[k])].astype("<u4")
                if len(ids) != e - s:
                    raise ValueError(f"ids of {path} end before an offset")
                out.append(zlib.crc32(ids) if digest else ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), pa.array(end - start), pa.array(out, pa.int64() if digest else pa.binary())], ["id", "start", "n", "out"])

    ordered = index.select("id", "part", "nth", "n").repartition("part", F.floor(F.col("nth") / 10_000)).sortWithinPartitions("part", "nth")
    out = ordered.mapInArrow(taken, f"id {dict(index.dtypes)['id']}, start long, n long, out {'long' if digest else 'binary'}")
    return out.withColumnRenamed("out", "crc32" if digest else "ids")
