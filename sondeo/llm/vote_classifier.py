"""Quality classifier by neighbours' votes in a latent-semantic space.

A document is its counts of byte trigrams, hashed into a fixed number of terms, as tf-idf. A truncated singular value decomposition of a
bounded labelled sample gives the latent space; the sample's vectors, their labels and weights are the model. Every document's
cosines with all of them are exact products of blocks, and its nearest neighbours vote, each by its similarity. The sample takes
both labels alike, so each vote counts as many times as its row stands for among all labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import needed, place, tidy
from sondeo.llm.labelled import held_out, sample
from sondeo.llm.words import pieces, spans

#: Hashed terms, latent dimensions, neighbours that vote, documents in a block of products, and rows of it at a time where a step needs
#: wider numbers in between.
TERMS, LATENT, NEIGHBOURS, BLOCK, ROWS = 4096, 64, 25, 256, 64
#: Labelled rows of each label in the model: at most 2 * SAMPLE * LATENT * 4 bytes, 1 MB, are sent to the executors.
SAMPLE = 2000
#: How steeply a vote falls with the similarity, and the score from which label 1 is predicted.
POWER, THRESHOLD = 16, 0.7


def _again(b: np.ndarray, last: np.uint64 | None) -> tuple[np.ndarray, np.uint64 | None]:
    """Some bytes in which a word that equals the one before it is a single byte 1, and the last word's number."""
    starts, ends, numbers = spans(b)
    if not len(numbers):
        return b, last
    same = np.concatenate([[last is not None and numbers[0] == last], numbers[1:] == numbers[:-1]])
    if same.any():
        b, change = b.copy(), np.zeros(len(b) + 1, np.int64)
        b[starts[same]] = 1
        change[starts[same] + 1] += 1
        change[ends[same]] -= 1
        b = b[np.cumsum(change[:-1]) == 0]
    return b, numbers[-1]


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text; a word said twice in a row is a mark of its own."""
    counts, end, last = np.zeros(TERMS, np.int64), np.empty(0, np.uint8), None
    for piece in pieces((text or "").encode("utf-8", "surrogatepass")):
        b, last = _again(np.frombuffer(piece, np.uint8), last)
        b = np.concatenate([end, b]).astype(np.uint32)
        end = b[-2:].astype(np.uint8)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=TERMS)
    return counts


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors, one per row of counts; a row without terms has a zero vector."""
        x = np.empty(counts.shape, np.float32)
        for at in range(0, len(x), ROWS):
            x[at:at + ROWS] = np.log1p(counts[at:at + ROWS]).astype(np.float32) * self.idf
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each row's nearest neighbours; 0 without terms, as nothing speaks for such a text."""
        if not len(self.label):
            return np.where(counts.sum(axis=1) > 0, 0.5, 0.0)
        cosine = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.concatenate([np.argpartition(-cosine[at:at + ROWS], k - 1, axis=1)[:, :k] for at in range(0, max(len(cosine), 1), ROWS)])
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** POWER * self.weight[near]
        total = vote.sum(axis=1)
        share = (vote * self.label[near]).sum(axis=1) / np.where(total > 0, total, 1)
        prior = (self.weight @ self.label) / self.weight.sum()
        return np.where(counts.sum(axis=1) > 0, np.where(total > 0, share, prior), 0.0).clip(0, 1)


def decompose(counts: np.ndarray, latent: int = LATENT, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """idf and the main axes of the sample's tf-idf, by subspace iteration from a fixed start."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = np.log1p(counts).astype(np.float32) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    q = np.linalg.qr(np.random.RandomState(7).standard_normal((TERMS, latent)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return idf, q


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of at most ``most`` documents of each label. Only these rows' counts, 8 kB each, reach the driver."""
    chosen = F.broadcast(sample(labels, label, most))
    texts = needed(docs, id=id_col, text=text_col).join(chosen, "id").select("id", "text", "label", "share")

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            rows = [np.minimum(term_counts(t.as_py()), 65535).astype("<u2").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2), batch.column(3)], ["id", "x", "label", "share"])

    kind = dict(texts.dtypes)["id"]
    frame = texts.mapInArrow(tidy(counted), f"id {kind}, x binary, label int, share double").toPandas().sort_values("id", kind="stable")
    counts = np.frombuffer(b"".join(map(bytes, frame["x"])), "<u2").reshape(-1, TERMS)
    empty = Model(np.ones(TERMS, np.float32), np.zeros((TERMS, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0), np.zeros(0))
    if not len(counts):
        return empty
    idf, axes = decompose(counts)
    bare = Model(idf, axes, empty.vectors, empty.label, empty.weight)
    vectors = np.concatenate([bare.latent(counts[at:at + BLOCK]) for at in range(0, len(counts), BLOCK)])
    return Model(idf, axes, vectors, frame["label"].to_numpy(float), 1 / frame["share"].to_numpy(float))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: str | None = None) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row, from the text alone.

    A text of fewer than three bytes, an empty or a null one scores 0. Repeated rows score alike; an empty table gives an empty
    result. Columns other than the two named are not read; with ``carry`` all of them come along unread in one struct of that name, and
    the text is taken from there, so that it is sent once."""
    if carry:
        given, id_at, text_at = docs.select(F.struct("*").alias("carried")), place(docs, id_col), place(docs, text_col)
        kind = docs.dtypes[id_at][1]
    else:
        given, id_at, text_at = needed(docs, id=id_col, text=text_col), 0, 1
        kind = dict(given.dtypes)["id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                columns = batch.column(0).flatten() if carry else batch.columns
                counts = np.empty((batch.num_rows, TERMS), np.int32)
                for k, t in enumerate(columns[text_at]):
                    counts[k] = term_counts(t.as_py())
                arrays, names = [columns[id_at], pa.array(sent.value.score(counts))], ["id", "score"]
                if carry:
                    arrays, names = [*arrays, batch.column(0)], [*names, "carried"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    out = given.mapInArrow(tidy(scored), f"id {kind}, score double" + (f", carried {dict(given.dtypes)['carried']}" if carry else ""))
    out = out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["carried"] if carry else []))
    return out.withColumnsRenamed({"id": id_col, "carried": carry or "carried"})
