"""Quality rules: fixed rules on a document's statistics, then gradient-boosted trees over the same statistics.

The trees are grown here on binned statistics with the logistic loss. For chosen statistics the score may only fall as they rise:
a split that would do otherwise is not made, and the bound between its two sides holds for all that is grown below. A forest is a few
numpy arrays of complete binary trees, and a batch of documents walks down all of them level by level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import needed, place, tidy
from sondeo.llm.labelled import sample
from sondeo.llm.words import IS_SPACE, PIECE, windows, word_numbers

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: The fixed rules: too few words, or more than this percentage of words in repeated 8-word windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WIDTH = 20, 30, 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that the trees see, and the direction in which the score may move as each rises (0: any).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": 0, "exclamation_share": -1,
            "dup_line_share": -1, "repeat_share": -1, "words_per_line": 0}
#: Labelled rows of each label used for fitting, and the score from which a document is kept.
SAMPLE, KEEP = 10_000, 0.5
#: Documents judged at a time.
BLOCK = 256


def _repeated(numbers: np.ndarray) -> int:
    """Words that lie in an 8-word window which occurs twice or more, its first place included."""
    seen = windows(numbers, REPEAT_WIDTH)
    ordered = np.sort(seen)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(seen, twice))
    change = np.zeros(len(numbers) + 1, np.int64)
    change[at] += 1
    np.subtract.at(change, at + REPEAT_WIDTH, 1)
    return int((np.cumsum(change) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts in the order of ``BASE``, and the trees' inputs in the order of ``FEATURES``. Null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.zeros(256, np.int64)
    for at in range(0, len(data), PIECE):
        count += np.bincount(np.frombuffer(data[at:at + PIECE], np.uint8), minlength=256)
    numbers = word_numbers(data)
    n_words = len(numbers)
    chars = int(count.sum() - count[0x80:0xC0].sum() - count[IS_SPACE].sum())
    symbols = int(count[SYMBOLS].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = _repeated(numbers)
    per_char, per_word = 1 / max(chars, 1), 1 / max(n_words, 1)
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum() - symbols - count[33]
    features = [np.log1p(n_words), chars * per_word, symbols * per_char, count[65:91].sum() * per_char, count[48:58].sum() * per_char, marks * per_char,
                count[33] * per_char, dup_lines / max(len(lines), 1), repeated * per_word, n_words / max(len(lines), 1)]
    return [n_words, chars, symbols, dup_lines, repeated], features


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: inner nodes in level order (children of k are 2k+1 and 2k+2), then the leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def _best_split(bins, grad, hess, low, high, direction, n_bins, smooth, least):
    """(gain, feature, bin, left value, right value) of one node's rows, or None."""
    g_all, h_all = grad.sum(), hess.sum()
    best = None
    for f in range(bins.shape[1]):
        g = np.cumsum(np.bincount(bins[:, f], weights=grad, minlength=n_bins))[:-1]
        h = np.cumsum(np.bincount(bins[:, f], weights=hess, minlength=n_bins))[:-1]
        left, right = np.clip(-g / (h + smooth), low, high), np.clip(-(g_all - g) / (h_all - h + smooth), low, high)
        worth = lambda v, a, b: -(a * v + 0.5 * (b + smooth) * v * v)
        gain = worth(left, g, h) + worth(right, g_all - g, h_all - h) - worth(np.clip(-g_all / (h_all + smooth), low, high), g_all, h_all)
        allowed = (h >= least) & (h_all - h >= least) & (direction[f] * (right - left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, k, float(left[k]), float(right[k]))
    return best


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 64,
         smooth: float = 1.0, least: float = 2.0) -> Forest:
    """A forest for labels ``y``. Without rows, or with one label alone, it scores everything by the labels' smoothed share."""
    share = (weight @ y + 1) / (weight.sum() + 2) if len(y) else 0.5
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if len(set(y.tolist())) < 2:
        return Forest(feature[:0], threshold[:0], value[:0], start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        held = {0: (np.arange(len(y)), -np.inf, np.inf, 0.0)}
        for node in range(inner):
            rows, low, high, own = held.pop(node)
            split = _best_split(bins[rows], grad[rows], hess[rows], low, high, directions, n_bins, smooth, least) if len(rows) else None
            if split is None:
                held[2 * node + 1], held[2 * node + 2] = (rows, low, high, own), (rows[:0], low, high, own)
                continue
            _, f, k, left, right = split
            feature[t, node], threshold[t, node] = f, edges[f][k]
            goes = bins[rows, f] > k
            middle = (left + right) / 2
            bounds = {-1: ((middle, high), (low, middle)), 0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}[directions[f]]
            held[2 * node + 1] = (rows[~goes], *bounds[0], left)
            held[2 * node + 2] = (rows[goes], *bounds[1], right)
        for node, (rows, _, _, own) in held.items():
            value[t, node - inner] = rate * own
            total[rows] += rate * own
    return Forest(feature, threshold, value, start)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Grows the forest on at most ``most`` documents of each label; only their statistics, some 80 bytes each, reach the driver."""
    chosen = F.broadcast(sample(labels, label, most))
    texts = needed(docs, id=id_col, text=text_col).join(chosen, "id").select("id", "text", "label", "share")

    def measured(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            x = [statistics(t.as_py())[1] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2), batch.column(3)], ["id", "x", "label", "share"])

    kind = dict(texts.dtypes)["id"]
    frame = texts.mapInArrow(tidy(measured), f"id {kind}, x array<double>, label int, share double").toPandas().sort_values("id", kind="stable")
    x = np.array(frame["x"].tolist(), float).reshape(-1, len(FEATURES))
    return grow(x, frame["label"].to_numpy(float), 1 / frame["share"].to_numpy(float), list(FEATURES.values()))


def quality_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, carry: str | None = None) -> DataFrame:
    """``id_col``, the base counts, ``base_failed``, ``score`` and ``kept`` of every row.

    Null and empty texts count as zero everywhere and fail the base rules; repeated rows are judged alike; an empty table gives an
    empty result. Columns other than the two named are not read; with ``carry`` all of them come along unread in one struct of that name,
    and the text is taken from there, so that it is sent once."""
    if carry:
        given, id_at, text_at = docs.select(F.struct("*").alias("carried")), place(docs, id_col), place(docs, text_col)
        kind = docs.dtypes[id_at][1]
    else:
        given, id_at, text_at = needed(docs, id=id_col, text=text_col), 0, 1
        kind = dict(given.dtypes)["id"]

    def judged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                columns = batch.column(0).flatten() if carry else batch.columns
                found = [statistics(t.as_py()) for t in columns[text_at]]
                base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
                score = forest.score(np.array([x for _, x in found], float).reshape(-1, len(FEATURES)))
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
                arrays = [columns[id_at], *[pa.array(base[:, k]) for k in range(len(BASE))], pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))]
                names = ["id", *BASE, "base_failed", "score", "kept"]
                if carry:
                    arrays, names = [*arrays, batch.column(0)], [*names, "carried"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    out = given.mapInArrow(tidy(judged), schema + (f", carried {dict(given.dtypes)['carried']}" if carry else ""))
    return out.withColumnsRenamed({"id": id_col, "carried": carry or "carried"})
