"""Runs: stretches of consecutive words that repeat with a period, found by matching along diagonals.

Word i matching word i - q lies on the diagonal of lag q. A run of period q is a stretch of a diagonal without a break. Going through a
text, each position asks for earlier occurrences of what stands there and adds one to the length matched on their lags; a diagonal that
breaks after enough matches is a run. Diagonals are kept sparse by scale: periods from ``low`` to ``high`` need at least ``high`` matches
in a row, so a position looks for a whole stretch of ``high`` words, and of its earlier occurrences only the nearest can lie on the
diagonal of a run's smallest period: were the nearest at a lag d < q, the text there would have both periods over d + q words and so a
smaller one than q. One active lag a position and scale is all there is, and a scale is three times the last: n log n steps for n words."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm import words
from sondeo.llm.common import needed
from sondeo.llm.unit_ids import batches

#: A run has at least this many words, and at least so many times its period.
LEAST, TIMES = 6, 4
FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def scales(n: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """``low, high, width`` of the periods that a text of n words can hold: matches that each of them needs at least."""
    low = 1
    while max(least, times * low) <= n:
        width = max(least, times * low) - low
        yield low, width, width
        low = width + 1


def runs(numbers: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of the runs of many texts one after the other: ``numbers`` has a number for each word, ``text`` that of its text."""
    out: list[tuple[np.ndarray, ...]] = []
    longest = int(np.bincount(text).max()) if len(text) else 0
    powers = np.full(len(numbers) + 1, np.uint64(words.BASE))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers * powers[:-1], dtype=np.uint64)])
    for low, high, width in scales(longest, least, times):
        n = len(numbers) - width + 1
        if n <= 0:
            break
        # Stretches of ``width`` words, made comparable by bringing all to the last power, and told apart by text.
        stretch = words.mix((total[width:] - total[:n]) * powers[n - 1::-1][:n]) ^ words.mix(text[:n].astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(text[:n] == text[width - 1:])
        stretch = stretch[at]
        order = np.argsort(stretch, kind="stable")
        same = np.flatnonzero(stretch[order[1:]] == stretch[order[:-1]]) + 1
        lag = np.zeros(len(numbers) + 1, np.int64)
        here, before = at[order[same]], at[order[same - 1]]
        lag[here] = here - before
        lag[lag > high] = 0
        # A diagonal is active as long as the nearest lag stays the same; where it changes, its matches end.
        turns = np.flatnonzero(lag[1:] != lag[:-1]) + 1
        first = np.concatenate([[0], turns])
        last = np.concatenate([turns, [len(lag)]])
        first, last = first[lag[first] > 0], last[lag[first] > 0]
        period = lag[first]
        matches = last - first + width - 1
        enough = (period >= low) & (matches + period >= np.maximum(least, times * period))
        out.append((first[enough] - period[enough], matches[enough] + period[enough], period[enough]))
    start, length, period = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in out)]) for k in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def seeded(h: int, n: int) -> np.ndarray | None:
    """The words of a text that is to be made periodic, as places in the original; None if it stays as it is."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _digests(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames, 1):
        keys = batch.column(2).to_pylist()
        texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
        numbers, chosen = [], []
        for h, data in zip(keys, texts):
            found = words.word_numbers(data)
            chosen.append(seeded(h, len(found)) if h is not None else None)
            numbers.append(found if chosen[-1] is None else found[chosen[-1]])
        n = np.array([len(x) for x in numbers], np.int64)
        base = np.concatenate([[0], np.cumsum(n)])
        flat = np.concatenate([np.empty(0, np.uint64), *numbers])
        start, length, period = runs(flat, np.repeat(np.arange(len(n)), n))
        bounds = np.searchsorted(start, base)
        columns: list[list] = [[] for _ in range(7)]
        for k, data in enumerate(texts):
            s, l, q = (x[bounds[k]:bounds[k + 1]].tolist() for x in (start - base[k], length, period))
            kept = data.split()
            if chosen[k] is not None:
                kept = [kept[i] for i in chosen[k].tolist()]
            best = (None, None, None)
            if s:
                inside = np.zeros(len(kept) + 1, np.int64)
                np.add.at(inside, np.array(s) + q, 1)
                np.add.at(inside, np.array(s) + l, -1)
                kept = [kept[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0).tolist()]
                best = min(zip(s, l, q), key=lambda r: (-r[1], r[0], r[2]))
            found = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, l, q))
            for column, value in zip(columns, (len(s), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                                               hashlib.sha256(found.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", *(f.split()[0] for f in FIELDS.split(", "))])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_runs``, the longest run's ``start, length, period, exponent_milli``, ``runs_sha256, collapsed_sha256``, one row per row.

    A text is first made periodic from some word on where its id's crc32 says so (see ``seeded``); a row without an id stays as it is. A
    null or empty text has no words and no runs. Repeated rows get repeated results. An empty table gives an empty result. Columns other
    than the two named are not read. Nothing is shuffled; a text's words are looked at in one task."""
    given = needed(docs, id=id_col, text=text_col).withColumn("key", F.crc32(F.col("id").cast("string").cast("binary")))
    return given.mapInArrow(_digests, f"id {dict(given.dtypes)['id']}, {FIELDS}").withColumnRenamed("id", id_col)
