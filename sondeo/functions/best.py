"""The best rows of many queries by inner product, kept in arrays while rows pass by."""

from __future__ import annotations

import numpy as np

#: Scores held at once; components of single pairs held at once.
SCORE_CELLS, PAIR_CELLS = 2**21, 2**20


class Best:
    """The best scores of every query, falling, and the numbers of their rows; -inf and -1 where there is none yet.

    Scores are rounded to nine digits. Rows come in the order in which they win ties: of equal scores the earlier stays. With
    ``positive`` no component is negative, and rows that share none with a query are left out of its list."""

    def __init__(self, vectors: np.ndarray, k: int, positive: bool = False):
        self.vectors, self.short, self.k, self.positive = vectors, vectors.astype(np.float32), k, positive
        self.norms = np.linalg.norm(vectors, axis=1)
        self.scores, self.rows = np.full((len(vectors), k), -np.inf), np.full((len(vectors), k), -1)
        self.seen = 0

    def add(self, matrix: np.ndarray, rows: np.ndarray, cells: int = SCORE_CELLS) -> np.ndarray:
        """Ranks the rows of ``matrix`` in tiles that grow with those seen; gives the numbers of rows that entered a list."""
        entered, at = np.zeros(len(matrix), bool), 0
        while at < len(matrix):
            end = min(len(matrix), at + max(4 * self.k, self.seen))
            self._tile(matrix[at:end], rows[at:end], cells, entered[at:end])
            self.seen += end - at
            at = end
        return rows[entered]

    def _tile(self, matrix: np.ndarray, rows: np.ndarray, cells: int, entered: np.ndarray) -> None:
        """A product in single precision, whose error ``slack`` bounds, names the cells that may pass a query's last score; these are
        computed in double precision. Where they are many (the first rows, many copies) the whole tile is."""
        short = matrix.astype(np.float32)
        slack = (matrix.shape[1] + 8) * 2.0 ** -23 * float(np.nanmax(np.linalg.norm(matrix, axis=1), initial=0.0))
        step = max(1, cells // len(matrix))
        for at in range(0, len(self.vectors), step):
            vectors, floor = self.vectors[at:at + step], self.scores[at:at + step, -1]
            least = (floor - slack * self.norms[at:at + step]).astype(np.float32)
            if self.positive:
                least = np.maximum(least, np.finfo(np.float32).tiny)
            likely = self.short[at:at + step] @ short.T >= least[:, None]
            if np.count_nonzero(likely) <= likely.size // 8:
                who, where = np.nonzero(likely)
                value, some = np.empty(len(who)), max(1, PAIR_CELLS // max(1, matrix.shape[1]))
                for i in range(0, len(who), some):
                    value[i:i + some] = np.einsum("ij,ij->i", vectors[who[i:i + some]], matrix[where[i:i + some]])
                value = self._rounded(value)
                passes = value > floor[who]
                who, where, value = who[passes], where[passes], value[passes]
            else:
                who, where, value = top_cells(self._rounded(vectors @ matrix.T), floor, self.k)
            if len(who):
                self._enter(at + who, value, rows[where])
                entered[where] = True

    def _rounded(self, scores: np.ndarray) -> np.ndarray:
        if self.positive:
            scores[scores <= 0] = np.nan
        return np.round(scores, 9)

    def _enter(self, who: np.ndarray, value: np.ndarray, rows: np.ndarray) -> None:
        hit, first, count = np.unique(who, return_index=True, return_counts=True)
        wide = (len(hit), self.k + int(count.max()))
        scores, numbers = np.full(wide, -np.inf), np.full(wide, -1)
        scores[:, :self.k], numbers[:, :self.k] = self.scores[hit], self.rows[hit]
        cell = np.repeat(np.arange(len(hit)), count), self.k + np.arange(len(who)) - np.repeat(first, count)
        scores[cell], numbers[cell] = value, rows
        order = np.argsort(-scores, axis=1, kind="stable")[:, :self.k]
        self.scores[hit], self.rows[hit] = np.take_along_axis(scores, order, 1), np.take_along_axis(numbers, order, 1)


def top_cells(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's ``k`` best cells above its floor; the first of equal ones."""
    scores[~(scores > floor[:, None])] = -np.inf
    n = scores.shape[1]
    if n > k:
        last = np.partition(scores, n - k, axis=1)[:, n - k, None]
        chosen, tied = scores > last, (scores == last) & (scores > -np.inf)
        chosen |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - np.count_nonzero(chosen, axis=1)[:, None])
    else:
        chosen = scores > -np.inf
    who, where = np.nonzero(chosen)
    return who, where, scores[who, where]
