"""Words of a text as 64-bit numbers, without one Python object a word.

A word is a run of bytes other than the six ASCII spaces. Its number is a sum of random values of its bytes, each times a power of
an odd base; running totals give the sums of all words at once. Two different words share a number with a probability of about 2^-64."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
#: Bytes that running totals cover at a time where only stretches of a text are numbered.
SHORT_PIECE = 1 << 16
_RANDOM = np.random.RandomState(20)
BYTE_VALUES = _RANDOM.randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POSITIONS = _RANDOM.randint(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as a piece needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 4096, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, inverse))
            assert (self.up * self.down == 1).all()
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut before a space, so that work on a very long text needs little memory at a time."""
    out, start = [], 0
    while len(data) - start > size:
        ends = [i for i in (data.find(bytes([s]), start + size) for s in (32, 9, 10, 11, 12, 13)) if i >= 0]
        if not ends:
            break
        out.append(data[start:min(ends)])
        start = min(ends)
    return [*out, data[start:]]


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of some bytes starts and ends, and its number."""
    space = np.empty(len(b) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = IS_SPACE[b]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _POWERS.of(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[b] * up[:len(b)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def numbers_of(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each given stretch of some bytes, as ``spans`` numbers words. Stretches are in order and do not overlap; the
    running totals cover about SHORT_PIECE bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SHORT_PIECE, side="right")))
        high = int(ends[to - 1])
        up, down = _POWERS.of(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_VALUES[b[low:high]] * up[:high - low], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def word_numbers(data: bytes, lower: bool = False) -> np.ndarray:
    """One number for each word, in order."""
    found = [np.empty(0, np.uint64)]
    for piece in pieces(data):
        b = np.frombuffer(piece, np.uint8)
        found.append(spans(LOWER[b] if lower else b)[2])
    return np.concatenate(found)


def windows(numbers: np.ndarray, width: int) -> np.ndarray:
    """One number for each run of ``width`` words (64 at most), in order; none if there are fewer words."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = h + numbers[k:k + n] * _POSITIONS[k]
    return mix(h)
