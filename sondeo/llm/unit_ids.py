"""Token ids of many whole texts at once, from units that are encoded once each.

A unit is a stretch of bytes that no token reaches out of, whatever stands around it. A batch of texts becomes one byte array; a table of
byte pairs says where units begin, each unit gets a 64-bit number, and only units whose numbers are new go to the tokenizer. Ids of
all units of a worker lie in one flat array, so a batch's ids are one ragged gather. Texts in which units would not be
safe (white space beyond ASCII, strings of special tokens that count as such) are encoded whole."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sondeo.llm import words

#: Parts texts in a batch; no UTF-8 text has this byte.
SEPARATOR = 0xFF
#: Units, and ids of units, that a worker keeps; beyond either it starts anew.
KEPT_UNITS, KEPT_IDS = 1_000_000, 8_000_000
#: Bytes of text in a batch, about; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: New units that go to the tokenizer together: what it returns for one is many times the unit.
LEARNT_UNITS = 4096

_BYTES = np.arange(256)
_WORD = np.isin(_BYTES, [*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
_MARK = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~_WORD


def word_and_mark_cuts() -> np.ndarray:
    """256 x 256: whether tokenizers that part letters, digits, marks and white space always part these two bytes. ASCII only; what
    follows an apostrophe may belong to it."""
    first = _MARK & (_BYTES != ord("'"))
    return (_WORD[:, None] & _MARK[None, :]) | (first[:, None] & _WORD[None, :])


def _odd_spaces(b: np.ndarray) -> np.ndarray:
    """Where white space stands that is not one of the six ASCII spaces (or may count as white space)."""
    found = [np.flatnonzero((b >= 0x1C) & (b <= 0x1F))]
    for lead, second, thirds in ((0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, (0x80,)), (0xE1, 0xA0, (0x8E,)), (0xE2, 0x80, (*range(0x80, 0x90), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,))):
        at = np.flatnonzero(b[:-1] == lead)
        at = at[b[at + 1] == second]
        if thirds is not None:
            at = at[np.isin(b[at + 2], thirds)]
        found.append(at)
    return np.concatenate(found)


class _Growing:
    """An array that is added to at its end. It keeps spare room, so that what it holds is seldom copied."""

    def __init__(self, kind: np.dtype | type):
        self.room, self.n = np.empty(0, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty((self.n + len(values)) * 5 // 4, self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)


class UnitEncoder:
    """Ids of batches of texts. Subclasses say where units begin and how a list of them is encoded."""

    kind = np.dtype("<u2")

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.first, self.length, self.fair = _Growing(np.int64), _Growing(np.int32), _Growing(bool)
        self.flat = _Growing(self.kind)

    # What subclasses give.
    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte. A separator is no part of any unit."""
        raise NotImplementedError

    def whole(self, b: np.ndarray) -> np.ndarray:
        """Places of bytes whose texts must be encoded whole."""
        return np.empty(0, np.int64)

    def ids_of(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def ids_of_whole(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def hashed(self, b: np.ndarray) -> np.ndarray:
        """The bytes that make a unit's number."""
        return b

    def covered(self, b: np.ndarray) -> np.ndarray:
        """Bytes that belong to units."""
        return b != SEPARATOR

    def fair_units(self, units: list[bytes], ids: list[list[int]]) -> np.ndarray:
        """Whether the ids of each unit spell it."""
        return np.ones(len(units), bool)

    # The work.
    def _learn(self, units: list[bytes], numbers: np.ndarray) -> None:
        slots = len(self.first) + np.arange(len(units), dtype=np.int32)
        for at in range(0, len(units), LEARNT_UNITS):
            some = units[at:at + LEARNT_UNITS]
            ids = self.ids_of([u.decode() for u in some])
            length = np.array([len(x) for x in ids], np.int32)
            self.first.add(len(self.flat) + np.cumsum(length, dtype=np.int64) - length)
            self.length.add(length)
            self.fair.add(self.fair_units(some, ids))
            self.flat.add(np.fromiter((t for x in ids for t in x), self.kind, int(length.sum())))
        at = np.searchsorted(self.numbers, numbers)
        self.numbers, self.slots = np.insert(self.numbers, at, numbers), np.insert(self.slots, at, slots)

    def _slots_of(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of every unit; new units are encoded first."""
        numbers, place, inverse = np.unique(words.numbers_of(self.hashed(b), starts, ends), return_index=True, return_inverse=True)
        for again in (False, True):
            at = np.minimum(np.searchsorted(self.numbers, numbers), max(len(self.numbers) - 1, 0))
            known = self.numbers[at] == numbers if len(self.numbers) else np.zeros(len(numbers), bool)
            new = np.flatnonzero(~known)
            if again or not len(new):
                break
            if len(self.first) + len(new) > KEPT_UNITS or len(self.flat) > KEPT_IDS:
                self.clear()
                new = np.arange(len(numbers))
            data = b.tobytes()
            self._learn([data[s:e] for s, e in zip(starts[place[new]].tolist(), ends[place[new]].tolist())], numbers[new])
        return self.slots[at][inverse]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids, bounds, fair``: text k has ids[bounds[k]:bounds[k + 1]], and fair[k] says whether its ids spell it."""
        data = [t.encode() for t in texts]
        b = np.frombuffer(bytes([SEPARATOR]) + bytes([SEPARATOR]).join(data) + bytes([SEPARATOR]), np.uint8)
        sizes = np.array([len(x) + 1 for x in data], np.int64)
        text_ends = np.cumsum(sizes)
        odd = np.unique(np.searchsorted(text_ends, self.whole(b), side="right"))
        odd = odd[odd < len(texts)]
        inside = self.covered(b)
        begins = self.cuts(b) & inside
        starts = np.flatnonzero(begins)
        stops = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        ends = np.empty(len(starts), np.int64)
        if len(starts):
            after = np.append(starts[1:], len(b))
            ends = np.minimum(after, stops[np.searchsorted(stops, starts, side="right")])
        owner = np.searchsorted(text_ends, starts, side="left")
        if len(odd):
            stays = ~np.isin(owner, odd)
            starts, ends, owner = starts[stays], ends[stays], owner[stays]
        fair = np.ones(len(texts), bool)
        count = np.zeros(len(texts), np.int64)
        ids = np.empty(0, self.kind)
        if len(starts):
            slots = self._slots_of(b, starts, ends)
            length = self.length.room[slots].astype(np.int64)
            np.add.at(count, owner, length)
            fair[owner[~self.fair.room[slots]]] = False
            total = int(length.sum())
            ids = self.flat.room[np.repeat(self.first.room[slots] - np.cumsum(length) + length, length) + np.arange(total)]
        if len(odd):
            pieces = np.split(ids, np.cumsum(count)[:-1])
            for k, found in zip(odd.tolist(), self.ids_of_whole([texts[k] for k in odd.tolist()])):
                pieces[k] = np.array(found, self.kind)
                count[k] = len(found)
                fair[k] = bool(self.fair_units([data[k]], [found])[0])
            ids = np.concatenate(pieces)
        return ids, np.concatenate([[0], np.cumsum(count)]), fair


class _Library(UnitEncoder):
    """A tokenizer of the tokenizers library. ``plain``: strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if plain else [x.content.encode() for x in added]
        if any(not x.special for x in added):
            raise ValueError("added tokens that are not special may reach over units")
        self.pairs = self._pairs().ravel()
        super().__init__()

    def _pairs(self) -> np.ndarray:
        raise NotImplementedError

    def whole(self, b: np.ndarray) -> np.ndarray:
        found = [_odd_spaces(b)]
        data = b.tobytes() if self.special else b""
        for name in self.special:
            at = data.find(name)
            while at >= 0:
                found.append(np.array([at]))
                at = data.find(name, at + 1)
        return np.concatenate(found)

    def ids_of(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    ids_of_whole = ids_of

    def _after(self, b: np.ndarray) -> np.ndarray:
        """Whether the pair table parts each byte from the one before."""
        out = np.empty(len(b), bool)
        out[0] = False
        out[1:] = self.pairs[b[:-1].astype(np.uint16) * np.uint16(256) + b[1:]]
        return out


class ByteUnits(_Library):
    """Byte-level BPE over letters, digits and marks with at most one space before each. Of a run of white space all but the last
    character is a unit; the last is one by itself if it is no space, and else begins the next unit."""

    def _pairs(self) -> np.ndarray:
        space, table = words.IS_SPACE, word_and_mark_cuts()
        other = ~space & (_BYTES != SEPARATOR)
        return table | (_BYTES == SEPARATOR)[:, None] | (other[:, None] & space[None, :]) | ((space & (_BYTES != 0x20))[:, None] & other[None, :])

    def cuts(self, b: np.ndarray) -> np.ndarray:
        out, space = self._after(b), words.IS_SPACE[b]
        out[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & (b[2:] != SEPARATOR)
        return out


class WordUnits(_Library):
    """BPE over lower-cased letters, digits and marks with word ends; white space is dropped."""

    def _pairs(self) -> np.ndarray:
        space = words.IS_SPACE | (_BYTES == SEPARATOR)
        return word_and_mark_cuts() | (space[:, None] & ~space[None, :])

    def cuts(self, b: np.ndarray) -> np.ndarray:
        return self._after(b)

    def hashed(self, b: np.ndarray) -> np.ndarray:
        return words.LOWER[b]

    def covered(self, b: np.ndarray) -> np.ndarray:
        return ~words.IS_SPACE[b] & (b != SEPARATOR)


class PieceUnits(UnitEncoder):
    """Sentence pieces by merges without pre-tokens: no piece reaches over two bytes that no piece of the vocabulary holds side by side.
    Texts are given with the space that the model puts before them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        together = np.zeros((256, 256), bool)
        self.spelling = [piece_bytes(self.model, k) for k in range(size)]
        for spelled in self.spelling:
            x = np.frombuffer(spelled, np.uint8)
            together[x[:-1], x[1:]] = True
        if together[10].any() or together[:, 10].any():
            raise ValueError("a piece holds a line end beside something else")
        continued = (_BYTES >= 0x80) & (_BYTES <= 0xBF)
        self.pairs = (~together & ~continued[None, :]).ravel()
        self.lead = len(self.model.encode("\n"))
        super().__init__()

    def cuts(self, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(b), bool)
        out[0] = False
        out[1:] = self.pairs[b[:-1].astype(np.uint16) * np.uint16(256) + b[1:]]
        return out

    def ids_of(self, units: list[str]) -> list[list[int]]:
        return [x[self.lead:] for x in self.model.encode(["\n" + u for u in units], num_threads=1)]

    def whole(self, b: np.ndarray) -> np.ndarray:
        """The model takes its own sign for a space, where it stands in a text, for a space."""
        at = np.flatnonzero(b[:-2] == 0xE2)
        return at[(b[at + 1] == 0x96) & (b[at + 2] == 0x81)]

    def ids_of_whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)

    def fair_units(self, units: list[bytes], ids: list[list[int]]) -> np.ndarray:
        return np.array([b"".join([self.spelling[t] for t in x]) == u for u, x in zip(units, ids)], bool)


def piece_bytes(model, k: int) -> bytes:
    """What a piece stands for; nothing for control pieces."""
    if model.is_control(k) or model.is_unknown(k):
        return b""
    piece = model.id_to_piece(k)
    return bytes([int(piece[1:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()


@lru_cache(maxsize=8)
def encoder(kind: type[UnitEncoder], *given) -> UnitEncoder:
    """Made once in each Python worker, which keeps its units from task to task."""
    return kind(*given)


def batches(frames: Iterable[pa.RecordBatch], text: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Stretches of rows whose texts have about ``most`` bytes together, at least one row each. Never more than one frame's rows."""
    for frame in frames:
        if not frame.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(frame.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < frame.num_rows:
            total = np.cumsum(sizes[at:])
            n = max(1, int(np.searchsorted(total, most, side="right")))
            yield frame.slice(at, n)
            at += n
