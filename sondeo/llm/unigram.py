"""Unigram segmentation over the pieces of a SentencePiece model: the path of highest total score.

Scores are whole numbers, so that sums do not depend on their order: -1000 * ln(1 - s) for a piece that the model scores s <= 0 (a merge
model scores by rank; its logarithm is a Zipf prior). A character without a piece is spelled by its bytes, each at a fixed high cost.
Of two equal paths the one whose last piece is longer wins, at every position.

A text is taken with one space put before it. No piece has a space after another character and none but the byte's has a line feed,
so paths break before every run of spaces and around line feeds: `PRE_TOKEN` cuts there, and what lies between can be solved alone.
The model's own mark for a space is spelled by bytes where it is an ordinary character of a text, so decoding is exact."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")
#: The same, and cut after Latin letters before a mark: fewer different parts, for vocabularies without a piece over such a place.
LETTER, SIGN = "[A-Za-z\u00C0-\u024F]", r"[.,;:!?#*$%&|<>()]"
FINER = re.compile(rf" *{LETTER}+(?={SIGN})|{PRE_TOKEN.pattern}")
MARK = "▁"
NONE = -(1 << 62)
BYTE_COST = 20_000
#: Distinct parts that a task keeps solved. When they are more, the store becomes the older one, from which parts in use are taken over.
KEPT, LONGEST = 300_000, 256


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.id: dict[str, int] = {}
        self.score: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes_of.append(b"")
            else:
                own = piece.replace(MARK, " ")
                if "\n" in own or " " in own.lstrip(" "):
                    raise ValueError(f"a piece reaches over a word's end: {own!r}")
                self.bytes_of.append(own.encode())
                self.id[own], self.score[own] = k, -round(1000 * math.log1p(max(-model.get_score(k), 0)))
        self.longest = max(map(len, self.id))
        #: Every beginning and every ending of a piece with the score it has as a piece itself, NONE if it is none.
        self.ahead = {own[:k]: NONE for own in self.id for k in range(1, len(own))} | self.score
        self.behind = {own[k:]: NONE for own in self.id for k in range(1, len(own))} | self.score
        self.parts = PRE_TOKEN if any(re.search(LETTER + SIGN, own) for own in self.id) else FINER
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forward(self, s: str, best: list[int], end: int) -> list[int]:
        """Raises ``best[p]``, the score of the best way to position p, by pieces that start before ``end``; returns each best last piece's length."""
        back, ahead, longest, size = [0] * (len(s) + 1), self.ahead.get, self.longest, len(s)
        for q in range(end):
            here = best[q]
            if here == NONE:
                continue
            alone = ahead(s[q])
            if alone is not None:
                for p in range(q + 1, min(q + longest, size) + 1):
                    worth = ahead(s[q:p])
                    if worth is None:
                        break
                    if here + worth > best[p]:
                        best[p], back[p] = here + worth, p - q
            if alone is None or alone == NONE:
                worth = here - BYTE_COST * len(s[q].encode("utf-8", "surrogatepass"))
                if worth > best[q + 1]:
                    best[q + 1], back[q + 1] = worth, 1
        return back

    def trace(self, s: str, back: list[int], p: int) -> tuple[int, list[int]]:
        """Ids of the best path to position p, and the position it comes in at."""
        out: list[int] = []
        while back[p]:
            piece = s[p - back[p]:p]
            known = self.id.get(piece)
            if known is None:
                out.extend(self.byte_id[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            else:
                out.append(known)
            p -= back[p]
        out.reverse()
        return p, out

    def solve(self, token: str) -> tuple[int, list[int]]:
        best = [0] + [NONE] * len(token)
        back = self.forward(token, best, len(token))
        return best[-1], self.trace(token, back, len(token))[1]

    def _solved(self, part: str) -> bytes:
        found = self.known.get(part) or self.older.get(part) or np.array(self.solve(part)[1], "<i4").tobytes()
        if len(part) <= LONGEST:
            self.known[part] = found
        return found

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        parts = self.parts.findall(" " + text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > KEPT:
                self.known, self.older = {}, self.known
            return b"".join(map(self._solved, parts))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)
