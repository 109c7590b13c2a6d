"""Vectorised pre-tokenisation: where the pieces that byte-pair merging works on begin and end, for whole batches of texts.

The rules are those of two public tokenizers' patterns, restated on character classes (letter, number, space, other):

* "byte": contractions, then a space may lead a run of letters, numbers or others; of a run of spaces the last is left over.
* "word": contractions, runs of letters, single numbers, runs of others; spaces are dropped.

Texts with characters whose class differs between Unicode versions, or with special strings, are left to the caller.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

from .words import distinct

OTHER, LETTER, NUMBER, SPACE = range(4)
_LIMIT = 0x2C00
_SETTLED = ((0, 0x530), (0x1E00, _LIMIT))
"""Code points whose classes have long been the same in all Unicode versions in use."""
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


@cache
def _table() -> tuple[np.ndarray, np.ndarray]:
    kinds, settled = np.zeros(_LIMIT + 1, np.uint8), np.zeros(_LIMIT + 1, bool)
    for a, b in _SETTLED:
        settled[a:b] = True
        for c in range(a, b):
            kind = unicodedata.category(chr(c))[0]
            kinds[c] = SPACE if c in _WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return kinds, settled


class Batch:
    """Code points of texts one after another; text t is codes[first[t]:first[t + 1]]."""

    def __init__(self, texts: list[str]) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=self.first[1:])
        kinds, settled = _table()
        low = np.minimum(self.codes, _LIMIT)
        self.kinds, self.settled = kinds[low], settled[low]

    def unsettled(self) -> np.ndarray:
        """Which texts hold a character outside the settled ranges."""
        sums = np.concatenate([[0], np.cumsum(~self.settled)])
        return sums[self.first[1:]] > sums[self.first[:-1]]

    def pieces(self, rule: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pieces, in order."""
        codes, kinds, n = self.codes, self.kinds.astype(np.int8), len(self.codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.zeros(n + 1, bool)
        begin[self.first] = True
        before = np.concatenate([[np.int8(-1)], kinds[:-1]])
        before[begin[:-1]] = -1
        after = np.concatenate([kinds[1:], [np.int8(-1)]])
        after[begin[1:]] = -1
        space = kinds == SPACE
        start = ~space & (before != kinds)
        if rule == "byte":
            led = np.concatenate([[False], codes[:-1] == 0x20]) & (before == SPACE)
            start &= ~led
            start |= space & ((before != SPACE) | ((after != SPACE) & (after != -1)))
        else:
            start |= kinds == NUMBER
        self._contractions(start, after)
        border = start | begin[:-1]
        if rule == "word":
            border |= space
        starts, borders = np.flatnonzero(start), np.append(np.flatnonzero(border), n)
        return starts, borders[np.searchsorted(borders, starts, side="right")]

    def _contractions(self, start: np.ndarray, after: np.ndarray) -> None:
        at = np.flatnonzero(start & (self.codes == ord("'")) & (after == LETTER))
        padded = np.append(self.codes, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        end = self.first[np.searchsorted(self.first, at, side="right")]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (at + 2 < end)
        size = np.where(single, 1, np.where(double, 2, 0))
        at, size, end = at[size > 0], size[size > 0], end[size > 0]
        start[at + 1] = False
        rest = at + 1 + size
        rest = rest[(rest < end) & (self.kinds[np.minimum(rest, len(self.kinds) - 1)] == LETTER)]
        start[rest] = True

    def distinct(self, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The distinct pieces in UTF-8, and which of them each piece is."""
        sizes = np.ones(len(self.codes), np.int8)
        for bound in (0x80, 0x800, 0x10000):
            sizes += self.codes >= bound
        at = np.zeros(len(self.codes) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        body = np.frombuffer(self.codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        return distinct(body, at[starts], at[ends])

    def texts_of(self, starts: np.ndarray) -> np.ndarray:
        """For sorted piece starts: how many pieces lie before each text's begin, and all of them."""
        return np.searchsorted(starts, self.first)


class Known:
    """What is known of pieces, by their bytes, in about `most` bytes: once the young half is full it becomes the old one, and what is asked for again moves over."""

    def __init__(self, most: int) -> None:
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def of(self, pieces: list[bytes], make: Callable[[bytes], object]) -> list:
        if self.size > self.most // 2:
            self.size, self.young, self.old = 0, {}, self.young
        out = []
        for piece in pieces:
            value = self.young.get(piece)
            if value is None:
                value = self.old.get(piece)
                value = self.young[piece] = make(piece) if value is None else value
                self.size += len(piece) + 150  # about what an entry takes
            out.append(value)
        return out


def plain(text: str) -> str:
    """NFC, then lower case letter by letter (no final sigma), as the "word" tokenizer normalises."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def by_spaces(text: str, most: int = 1 << 16) -> Iterator[str]:
    """Runs of a text of about `most` characters that end with a space or line break, one at least."""
    begin = 0
    while True:
        ends = [x for x in (text.find(" ", begin + most), text.find("\n", begin + most)) if x >= 0] if len(text) - begin > most else []
        if not ends:
            yield text[begin:]
            return
        yield text[begin : min(ends) + 1]
        begin = min(ends) + 1


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(spare)}
