"""Vectorised words: boundaries and hashes of whole batches of texts, in NumPy.

A batch's texts are joined by a space into one byte buffer. Words are maximal runs of bytes outside a separator set. Equal
words of a batch are found by their bytes, and each distinct one is digested once (BLAKE2b, 128 bits, read as two lanes of 64).
Hashes of runs of words join those of halves with a mixing function, so no structure of the text makes them collide.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

U = np.uint64

SPACE = bytes(range(9, 14)) + b" "
"""Separators of plain words: [\\x20\\x09-\\x0D]."""
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
"""Separators of alphanumeric words after lower-casing: all of ASCII but 0-9 and a-z."""


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two runs one after the other."""
    return mix(a ^ (b * U(0x9E3779B97F4A7C15) + U(0xD1342543DE82EF95)))


def distinct(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte spans, and which of them each span is. Spans are not empty, in order, and do not overlap."""
    if not len(starts):
        return [], np.zeros(0, np.int32)
    steps = np.zeros(len(buffer) + 1, np.int8)
    steps[starts] = 1
    steps[ends] -= 1  # a span may begin where another ends
    body = buffer[np.cumsum(steps[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy()


@dataclass
class Words:
    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    """first[d]:first[d + 1] are the words of text d."""
    _lanes: np.ndarray | None = field(default=None, repr=False)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64 of the 128 bits of each word's digest."""
        if self._lanes is None:
            kinds, place = distinct(np.frombuffer(self.buffer, np.uint8), self.starts, self.ends)
            digests = b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in kinds)
            self._lanes = np.ascontiguousarray(np.frombuffer(digests, U).reshape(-1, 2).T)[:, place]
        return self._lanes[lane]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[bytes], separators: bytes = SPACE, lower: bool = True) -> Words:
    """The words of each text. Lower-casing touches A-Z only."""
    buffer = b" ".join(texts)
    if lower:
        buffer = buffer.lower()
    table = np.ones(256, bool)
    table[list(separators)] = False
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = table[np.frombuffer(buffer, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    return Words(buffer, starts, ends, np.searchsorted(starts, at))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` values, by joining runs of doubling length."""
    n, done, length, run, out = len(hashes), 0, 1, hashes, None
    if n < size:
        return np.zeros(0, U)
    while True:
        if size & length:
            many = n - done - length + 1
            out = run if out is None else join(out[:many], run[done : done + many])
            done += length
        if done == size:
            return mix(out + U(size))
        run = join(run[:-length], run[length:])
        length *= 2


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers in the batch) and hashes of all windows of `size` words inside one text."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    starts = np.flatnonzero(left >= size)
    return starts, rolled(hashes, size)[starts]


def utf8(column) -> list[bytes]:
    """The bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
