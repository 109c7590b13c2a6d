"""Token counts by byte-pair merging with a heap and a linked list.

The lowest-rank adjacent pair is popped and merged until none is left; a piece's count is its symbols minus its merges.
No identifiers are emitted. Equal pieces are merged once a worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import free_name, kept, lean, ready, slices
from .pretokens import Batch, Known, by_spaces, byte_letters
from .pretokens import plain as lowered

KEPT_BYTES = 96 << 20
"""What the counts of known pieces may take in a worker."""


class Counter:
    """Counts of one tokenizer file (BPE with word ends over byte letters)."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + suffix] for b in range(256)]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.known = Known(KEPT_BYTES)

    def merged(self, piece: bytes) -> int:
        """Symbols left after all merges in one piece."""
        n = left = len(piece)
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.final[piece[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            rule = ranks.get((ids[i], ids[i + 1]))
            if rule:
                heap.append((rule[0], i, ids[i], ids[i + 1], rule[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                rule = ranks.get((new, ids[k]))
                if rule:
                    heapq.heappush(heap, (rule[0], i, new, ids[k], rule[1]))
            h = before[i]
            if h >= 0:
                rule = ranks.get((ids[h], new))
                if rule:
                    heapq.heappush(heap, (rule[0], h, ids[h], new, rule[1]))
        return left

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def slow(self, text: str) -> int:
        """The library's own count, for texts with special strings, or characters that Unicode versions class differently."""
        return sum(len(self.library.encode(run, add_special_tokens=False).ids) for run in by_spaces(text))

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        odd = np.array(["<|" in x for x in texts], bool)
        plain = ["" if o else lowered(x) for x, o in zip(texts, odd, strict=True)]
        batch = Batch(plain)
        odd |= batch.unsettled()
        if odd.any():
            for k in np.flatnonzero(odd):
                out[k] = self.slow(texts[k])
            plain = ["" if o else x for x, o in zip(plain, odd, strict=True)]
            batch = Batch(plain)
        starts, ends = batch.pieces("word")
        kinds, place = batch.distinct(starts, ends)
        sizes = np.array(self.known.of(kinds, self.merged), np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes[place])]).astype(np.int64)
        first = batch.texts_of(starts)
        return out + sums[first[1:]] - sums[first[:-1]]


def counter(path: str) -> Counter:
    return kept(f"counts {path}", lambda: Counter(path))


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048, chunk_bytes: int = 1 << 20) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Whole texts are counted, without added special tokens; a special string
    inside a text is one token. `tokenizer` is the path of a tokenizer file that every executor can read. Other columns
    pass through; added columns that clash get an underscore. An empty table gives an empty result.
    """
    ready(df)
    names = [free_name(df.columns, x) for x in ("n_bytes", "n_tokens", "over_limit")]
    schema = df.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(0).cast("long"), names[2]: F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, chunk_bytes):
                texts = [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                n = counter(tokenizer).counts(texts)
                sizes = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, sizes, pa.array(n), pa.array(n > limit)], names=[*part.schema.names, *names])

    return df.mapInArrow(lean(run), schema)
