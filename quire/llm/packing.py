"""Packing documents into fixed windows by best-fit decreasing.

Each document's ids (with an end id) are cut into full windows and a remainder. Remainders, largest first, enter the open
window with the tightest remaining capacity, found in a segment tree indexed by that capacity. Windows that stay emptier
than the slack are taken apart: their pieces are cut to fill the gaps of others, so that padding stays small whatever the
sizes. Each input partition packs by itself, a bounded number of remainders at a time; only the pieces of a partition's last
window, if that is not full, are packed again across partitions, so that padding does not follow their number.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, kept, lean, ready, slices
from .pretokens import Batch, Known, byte_letters

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = 65_536
"""Pieces of last windows that one task packs."""
KEPT_BYTES = 96 << 20
"""What the ids of known pieces may take in a worker."""


class Encoder:
    """Ids of one byte-level BPE tokenizer file, equal to those of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = Known(KEPT_BYTES)

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _ids(self, piece: bytes) -> bytes:
        return array("I", self.bpe._core_bpe.encode_single_piece(piece)).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        odd = np.array(["<|" in x for x in texts], bool)
        batch = Batch(texts)
        odd |= batch.unsettled()
        if odd.any():
            batch = Batch(["" if o else x for x, o in zip(texts, odd, strict=True)])
        starts, ends = batch.pieces("byte")
        kinds, place = batch.distinct(starts, ends)
        parts = self.known.of(kinds, self._ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, begin = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(sizes) - sizes
        lengths = sizes[place]
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids = flat[np.repeat(begin[place] - edges[:-1], lengths) + np.arange(edges[-1])]
        first = edges[batch.texts_of(starts)]
        if odd.any():
            own = {k: np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32) for k in np.flatnonzero(odd)}
            rows = [own.get(k, ids[first[k] : first[k + 1]]) for k in range(len(texts))]
            ids, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, first


def encoder(path: str) -> Encoder:
    return kept(f"ids {path}", lambda: Encoder(path))


class CapacityTree:
    """A segment tree over remaining capacities 0..window; each leaf holds the open windows with that much room."""

    def __init__(self, window: int) -> None:
        self.size = 1 << (window + 1).bit_length()
        self.any = [False] * (2 * self.size)
        self.leaves: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, name: int) -> None:
        self.leaves[room].append(name)
        k = room + self.size
        while k and not self.any[k]:
            self.any[k] = True
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, name) of the tightest window with room >= need."""
        k = need + self.size
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.size
        name = self.leaves[room].pop()
        while k and not (self.leaves[room] if k >= self.size else self.any[2 * k] or self.any[2 * k + 1]):
            self.any[k] = False
            k >>= 1
        return room, name


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Bins of item numbers; no bin's sizes exceed the window. Largest items first; ties by number."""
    tree, bins = CapacityTree(window), []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[item])
        if found is None:
            found = (window, len(bins))
            bins.append([])
        room, name = found
        bins[name].append(item)
        tree.put(room - sizes[item], name)
    return bins


def _fill(bins: list[list[tuple]], window: int, slack: int) -> list[list[tuple]]:
    """Cuts pieces (doc, start, length) of the emptiest bins into the gaps of others that are larger than the slack."""
    bins = sorted(bins, key=lambda b: -sum(p[2] for p in b))
    room = [window - sum(p[2] for p in b) for b in bins]
    to, end = 0, len(bins) - 1
    while to < end:
        if room[to] <= slack:
            to += 1
            continue
        doc, start, length = bins[end].pop()
        moved = min(room[to], length)
        bins[to].append((doc, start, moved))
        room[to] -= moved
        room[end] += length
        if moved < length:
            bins[end].append((doc, start + moved, length - moved))
            room[end] -= length - moved
        if not bins[end]:
            end -= 1
    return [b for b in bins if b]


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, most: int = 4096, slack: float = 0.03, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Pieces of documents in sequences of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty document: one piece with the end id alone. Rows with a null or repeated key are documents of
    their own; their pieces carry the key as it is. Other columns are ignored. An empty table gives no rows. At most `most`
    remainders are held at a time; gaps of more than `slack` of a window are filled by cutting, except in the last windows.
    """
    ready(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # doc_id, ids of the remainder, its start, all tokens
        rows: list[tuple] = []

        def emit(names: list, closing: bool) -> list[tuple]:
            """Packs what is held; returns the pieces of the emptiest sequence, for the next time; when closing, only if it is emptier than the slack."""
            nonlocal sequence
            bins = [[(i, 0, len(names[i][1])) for i in b] for b in best_fit([len(x[1]) for x in names], window)]
            bins = _fill(bins, window, int(slack * window))
            gap = window - sum(p[2] for p in bins[-1])
            left = bins.pop() if (gap > slack * window if closing else len(bins) > 1) else []
            for b in bins:
                offset = 0
                for i, start, length in b:
                    doc, ids, base, total = names[i]
                    rows.append((doc, base + start, length, zlib.crc32(ids[start : start + length].tobytes()), total, sequence, offset))
                    offset += length
                sequence += 1
            return [(names[i][0], names[i][1][start : start + length], names[i][2] + start, names[i][3]) for i, start, length in left]

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                ids, first = encoder(tokenizer).encode([x or "" for x in part.column(1).to_pylist()])
                for k, doc in enumerate(part.column(0).to_pylist()):
                    mine = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    full = len(mine) // window * window
                    for start in range(0, full, window):
                        rows.append((doc, start, window, zlib.crc32(mine[start : start + window].tobytes()), len(mine), sequence, 0))
                        sequence += 1
                    if full < len(mine):
                        held.append((doc, mine[full:], full, len(mine)))
                    if len(held) >= most:
                        held = emit(held, False)
                if rows:
                    yield out()
        if held:
            rows.extend((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, -1 - sequence - k, 0) for k, (doc, ids, start, total) in enumerate(emit(held, True)))
            yield out()

    pieces = cut(df.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(lean(run), _SCHEMA), "pieces")
    last = pieces.where("sequence_id < 0")
    groups = max(1, -(-last.count() // GROUP))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("sequence_id")
        rows, sequence, offset = table.column("length").to_pylist(), np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
        group = table.column("_group")[0].as_py()
        for n, names in enumerate(best_fit(rows, window)):
            at = 0
            for k in names:
                sequence[k], offset[k] = -1 - (group << 33 | n), at
                at += rows[k]
        return table.drop_columns(["_group", "sequence_id", "offset"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    spread = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int")
    return pieces.where("sequence_id >= 0").unionByName(last.withColumn("_group", spread).groupBy("_group").applyInArrow(place, _SCHEMA))
