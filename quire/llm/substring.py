"""Substring deduplication with fixed-block anchors.

A window is `window` consecutive words of one document. A word goes if a window that covers it also starts anywhere else.

Any window of 2b - 1 words holds one whole block of every document's grid of non-overlapping b-word blocks. So if a window
occurs twice, a block inside one occurrence equals a rolling b-word window inside the other. Round one indexes all grid
blocks and probes them with every rolling window. Round two extends the hits: only windows that contain a hit can repeat;
their hashes are compared, and the union of the repeated ones is the set of maximal exact repeats.

Texts live in chunks of about `chunk_bytes` (one Arrow stream each). A chunk sends each distinct hash once to the bucket
that owns it, and gets a bit back, so a passage with a million copies costs one value a chunk: no group of rows grows with
the number of copies, and nothing is collected or broadcast. Round one is a filter, on 32 bits of a hash within a bucket. Round
two compares 96 bits, which come from digests of the words: among w candidate windows w^2 / 2^97 false pairs are expected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, free_name, lean, ready, release, slices, trim

_CHUNK = "chunk long, n_words long, body binary"
_ASK = "bucket int, chunk long, step int, asked binary, marks binary"
_TELL = "chunk long, bucket int, step int, marks binary"


def _pack(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _words(table, text: str) -> W.Words:
    return W.words_of(W.utf8(table.column(text)), lower=False)


_WIDE = np.dtype([("high", np.uint64), ("low", np.uint32)])
"""96 bits of a window's hash."""


def _wide(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = np.empty(len(high), _WIDE)
    out["high"], out["low"] = high, low
    return out


def _unique(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the place of each value among them, and how often each occurs; of plain or of wide hashes."""
    if hashes.dtype != _WIDE:
        return np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.lexsort((hashes["low"], hashes["high"]))
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered["high"][1:] != ordered["high"][:-1]) | (ordered["low"][1:] != ordered["low"][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, np.diff(np.append(np.flatnonzero(new), len(order)))


def _sets(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ordered by bucket and value, whether each occurs more than once, each hash's place among them, and the buckets' borders."""
    # The order is by (bucket, value): a bucket is a range of the top bits, so it is the order of the values.
    kinds, place, counts = _unique(hashes)
    return kinds, counts > 1, place, np.searchsorted(kinds["high"] if kinds.dtype == _WIDE else kinds, _borders(buckets))


def _borders(buckets: int) -> np.ndarray:
    return np.array([*((i << 64) // buckets for i in range(buckets)), (1 << 64) - 1], np.uint64)


def _short(kinds: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """The 32 leading bits of the values within their bucket's range."""
    return (((kinds - np.uint64((bucket << 64) // buckets)) >> np.uint64(8)) // np.uint64(((1 << 56) // buckets >> 32) + 1)).astype(np.uint32)


def _bits(*flags: np.ndarray) -> bytes:
    return np.packbits(np.concatenate(flags)).tobytes()


def _flags(bits: bytes, n: int, rows: int = 1) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n * rows).astype(bool).reshape(rows, n)


class _Chunk:
    """The words of a chunk and what both rounds need of them."""

    def __init__(self, table, text: str, window: int, buckets: int) -> None:
        self.words, self.window, self.block, self.buckets = _words(table, text), window, (window + 1) // 2, buckets
        self.first = self.words.first
        self.hashes = self.words.hashes()
        self.at, rolling = W.windows(self.hashes, self.first, self.block)
        self.kinds, self.twice, self.place, self.borders = _sets(rolling, buckets)

    def blocks(self) -> np.ndarray:
        """Which distinct rolling hashes are those of grid blocks."""
        begin = np.repeat(self.first[:-1], np.diff(self.first))[self.at]
        out = np.zeros(len(self.kinds), bool)
        out[self.place[(self.at - begin) % self.block == 0]] = True
        return out

    def candidates(self, hit_kinds: np.ndarray) -> tuple:
        """Windows with a hit block inside: their starts, and their wide hashes' sets as of _sets."""
        hit = np.zeros(len(self.hashes), np.int32)
        hit[self.at[hit_kinds[self.place]]] = 1
        sums = np.zeros(len(self.hashes) + 1, np.int32)
        np.cumsum(hit, out=sums[1:])
        starts, high = W.windows(self.hashes, self.first, self.window)
        near = sums[starts + self.window - self.block + 1] > sums[starts]
        high, low = high[near], W.windows(self.words.hashes(1), self.first, self.window)[1][near]
        return starts[near], *_sets(_wide(high, (low >> np.uint64(32)).astype(np.uint32)), self.buckets)


def _ask(chunk: int, step: int, kinds: np.ndarray, borders: np.ndarray, buckets: int, *flags: np.ndarray) -> Iterator[dict]:
    for b in np.flatnonzero(np.diff(borders)):
        part = slice(borders[b], borders[b + 1])
        asked = _short(kinds[part], int(b), buckets) if step == 1 else kinds[part]
        yield {"bucket": int(b), "chunk": chunk, "step": step, "asked": asked.tobytes(), "marks": _bits(*(f[part] for f in flags))}


def _told(rows, step: int, borders: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for r in rows:
        if r["step"] == step:
            begin, end = borders[r["bucket"]], borders[r["bucket"] + 1]
            out[begin:end] = _flags(r["marks"], end - begin)[0]
    return out


def _answer(group: pa.Table) -> pa.Table:
    """For one bucket: which of the values that each chunk asks for occur in more than one place (round one: and are a grid block)."""
    rows = group.to_pylist()
    kind = np.uint32 if rows[0]["step"] == 1 else _WIDE
    asked = [np.frombuffer(r["asked"], kind) for r in rows]
    values, place, counts = _unique(np.concatenate(asked))
    marks = [_flags(r["marks"], len(a), 2 if r["step"] == 1 else 1) for r, a in zip(rows, asked, strict=True)]
    twice = counts > 1
    twice[place[np.concatenate([m[0] for m in marks])]] = True
    if rows[0]["step"] == 1:
        block = np.zeros(len(values), bool)
        block[place[np.concatenate([m[1] for m in marks])]] = True
        twice &= block
    said = np.split(twice[place], np.cumsum([len(a) for a in asked])[:-1])
    out = [{"chunk": r["chunk"], "bucket": r["bucket"], "step": r["step"], "marks": _bits(x)} for r, x in zip(rows, said, strict=True) if x.any()]
    return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("step", pa.int32()), ("marks", pa.binary())]))


_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("step", pa.int32()), ("asked", pa.binary()), ("marks", pa.binary())])


def remove_repeats(df: DataFrame, text: str = "text", window: int = 35, kept: str = "kept_text", chunk_bytes: int = 1 << 20, bucket_words: int = 1 << 20) -> DataFrame:
    """Each row of df with `kept` (its words that no repeated window covers, joined by one space), n_words and n_removed.

    Words are runs outside [\\x20\\x09-\\x0D], unchanged. A null text has no words: `kept` is null, both counts 0. Texts
    without words keep "". Texts shorter than `window` lose nothing; equal rows are separate documents, so each repeats the
    other. An empty table gives an empty result. Other columns pass through; if one is named like an added column, the added
    one gets an underscore.
    """
    spark = ready(df)
    names = [free_name(df.columns, x) for x in (kept, "n_words", "n_removed")]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def body() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches()[0]
            counts = int(_words(batch, text).counts().sum())
            number += 1
            return pa.RecordBatch.from_pydict({"chunk": [number], "n_words": [counts], "body": [_pack(batch)]}, schema=pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("body", pa.binary())]))

        for batch in batches:
            for part in slices(batch, text, chunk_bytes):
                held.append(part)
                size += part.get_total_buffer_size() if part.num_rows == batch.num_rows else sum(len(x) for x in W.utf8(part.column(text)))
                if size >= chunk_bytes:
                    yield body()
                    held, size = [], 0
        if held:
            yield body()

    store = cut(df.mapInArrow(lean(chunks), _CHUNK), "chunks", "uncompressed")
    buckets = max(128, (store.agg(F.sum("n_words")).first()[0] or 0) // bucket_words)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                c = _Chunk(_unpack(packed.as_buffer()), text, window, buckets)
                yield pa.RecordBatch.from_pylist(list(_ask(number, 1, c.kinds, c.borders, buckets, c.twice, c.blocks())), schema=_ASK_ARROW)

    def second(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows or not told.num_rows:
            return _ASK_ARROW.empty_table()
        trim()
        c = _Chunk(_unpack(chunk.column("body")[0].as_buffer()), text, window, buckets)
        _, kinds, twice, _, borders = c.candidates(_told(told.to_pylist(), 1, c.borders, len(c.kinds)))
        return pa.Table.from_pylist(list(_ask(chunk.column("chunk")[0].as_py(), 2, kinds, borders, buckets, twice)), schema=_ASK_ARROW)

    def last(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return out_arrow.empty_table()
        trim()
        table, rows = _unpack(chunk.column("body")[0].as_buffer()), told.to_pylist()
        gone = None
        if rows:
            c = _Chunk(table, text, window, buckets)
            words = c.words
            starts, kinds, _, place, borders = c.candidates(_told(rows, 1, c.borders, len(c.kinds)))
            at = starts[_told(rows, 2, borders, len(kinds))[place]] if len(starts) else starts
            steps = np.zeros(len(c.hashes) + 1, np.int32)
            steps[at] += 1
            np.subtract.at(steps, at + window, 1)
            gone = np.cumsum(steps[:-1]) > 0
        else:
            words = _words(table, text)
        kept_texts, removed = [], []
        for d, null in enumerate(table.column(text).is_null().to_pylist()):
            a, b = int(words.first[d]), int(words.first[d + 1])
            lost = int(gone[a:b].sum()) if gone is not None else 0
            removed.append(lost)
            if null:
                kept_texts.append(None)
            elif a == b or lost == b - a:
                kept_texts.append(b"")
            elif not lost:
                kept_texts.append(b" ".join(words.buffer[words.starts[a] : words.ends[b - 1]].split()))
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]])))
                runs = [words.buffer[words.starts[a + i] : words.ends[a + j - 1]].split() for i, j in zip(edges[::2], edges[1::2], strict=True)]
                kept_texts.append(b" ".join(w for r in runs for w in r))
        added = [pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64())]
        return pa.Table.from_arrays([*table.columns, *added], names=[*table.column_names, *names]).cast(out_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    out_schema = StructType([*df.schema.fields, StructField(names[0], StringType()), StructField(names[1], LongType()), StructField(names[2], LongType())])
    out_arrow = to_arrow_schema(out_schema)
    tells = [store.mapInArrow(lean(first), _ASK).groupBy("bucket").applyInArrow(_answer, _TELL)]
    tells[0] = cut(tells[0], "hits")
    release(spark)
    by_chunk = store.groupBy("chunk")
    tells.append(cut(by_chunk.cogroup(tells[0].groupBy("chunk")).applyInArrow(second, _ASK).groupBy("bucket").applyInArrow(_answer, _TELL), "repeats"))
    release(spark)
    return store.groupBy("chunk").cogroup(tells[0].unionByName(tells[1]).groupBy("chunk")).applyInArrow(last, out_schema)


def digest(kept: str):
    """Hex SHA-256 of a kept text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(kept), F.lit("")).cast("binary"), 256)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
