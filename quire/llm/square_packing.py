"""Packing whole documents into as few fixed windows as possible by the sum-of-squares rule.

With N(g) open windows of remaining room g, each piece goes, among the windows that it fits, to one whose room leaves the sum
of N(g)^2 smallest (windows that it fills do not count); only a piece that fits nowhere opens a window. Pieces come largest
first. Nothing is cut but documents longer than a window. Texts are read once; then only piece sizes are shuffled, in groups
of about GROUP pieces by a hash of the piece's own number, so neither a hot key nor the number of partitions matters.
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
from .pretokens import Batch, Known, by_spaces, byte_letters, plain

GROUP = 65_536
"""Pieces that one task packs; a few MB, and a few seconds."""
END = b"\xff"
KEPT_BYTES = 96 << 20
"""What the ids of known pieces may take in a worker."""


class WordIds:
    """Ids of a tokenizer file with word ends (BPE over byte letters), equal to the tokenizers library's.

    Each distinct word piece is merged once, by tiktoken's routine: a byte that no UTF-8 text has stands for the end of the
    word. Its pair with the last byte is of lower rank than all merges, so that merging begins with the file's end symbols.
    """

    def __init__(self, path: str) -> None:
        self.path, self.known = path, Known(KEPT_BYTES)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, back = spec["model"]["end_of_word_suffix"], {c: b for b, c in byte_letters().items()}
        special, ranks = {x["content"] for x in spec["added_tokens"]}, {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                body = token.removesuffix(suffix)
                ranks[bytes(back[c] for c in body) + (END if body != token else b"")] = rank
        self.merge = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _ids(self, piece: bytes) -> bytes:
        return array("I", self.merge(piece + END)).tobytes()

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts with unsettled characters or special strings go to the library in runs that end at spaces."""
        odd = np.array(["<|" in x for x in texts], bool)
        lowered = ["" if o else plain(x) for x, o in zip(texts, odd, strict=True)]
        batch = Batch(lowered)
        odd |= batch.unsettled()
        if odd.any():
            batch = Batch(["" if o else x for x, o in zip(lowered, odd, strict=True)])
        starts, ends = batch.pieces("word")
        kinds, place = batch.distinct(starts, ends)
        parts = self.known.of(kinds, self._ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, begin, lengths = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(sizes) - sizes, sizes[place]
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids = flat[np.repeat(begin[place] - edges[:-1], lengths) + np.arange(edges[-1])]
        first = edges[batch.texts_of(starts)]
        out = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        for t in np.flatnonzero(odd):
            out[t] = np.concatenate([np.array(self.library.encode(run, add_special_tokens=False).ids, np.uint32) for run in by_spaces(texts[t])])
        return out


def word_ids(path: str) -> WordIds:
    return kept(f"word ids {path}", lambda: WordIds(path))


def sum_of_squares(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window's number, offset in it) of each size, placed largest first, ties by position."""
    room = np.zeros(window + 1, np.int64)  # N(g); N(0) stays 0
    named: list[list[int]] = [[] for _ in range(window + 1)]
    home, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        gaps = np.flatnonzero(room[size:])  # what is left in each kind of window that has room
        if len(gaps):
            change = np.where(gaps > 0, 2 * room[gaps] + 2, 1) - 2 * room[gaps + size]  # of the sum of squares
            left = int(gaps[change.argmin()])
            name = named[left + size].pop()
            room[left + size] -= 1
        else:
            left, name, opened = window - size, opened, opened + 1
        home[k], offset[k] = name, window - left - size
        named[left].append(name)
        room[left] += left > 0
    return home, offset


def pack_whole(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 4096, end_id: int = 1, group: int = GROUP, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Pieces of documents in sequences of at most `window` ids: <key>, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with `end_id`; only documents of more than `window` ids are cut, after every `window` ids. A null text
    is an empty document: one piece with the end id alone. Rows with a null or repeated key are documents of their own, whose
    pieces carry the key as it is. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    ready(df)
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = docs.select("_key").withColumns({"number": F.lit(0).cast("long"), "piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long")}).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "_text", chunk_bytes):
                row, start, length, crc = [], [], [], []
                for k, ids in enumerate(word_ids(tokenizer).of([x or "" for x in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for begin in range(0, len(ids), window):
                        mine = ids[begin : begin + window]
                        row.append(k)
                        start.append(begin)
                        length.append(len(mine))
                        crc.append(zlib.crc32(mine.tobytes()))
                starts = np.array(start, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array(number + np.arange(len(row))), pa.array((starts // window).astype(np.int32)), pa.array(starts), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["_key", "number", "piece", "start", "length", "ids_crc32"])
                number += len(row)

    pieces = cut(docs.mapInArrow(lean(encode), schema), "pieces")
    full, rest = F.col("length") == window, pieces.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        home, offset = sum_of_squares(table.column("length").to_numpy(), window)
        sequence = ((table.column("_group").to_numpy().astype(np.int64) << 33 | home) << 1) | 1
        return table.drop_columns(["_group", "number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    out = pieces.select(*(c for c in pieces.columns if c != "number"), (F.col("number") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = rest.withColumn("_group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")).groupBy("_group").applyInArrow(place, out.schema)
    return out.where(full).unionByName(placed).withColumnRenamed("_key", key)
