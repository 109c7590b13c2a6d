"""Text vectors without a model: feature hashing with inverse document frequencies, the offline default for embeddings.

A token's MD5 gives a slot (16 bits), a dimension (8 bits) and a sign. A text's vector adds up sign x weight of its tokens and
has length 1. Weights belong to slots, so that what is learnt has SLOTS values however large the corpus is; they are whole
numbers, so that equal texts have equal vectors whatever the order in which they are added up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready
from .text import TOKEN_PATTERN, fold

SLOTS, DIMENSIONS, SCALE, ROWS = 1 << 16, 256, 1024, 1000
"""Slots of document frequencies, components of a vector, parts of a weight's unit, rows embedded at a time."""


TOKEN = re.compile(TOKEN_PATTERN)


@lru_cache(maxsize=1 << 18)
def _spot(token: str) -> tuple[int, int, int]:
    digest = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:4], 16), int(digest[4:6], 16), 1 if digest[6] < "8" else -1


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of ROWS rows: the rows, each token's row and kind, and the kinds' spots. The column holds folded texts, which cross to Python faster than lists."""
    for begin in range(0, batch.num_rows, ROWS):
        part = batch.slice(begin, ROWS)
        lists = [TOKEN.findall(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
        flat = pa.array([t for x in lists for t in x], pa.string()).dictionary_encode()
        spots = np.array([_spot(t) for t in flat.dictionary.to_pylist()], np.int64).reshape(-1, 3)
        yield part, np.repeat(np.arange(part.num_rows), [len(x) for x in lists]), flat.indices.to_numpy(), spots


def _folded(text: str):
    return F.coalesce(fold(text), F.lit(""))


@dataclass(frozen=True)
class HashedVectors:
    weights: np.ndarray
    """A whole number for each slot."""

    @classmethod
    def of(cls, counts: dict[int, int], texts: int) -> HashedVectors:
        """Weights of slots by how many of so many texts have a token there."""
        df = np.zeros(SLOTS)
        df[list(counts)] = list(counts.values())
        return cls(np.floor(SCALE * np.log((texts + 1) / (df + 1))).astype(np.int64))

    def embed(self, rows: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
        """rows with `out`, an array of DIMENSIONS doubles of length 1. Texts that are null or have no tokens of any weight give zeros."""
        weights, names = self.weights, rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, row, kind, spots in _parts(batch, "_folded"):
                    add = spots[:, 2] * weights[spots[:, 0]]
                    sums = np.bincount(row * DIMENSIONS + spots[kind, 1], weights=add[kind], minlength=part.num_rows * DIMENSIONS).reshape(-1, DIMENSIONS)
                    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                    vectors = sums / np.where(norms == 0, 1, norms)
                    lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, DIMENSIONS, dtype=np.int32), vectors.ravel())
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), lists], names=[*names, out])

        schema = rows.withColumn(out, F.array().cast("array<double>")).schema
        return ready(rows).withColumn("_folded", _folded(text)).mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.weights.tolist(),)], "weights array<long>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashedVectors:
        return cls(np.array(spark.read.parquet(path).first()[0], np.int64))


def fit(texts: DataFrame, text: str = "text") -> HashedVectors:
    """Weights by all texts that are not null. Tasks return a row for each slot that they met; SLOTS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, met = 0, np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part, row, kind, spots in _parts(batch, "_folded"):
                n += part.num_rows
                met += np.bincount(np.unique(row * SLOTS + spots[kind, 0]) % SLOTS, minlength=SLOTS)
        slots = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(met[slots], n))], names=["slot", "n"])

    rows = ready(texts).where(F.col(text).isNotNull()).select(_folded(text).alias("_folded"))
    counts = {r.slot: r.n for r in rows.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    return HashedVectors.of({s: n for s, n in counts.items() if s >= 0}, counts.get(-1, 0))
