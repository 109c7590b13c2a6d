"""Exact vector search: a bounded set of query vectors against all rows, in blocks.

Each task multiplies its rows with the query matrix and passes on its own best k for each query, so the shuffle carries
tasks x queries x k rows, whatever the table's size. Query sets beyond a bound are searched in several passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready

QUERY_BYTES, EMIT = 64 << 20, 1 << 18
"""Bytes of query vectors that one pass sends to the executors; scores of a batch."""


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_places(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores; ties by id."""
    if len(rows) <= k:
        return np.arange(len(rows))
    edge = np.partition(rows, len(rows) - k)[len(rows) - k]
    sure, tied = np.flatnonzero(rows > edge), np.flatnonzero(rows == edge)
    return np.concatenate([sure, tied[np.argsort(ids[tied], kind="stable")][: k - len(sure)]])


def _passes(queries: DataFrame, vector: str) -> int:
    """Into how many blocks of QUERY_BYTES the query vectors go."""
    width = queries.select(F.max(F.size(vector)).alias("n"), F.count("*").alias("rows")).first()
    return max(1, -(-(width["rows"] or 0) // max(1, QUERY_BYTES // (8 * max(1, width["n"] or 1)))))


def query_blocks(queries: DataFrame, vector: str, query_key: tuple[str, ...]) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Keys and vectors of all queries, QUERY_BYTES at a time."""
    passes = _passes(queries, vector)
    for p in range(passes):
        mine = queries.where(F.pmod(F.xxhash64(*query_key), F.lit(passes)) == p) if passes > 1 else queries
        rows = mine.where(F.col(vector).isNotNull()).select(*query_key, vector).collect()
        yield [tuple(r[c] for c in query_key) for r in rows], np.array([r[vector] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)


def _blocks(chunks: DataFrame, queries: DataFrame, vector: str, query_key: tuple[str, ...], run: Callable[[DataFrame, np.ndarray], DataFrame]) -> DataFrame:
    """(query key..., and what run gives beside _q) for all blocks of queries; `run` gets the chunks and a block's matrix."""
    out = None
    for keys, matrix in query_blocks(queries, vector, query_key):
        found = run(chunks.select("chunk_id", vector), matrix)
        named = queries.sparkSession.createDataFrame([(n, *key) for n, key in enumerate(keys)], f"_q int, {', '.join(f'{c} {queries.schema[c].dataType.simpleString()}' for c in query_key)}")
        part = found.join(F.broadcast(named), "_q").select(*query_key, *(c for c in found.columns if c != "_q"))
        out = part if out is None else out.unionAll(part)
    return out


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", query_key: tuple[str, ...] = ("qid", "variant_pos")) -> DataFrame:
    """(query key..., chunk_id, score, hit_rank): the k chunks with the largest inner product to nine decimals; ties by chunk_id.

    chunks: chunk_id and the vector; queries: the key and the vector. All vectors have one length. Filters belong below this operator.
    """
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "chunk_id")
    return _blocks(chunks, queries, vector, query_key, lambda rows, matrix: _search(rows, matrix, k).withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k))


def all_scores(chunks: DataFrame, queries: DataFrame, vector: str = "embedding", query_key: tuple[str, ...] = ("qid", "variant_pos")) -> DataFrame:
    """(query key..., chunk_id, score): every inner product, for pools that a filter has narrowed. Nothing is ranked, held or shuffled."""

    def every(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, EMIT // max(1, len(matrix)))
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                for begin in range(0, batch.num_rows if len(matrix) else 0, step):
                    part = batch.slice(begin, step)
                    scores = np.round(matrix @ matrix_of(part.column(1)).T, 9)
                    ids = np.tile(part.column(0).to_numpy(zero_copy_only=False), len(matrix))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(matrix), dtype=np.int32), part.num_rows)), pa.array(ids), pa.array(scores.ravel())], names=["_q", "chunk_id", "score"])

        return ready(rows).mapInArrow(run, "_q int, chunk_id long, score double")

    return _blocks(chunks, queries, vector, query_key, every)


def _search(chunks: DataFrame, matrix: np.ndarray, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(matrix)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows or not len(matrix):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            scores = np.round(matrix @ matrix_of(batch.column(1)).T, 9)
            for q, row in enumerate(scores):
                all_ids, all_rows = np.concatenate([held[q][0], ids]), np.concatenate([held[q][1], row])
                at = best_places(all_rows, all_ids, k)
                held[q] = (all_ids[at], all_rows[at])
        sizes = [len(i) for i, _ in held]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held), dtype=np.int32), sizes)), pa.array(np.concatenate([i for i, _ in held])), pa.array(np.concatenate([s for _, s in held]))], names=["_q", "chunk_id", "score"])

    return ready(chunks).mapInArrow(run, "_q int, chunk_id long, score double")
