"""A vector index in cells that gives the same rows as a whole search.

Rows lie in one folder a cell, with the cell of their nearest centroid; the centroids come from a bounded sample. For a query q
and a row x of a cell with centroid c and radius r, q.x is at most q.c + |q| r. A query first visits the cells with the largest
bounds that hold enough rows together; its k-th score there, then, rules out all cells whose bound is less. A search reads only
the folders of cells that some query visits, and in a cell only its visitors' products are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ready, written
from .vector import best_places, matrix_of, query_blocks

FIT_ROWS, CELL_ROWS, CELLS, ROUNDS = 16_384, 1024, 4096, 10
"""Rows that centroids are fitted on at most, rows a cell aimed at, cells at most, rounds of the fit."""
MARGIN = 1e-8
"""Bounds this close below a k-th score are visited too: scores have nine decimals."""


def fitted(rows: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spread rows; empty cells keep theirs."""
    centroids = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest(rows, centroids)
        sums, sizes = np.zeros_like(centroids), np.bincount(near, minlength=cells)
        np.add.at(sums, near, rows)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centroids**2).sum(axis=1) - 2 * rows[k : k + 1024] @ centroids.T, axis=1) for k in range(0, len(rows), 1024)] or [np.zeros(0, np.int64)])


def write_cells(chunks: DataFrame, root: str, vector: str = "embedding", cells: int | None = None) -> None:
    """Builds the index of chunks (chunk_id, vector) below `root`, a new folder. Null vectors are left out; all have one length."""
    spark = chunks.sparkSession
    rows = chunks.where(F.col(vector).isNotNull()).select("chunk_id", F.col(vector).cast("array<double>").alias("vector"))
    many = rows.count()
    cells = cells or int(min(CELLS, max(1, many // CELL_ROWS)))
    hashed = rows.select("vector", F.xxhash64("chunk_id").alias("h"))
    bound = hashed.select("h").orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]  # hashes alone meet in one task
    sample = hashed.where(F.col("h") <= F.lit(bound).cast("long")).orderBy("h").limit(FIT_ROWS).select("vector").toArrow().column(0)
    centroids = fitted(matrix_of(sample.combine_chunks()), min(cells, len(sample))) if len(sample) else np.zeros((0, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(1))
            near = nearest(x, centroids)
            far = np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int64()), pa.array(far)], names=["chunk_id", "vector", "cell", "far"])

    placed = written(ready(rows).mapInArrow(place, "chunk_id long, vector array<double>, cell long, far double"), "placed")
    placed.drop("far").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/rows")
    named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell long, centroid array<double>")
    sizes = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("rows"))
    named.join(sizes, "cell").coalesce(1).write.parquet(f"{root}/cells")


@dataclass(frozen=True)
class CellSearch:
    hits: DataFrame
    """query key..., chunk_id, score, hit_rank."""
    visits: DataFrame
    """query key..., cells and rows that it visited, all_cells, all_rows."""


def _scored(rows: DataFrame, matrix: np.ndarray, visitors: dict[int, np.ndarray], k: int) -> DataFrame:
    """(_q, chunk_id, score): each task's best k of the cells that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            of, ids, x = batch.column(2).to_numpy(), batch.column(0).to_numpy(), matrix_of(batch.column(1))
            for cell in np.unique(of):
                mine = of == cell
                scores = np.round(matrix[visitors[cell]] @ x[mine].T, 9)
                for q, row in zip(visitors[cell].tolist(), scores, strict=True):
                    before = held.get(q, (np.zeros(0, np.int64), np.zeros(0)))
                    all_ids, all_rows = np.concatenate([before[0], ids[mine]]), np.concatenate([before[1], row])
                    at = best_places(all_rows, all_ids, k)
                    held[q] = (all_ids[at], all_rows[at])
        if held:
            sizes = [len(i) for i, _ in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int32), sizes)), pa.array(np.concatenate([i for i, _ in held.values()])), pa.array(np.concatenate([s for _, s in held.values()]))], names=["_q", "chunk_id", "score"])

    inside = rows.where(F.col("cell").isin(sorted(visitors))) if visitors else rows.where(F.lit(False))
    return ready(inside).select("chunk_id", "vector", "cell").mapInArrow(run, "_q int, chunk_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("hit_rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "chunk_id"))).where(F.col("hit_rank") <= k)


def search_cells(spark: SparkSession, root: str, queries: DataFrame, k: int, vector: str = "embedding", query_key: tuple[str, ...] = ("qid", "variant_pos")) -> CellSearch:
    """The k rows with the largest inner product for each query, as vector_topk has them, and what was visited for it."""
    table = spark.read.parquet(f"{root}/cells").orderBy("cell").collect()  # a row a cell, CELLS at most
    rows = spark.read.schema("chunk_id long, vector array<double>, cell long").parquet(f"{root}/rows") if table else spark.createDataFrame([], "chunk_id long, vector array<double>, cell long")
    names, sizes, radii = np.array([r.cell for r in table], np.int64), np.array([r.rows for r in table], np.int64), np.array([r.radius for r in table])
    centroids = np.array([r.centroid for r in table])
    hits = visits = None
    for keys, matrix in query_blocks(queries, vector, query_key):
        if len(table) and len(matrix):
            bounds = matrix @ centroids.T + np.linalg.norm(matrix, axis=1)[:, None] * radii + MARGIN
            order = np.argsort(-bounds, axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) >= k).argmax(axis=1)  # 0 also where all cells together have fewer than k rows
            enough[sizes.sum() < k] = len(names) - 1
            first = np.zeros(bounds.shape, bool)
            np.put_along_axis(first, order, np.arange(len(names)) <= enough[:, None], axis=1)
            sent = lambda mask: {int(names[c]): np.flatnonzero(mask[:, c]) for c in np.flatnonzero(mask.any(axis=0))}
            begun = written(_ranked(_scored(rows, matrix, sent(first), k), k), "visited")
            least = np.full(len(matrix), -np.inf)
            for r in begun.where(F.col("hit_rank") == k).select("_q", "score").collect():  # a row a query of the block
                least[r["_q"]] = r["score"]
            more = ~first & (bounds >= least[:, None])
            found = _ranked(begun.drop("hit_rank").unionByName(_scored(rows, matrix, sent(more), k)), k) if more.any() else begun
            seen = first | more
            report = [(*key, int(seen[n].sum()), int(sizes[seen[n]].sum()), len(names), int(sizes.sum())) for n, key in enumerate(keys)]
        else:
            found, report = spark.createDataFrame([], "_q int, chunk_id long, score double, hit_rank int"), [(*key, 0, 0, 0, 0) for key in keys]
        kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in query_key)
        named = spark.createDataFrame([(n, *key) for n, key in enumerate(keys)], f"_q int, {kinds}")
        part = found.join(F.broadcast(named), "_q").select(*query_key, "chunk_id", "score", "hit_rank")
        seen_rows = spark.createDataFrame(report, f"{kinds}, cells long, rows long, all_cells long, all_rows long")
        hits, visits = (part, seen_rows) if hits is None else (hits.unionAll(part), visits.unionAll(seen_rows))
    return CellSearch(hits, visits)
