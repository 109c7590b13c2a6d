"""Connected components: links are contracted inside each partition, then across partitions by star rounds on DataFrames.

A task holds at most `EDGES` links at a time and replaces them by stars; when that few are left in all, one task finishes.
Before that, rounds of alternating large and small stars run: the smallest neighbour of a node comes from a combinable
aggregate that is joined back, so a hub's edges never meet in one task unsplit. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, lean, ready

EDGES = 1 << 20
"""Links that a task contracts at a time: 16 bytes each, about 100 MB while it works."""


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links a - b, and the smallest node that each of them reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), place[: len(a)], place[len(a) :]
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _contracted(edges: DataFrame, most: int, tops: bool) -> DataFrame:
    """(b, a) for each node b of some `most` links of a partition and the smallest node a that it reaches by them; with or without a itself."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        nodes, tops_of = smallest_reached(*(links.column(c).to_numpy() for c in ("a", "b")))
        out = slice(None) if tops else nodes != tops_of
        return pa.RecordBatch.from_arrays([pa.array(nodes[out], pa.int64()), pa.array(tops_of[out], pa.int64())], names=["b", "a"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if held and rows + batch.num_rows > most:
                yield stars(held)
                held, rows = [], 0
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield stars(held)

    return edges.mapInArrow(lean(contract), "b long, a long")


def _is_forest(edges: DataFrame) -> bool:
    """Whether each node b has one edge, to a node that is no b itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("low")), F.struct(F.col("b").alias("node"), F.lit(1).alias("low")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("low").alias("low"), F.count("*").alias("all"))
    return not nodes.where("low > 1 or (low = 1 and all > 1)").limit(1).count()


def _star_round(edges: DataFrame) -> DataFrame:
    """Large stars, then small stars, of edges with a < b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
    least = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b")
    return small.where("a < b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = EDGES) -> DataFrame:
    """(node, component) for every node of `links` that has a link to another: the smallest node that it reaches.

    Links may repeat, come in either direction, or join a node to itself (that says nothing). Rows with a null end are ignored.
    """
    ready(links)
    edges = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b"), "links")
    while (parts := -(-edges.count() // most)) > 1:
        if _is_forest(edges):
            tops = edges.select(F.col("a").alias("node")).distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(tops.select("node", F.col("node").alias("component")))
        before, edges = edges, cut(_star_round(_contracted(edges.coalesce(parts), most, tops=False)), "links")
        discard(before)
    return _contracted(edges.coalesce(1), most, tops=True).select(F.col("b").alias("node"), F.col("a").alias("component"))
