"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products inside cells.

Equal vectors are one class from the start. Each class belongs to the cell of its nearest centroid, and also visits cells (with
a larger number than its own) that a partner could belong to. Two bounds that lose nothing rule cells out. For unit x with
nearest centroid c and a partner y within the threshold's angle t whose nearest centroid is d, x.(c - d) <= |c - d| sin(t). And the angle
between x and d differs from that between y and d by t at most, so it lies within t of the least and the largest angle between d
and its own vectors. The first bound is far too wide in many dimensions, where y seldom departs from x along c - d. So its
share that partners really use is measured: PROBES vectors meet all others, and the largest share among their links across
cells, times WIDER, takes the bound's place, but not less than SPREAD / sqrt(effective dimensions of the sample). With L such
links a random one exceeds their largest share with a chance of 1 / (L + 1), and WIDER times it far more seldom; measured
recall is in the README. Without a link across cells among the probes the SPREAD rule stands alone. Cells are compared block
by block; a block pair returns, for each vector, how many it links with and one neighbour on a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, lean, ready, trim
from .components import components

FIT_ROWS, FIT_VALUES, CELL_ROWS, CELLS = 32_768, 1 << 23, 4096, 8192
"""Rows that the centroids are fitted on at most, and their components; rows a cell aimed at, cells at most."""
PROBES, WIDER, SPREAD = 512, 1.5, 4.0
"""See above."""
BLOCK_BYTES, TILE = 4 << 20, 1024
"""Bytes of a block's vectors, rows multiplied at a time."""


def spherical_kmeans(vectors: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors; starts from evenly spread rows. Empty cells keep their centroid."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(vectors[k : k + TILE] @ centroids.T, axis=1) for k in range(0, len(vectors), TILE)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-12
        centroids[good] = sums[good] / norms[good, None]
    return centroids


def dimensions(vectors: np.ndarray) -> float:
    """Effective dimensions of unit vectors: the participation ratio of their second moments' spectrum."""
    moments = vectors.T @ vectors / max(1, len(vectors))
    return float(np.trace(moments) ** 2 / max((moments**2).sum(), 1e-300))


def _matrix(column, n: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small vectors neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the first row of its component; (a, b) are the links, both ways."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _links(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and of right whose products reach the threshold, a tile at a time."""
    found = [np.nonzero(left[k : k + TILE] @ right.T >= threshold) for k in range(0, len(left), TILE)]
    return np.concatenate([x + k * TILE for k, (x, _) in enumerate(found)]), np.concatenate([y for _, y in found])


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        reps, sizes, side = (group.column(c).to_numpy() for c in ("rep", "size", "side"))
        unit = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float64).reshape(len(reps), -1)
        kind, i, j = (group.column(c)[0].as_py() for c in ("kind", "i", "j"))
        if kind or i != j:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a = b = np.zeros(0, np.int64)
            if len(left) and len(right):
                x, y = _links(unit[left], unit[right], threshold)
                a, b = np.concatenate([left[x], right[y]]), np.concatenate([right[y], left[x]])
        else:
            a, b = _links(unit, unit, threshold)
            a, b = a[a != b], b[a != b]
        links = np.zeros(len(reps), np.int64)
        np.add.at(links, a, sizes[b])
        has = np.flatnonzero(links)
        root = _forest(a, b, len(reps)) if len(has) else has
        out = pa.table({"rep": pa.array(reps[has], pa.int64()), "links": pa.array(links[has], pa.int64()), "root": pa.array(reps[root[has]] if len(has) else [], pa.int64())})
        trim()
        return out

    return run


def near_embeddings(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, seed: int = 1) -> DataFrame:
    """(<key>, n_links, component_id, kept) a row of df.

    Cosines are taken in double precision. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and so do vectors of different lengths with each other. Rows with a null key have a null component, are
    not kept and link with nothing. Rows that share a key are counted as vectors of their own; the component holds the key.
    Equal vectors link. Other columns are ignored. An empty table gives no rows.
    """
    ready(df)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    good = rows.where("sound and id is not null")
    classes = cut(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("width", F.size("vector")), "vectors")
    widths = classes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, many = (widths[0]["width"], widths[0]["count"]) if widths else (0, 0)
    fit_rows = min(FIT_ROWS, FIT_VALUES // max(width, 1))
    sample = classes.where(F.col("width") == width).select("vector", "rep", F.xxhash64("rep", F.lit(seed)).alias("h"))
    # The rows with the smallest hashes; only hashes meet in one task, then at most as many vectors as are wanted.
    bound = sample.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    fit = sample.where(F.col("h") <= F.lit(bound).cast("long")).orderBy("h", "rep").limit(fit_rows).select("vector").toArrow().column(0)
    fit = _unit(_matrix(fit, len(fit))) if len(fit) else np.zeros((0, 1))
    cells = int(min(CELLS, max(1, many // CELL_ROWS), max(1, len(fit) // 4)))
    centroids = spherical_kmeans(fit, cells) if len(fit) else np.zeros((1, 1))
    block_rows = max(TILE, BLOCK_BYTES // (8 * max(1, width)))
    sine, least = float(np.sqrt(max(0.0, 1 - threshold * threshold))), min(1.0, SPREAD / np.sqrt(max(1.0, dimensions(fit))))
    probes = fit[:PROBES] if cells > 1 else fit[:0]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's cell, its cosine to the centroid, and the largest share of the bound that its links to probes use."""
        gaps = np.sqrt(np.maximum(1e-18, 2 - 2 * (centroids @ centroids.T))) * max(sine, 1e-9)
        near_probes = probes @ centroids.T if len(probes) else np.zeros((0, len(centroids)))
        homes = near_probes.argmax(axis=1) if len(probes) else np.zeros(0, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, TILE):
                part = batch.slice(begin, TILE)
                sizes = part.column(part.schema.get_field_index("width")).to_numpy()
                cell, cosine, share, bodies = -sizes.astype(np.int64), np.ones(len(sizes)), np.full(len(sizes), -1.0), [b""] * len(sizes)
                for n in np.unique(sizes):
                    row = np.flatnonzero(sizes == n)
                    unit = _unit(_matrix(part.column(0).take(pa.array(row)), len(row)))
                    for r, x in zip(row, unit, strict=True):
                        bodies[r] = x.tobytes()
                    if n != width:  # a cell for each other length
                        continue
                    near = unit @ centroids.T
                    home = near.argmax(axis=1)
                    cell[row], cosine[row] = home, near.max(axis=1)
                    if len(probes):
                        i, j = np.nonzero(unit @ probes.T >= threshold)
                        i, j = (x[home[i] != homes[j]] for x in (i, j))
                        a, b = home[i], homes[j]
                        margin = np.where(a < b, near[i, a] - near[i, b], near_probes[j, b] - near_probes[j, a])  # of the one that visits
                        np.maximum.at(share, row[i], margin / gaps[a, b])
                names = ("rep", "size")
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cosine), pa.array(share), *(part.column(part.schema.get_field_index(c)) for c in names), pa.array(bodies, pa.binary())], names=["cell", "cosine", "share", *names, "vector"])

    settled = cut(classes.select("vector", "rep", "size", "width").mapInArrow(lean(settle), "cell long, cosine double, share double, rep long, size long, vector binary"), "settled")
    spans = settled.groupBy("cell").agg(F.min("cosine").alias("low"), F.max("cosine").alias("high"), F.max("share").alias("share")).collect()  # a row a cell
    reach = sine * min(1.0, max([least] + [WIDER * r.share for r in spans])) + 1e-9
    inner, outer, turn = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf), float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-7
    for r in spans:
        if r.cell >= 0:
            inner[r.cell], outer[r.cell] = np.arccos(min(1.0, r.high)) - turn, np.arccos(max(-1.0, r.low)) + turn

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its own cell, and in those where a partner may be."""
        gaps = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T)))
        for batch in batches:
            for begin in range(0, batch.num_rows, TILE):
                part = batch.slice(begin, TILE)
                cell = part.column(part.schema.get_field_index("cell")).to_numpy()
                row = np.flatnonzero(cell >= 0) if len(centroids) > 1 else np.zeros(0, np.int64)
                home, a, b = cell[row], np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(row):
                    bodies = part.column(part.schema.get_field_index("vector")).take(pa.array(row)).to_pylist()
                    near = np.frombuffer(b"".join(bodies), np.float64).reshape(len(row), -1) @ centroids.T
                    angle = np.arccos(np.clip(near, -1, 1))
                    margin = near[np.arange(len(row)), home][:, None] - near
                    a, b = np.nonzero((margin <= gaps[home] * reach + 1e-9) & (angle >= inner) & (angle <= outer) & (np.arange(len(centroids)) > home[:, None]))
                taken = part.take(pa.array(np.concatenate([np.arange(len(cell)), row[a]])))
                side = np.concatenate([np.zeros(len(cell)), np.ones(len(a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cell, b])), pa.array(side), *(taken.column(taken.schema.get_field_index(c)) for c in ("rep", "size", "vector"))], names=["cell", "side", "rep", "size", "vector"])

    placed = cut(settled.drop("cosine", "share").mapInArrow(lean(visit), "cell long, side int, rep long, size long, vector binary"), "cells")
    discard(settled)
    counts = placed.groupBy("cell").agg(F.ceil(F.count_if(F.col("side") == 0) / block_rows).cast("int").alias("hb"), F.ceil(F.count_if(F.col("side") == 1) / block_rows).cast("int").alias("vb"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("hb")).otherwise(F.col("vb"))).cast("int")
    # The rows of two blocks meet in one place, on different sides; a block meets itself in (i, i).
    block = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    none = F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.when(F.col("side") == 0, F.transform(upto("hb"), lambda k: block(0, F.least(own, k), F.greatest(own, k), own > k))).otherwise(none)
    across = F.when(F.col("side") == 0, F.transform(upto("vb"), lambda j: block(1, own, j, F.lit(0)))).otherwise(F.transform(upto("hb"), lambda i: block(1, i, own, F.lit(1))))
    dealt = placed.join(counts, "cell").where("hb > 0").select("cell", "rep", "size", "vector", F.explode(F.concat(inside, across)).alias("x")).select("cell", "x.*", "rep", "size", "vector")
    found = dealt.groupBy("cell", "kind", "i", "j").applyInArrow(_compare(threshold), "rep long, links long, root long")
    linked = cut(found, "linked")
    discard(placed)
    return _result(rows, classes, linked, key)


def _result(rows: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("rep != root").select("root", "rep"), "root", "rep")
    labels = classes.select("vector", "rep", "size").join(links, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    labels = labels.select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    ok = rows["sound"] & rows["id"].isNotNull()
    out = rows.join(labels, ok & (rows["vector"] == labels["v"]), "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
