"""Product-quantisation codes of vectors in exact integers.

A vector's integers are cut into equal consecutive parts; each part position has a codebook. A round sends one kd-tree a
codebook to all tasks, finds every part's nearest entry by branch and bound over whole batches, and adds up integers: a task
returns one row a part, entry and position, so what is shuffled follows tasks and dimensions, never rows. Only codebooks and
their sums (entries x dimensions) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut, discard, lean, ready, small

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST, FARTHEST = 1 << 52, (1 << 63) - 1
"""Integers and errors beyond these count as these."""
ROWS, LABELS = 1024, 100_000
"""Rows that a task works on at a time; distinct labels up to which their sums are broadcast."""


class CodeTree:
    """A kd-tree over the entries of one codebook. Distances are exact; of equally near entries the lowest index wins."""

    def __init__(self, entries: np.ndarray, leaf: int = 2) -> None:
        self.entries, self.leaf = entries, leaf
        self.root = self._built(np.arange(len(entries)))

    def _built(self, own: np.ndarray):
        """A leaf's entries, or (axis, largest value on the left, smallest on the right, left, right)."""
        points = self.entries[own]
        spread = points.max(axis=0) - points.min(axis=0) if points.size else np.zeros(1, np.int64)
        axis = int(spread.argmax())
        if len(own) <= self.leaf or spread[axis] == 0:
            return own
        values = points[:, axis]
        middle = np.sort(values)[(len(own) - 1) // 2]
        left = values <= middle if middle < values.max() else values < middle
        return axis, values[left].max(), values[~left].min(), self._built(own[left]), self._built(own[~left])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        best, at = np.full(len(x), -1, x.dtype), np.zeros(len(x), np.int64)  # -1: none seen yet
        self._visit(self.root, x, np.arange(len(x)), best, at)
        return at, best

    def _visit(self, node, x: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if not len(rows):
            return
        if not isinstance(node, tuple):
            for e in node:
                gap = x[rows] - self.entries[e]
                far = (gap * gap).sum(axis=1)
                won = (best[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (e < at[rows]))
                best[rows[won]], at[rows[won]] = far[won], e
            return
        axis, low, high, left, right = node
        value = x[rows, axis]
        onto_left = (value - low <= high - value).astype(bool)
        for near, far, side, gap in ((left, right, onto_left, high - value), (right, left, ~onto_left, value - low)):
            own, gap = rows[side], np.maximum(gap[side], 0)
            self._visit(near, x, own, best, at)
            self._visit(far, x, own[(gap * gap <= best[own]).astype(bool)], best, at)  # an equal bound may hide a lower index


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(4096 x), within +-2^52."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def _exact(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """x in a type in which no distance overflows: 64 bits, or Python's integers if values are that large."""
    width = max(1, books[0].shape[1])
    safe = isqrt((1 << 62) // width) // 2
    return x if max(np.abs(x).max(initial=0), *(np.abs(b).max(initial=0) for b in books)) <= safe else x.astype(object)


def _assigned(ints: np.ndarray, trees: list[CodeTree]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of rows x parts."""
    x = _exact(ints, [t.entries for t in trees])
    width = ints.shape[1] // len(trees)
    found = [t.nearest(x[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for begin in range(0, batch.num_rows, ROWS):
        part = batch.slice(begin, ROWS)
        column = part.column(part.schema.get_field_index("_ints"))
        yield part, np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(part.num_rows, width)


def _integers(df: DataFrame, vector: str, parts: int) -> DataFrame:
    """df's rows with a sound vector as `_ints` (little-endian, padded to whole parts) and their `_width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(vector)
            column = batch.column(at)
            starts, flat = column.offsets.to_numpy(), column.values
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            sound = column.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
            rows = np.flatnonzero(sound)
            ints = quantised(np.nan_to_num(values))
            widths = (starts[1:] - starts[:-1])[rows]
            bodies = [np.pad(ints[starts[r] : starts[r + 1]], (0, -int(w) % parts)).tobytes() for r, w in zip(rows, widths, strict=True)]
            rest = batch.take(pa.array(rows))
            columns = [c for k, c in enumerate(rest.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(widths, pa.int32()), pa.array(bodies, pa.binary())], names=[n for n in batch.schema.names if n != vector] + ["_width", "_ints"])

    schema = df.drop(vector).withColumns({"_width": F.lit(0), "_ints": F.lit(b"")}).schema
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
    return df.mapInArrow(lean(run), schema)


def _sums(rows: DataFrame, trees: list[CodeTree]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (count, sums by position)} of the rows' nearest entries."""
    sent, width = rows.sparkSession.sparkContext.broadcast(trees), sum(t.entries.shape[1] for t in trees)
    each = width // len(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        most = max(len(t.entries) for t in trees)
        n = np.zeros((len(trees), most), np.int64)
        high, low = (np.zeros((len(trees), most, each), np.int64) for _ in range(2))  # a sum is high * 2^32 + low
        for batch in batches:
            for _, ints in _blocks(batch, width):
                codes, _ = _assigned(ints, trees)
                for p in range(len(trees)):
                    n[p] += np.bincount(codes[:, p], minlength=most)
                    for e in np.unique(codes[:, p]):
                        total = ints[codes[:, p] == e, p * each : (p + 1) * each].sum(axis=0)
                        high[p, e] += total >> 32
                        low[p, e] += total & 0xFFFFFFFF
        p, e, i = (x.ravel() for x in np.indices(high.shape))
        used = np.flatnonzero(n[p, e])
        p, e, i = p[used], e[used], i[used]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (p, e, i, n[p, e], high[p, e, i], low[p, e, i])], names=["p", "e", "i", "n", "high", "low"])

    found = rows.select("_ints").mapInArrow(lean(run), "p long, e long, i long, n long, high long, low long")
    found = found.groupBy("p", "e", "i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("p", "e", "i").collect()  # entries x dimensions at most
    sent.destroy()
    out: dict = {}
    for r in found:
        out.setdefault((r.p, r.e), (r.n, []))[1].append((r.high << 32) + r.low)
    return out


def codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "_key") -> list[np.ndarray]:
    """The codebook of each part position after all rounds: rows start as the parts of the smallest keys; unused entries stay."""
    first = rows.where(F.col(key).isNotNull()).orderBy(key, "_ints").limit(entries).select("_ints").collect()
    start = np.frombuffer(b"".join(bytes(r[0]) for r in first), np.int64).reshape(len(first), width)
    each = width // parts
    books = [start[:, p * each : (p + 1) * each].copy() for p in range(parts)]
    for _ in range(rounds if len(first) else 0):
        for (p, e), (n, sums) in _sums(rows, [CodeTree(_exact(b, books)) for b in books]).items():
            books[p][e] = [s // n for s in sums]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(<key>, code, error, label_error, codebooks_sha256) of each row with a sound vector.

    Vectors that are null, or hold null or non-finite components, are dropped. The codebooks' length is the most frequent one
    (the smallest of equally frequent ones); sound vectors of another length get a null code and error and no say in the
    codebooks. Lengths that `parts` does not divide are filled up with zeros. Rows that share a key are vectors of their own;
    rows with a null key are coded, but start no entry. With fewer than `entries` rows codebooks are as short. Integers count
    within +-2^52, errors up to 2^63 - 1. label_error adds up errors over equal labels, null labels together. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    spark = ready(df)
    rows = cut(_integers(df.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_vector")), "_vector", parts), "integers")
    widths = rows.groupBy("_width").count().orderBy(F.desc("count"), "_width").limit(1).collect()
    width = widths[0]["_width"] if widths else 0
    fitting, padded = rows.where(F.col("_width") == width), -(-width // parts) * parts
    books = codebooks(fitting, padded, parts, entries, rounds)
    sent = spark.sparkContext.broadcast([CodeTree(_exact(b, books)) for b in books])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            for part, ints in _blocks(batch, padded):
                codes, errors = _assigned(ints, trees) if len(trees[0].entries) else (np.zeros((len(ints), parts), np.int64), np.zeros((len(ints), parts), np.int64))
                text = codes.astype(np.uint8).tobytes().hex()
                error = [min(int(x), FARTHEST) for x in errors.astype(object).sum(axis=1)] if errors.dtype == object else errors.sum(axis=1)
                names = [n for n in part.schema.names if n != "_ints"]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    schema = fitting.drop("_ints").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    coded = cut(fitting.mapInArrow(lean(code), StructType([StructField(f.name, f.dataType, True) for f in schema])).drop("_width"), "codes")
    other = rows.where(F.col("_width") != width).select("_key", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    every = coded.unionByName(other) if not other.isEmpty() else coded
    sums = every.groupBy(F.col("_label").alias("_l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(FARTHEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = every.join(small(sums, LABELS), F.col("_label").eqNullSafe(F.col("_l")))
    if every is coded:
        discard(rows)
    return out.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
