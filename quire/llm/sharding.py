"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts are one indivisible group. Groups, largest first, enter the bin with the tightest remaining capacity
that still holds them, found in a balanced tree; the fewest bins of a fixed capacity result, or, for a fixed number of
bins, the smallest capacity that does. Only a bounded number of items reaches the driver: groups larger than a small share
of a bin (there can be few), and for all others the bundles into which their hashes fall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, ready

BUNDLES = 8192
"""Bundles of small groups; with a capacity, SHARE a shard if these are more. A large group has more than its share of all bytes, so there are fewer of them than bundles."""
SHARE = 64
"""Bundles that a shard of fixed capacity is filled with at least, on average."""


class Rooms:
    """Open bins ordered by (remaining capacity, name) in an AVL tree. A node is [key, left, right, height]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def put(self, room: int, name: int) -> None:
        self.root = _insert(self.root, (room, name))

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the tightest room >= need."""
        node, found = self.root, None
        while node:
            if node[0][0] >= need:
                node, found = node[1], node[0]
            else:
                node = node[2]
        if found is not None:
            self.root = _remove(self.root, found)
        return found


def _height(node: list | None) -> int:
    return node[3] if node else 0


def _turn(node: list, side: int) -> list:
    """Rotates the child on `side` (1 left, 2 right) above its parent."""
    child = node[side]
    node[side], child[3 - side] = child[3 - side], node
    for x in (node, child):
        x[3] = 1 + max(_height(x[1]), _height(x[2]))
    return child


def _level(node: list) -> list:
    node[3] = 1 + max(_height(node[1]), _height(node[2]))
    lean = _height(node[1]) - _height(node[2])
    if abs(lean) < 2:
        return node
    side = 1 if lean > 0 else 2
    if _height(node[side][3 - side]) > _height(node[side][side]):
        node[side] = _turn(node[side], 3 - side)
    return _turn(node, side)


def _insert(node: list | None, key: tuple[int, int]) -> list:
    if not node:
        return [key, None, None, 1]
    side = 1 if key < node[0] else 2
    node[side] = _insert(node[side], key)
    return _level(node)


def _remove(node: list, key: tuple[int, int]) -> list | None:
    if key != node[0]:
        side = 1 if key < node[0] else 2
        node[side] = _remove(node[side], key)
        return _level(node)
    if not node[1] or not node[2]:
        return node[1] or node[2]
    after = node[2]
    while after[1]:
        after = after[1]
    node[0], node[2] = after[0], _remove(node[2], after[0])
    return _level(node)


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Each item's bin; None once more than `most` bins are needed. An item above the capacity gets a bin of its own."""
    rooms, bins, out = Rooms(), 0, [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = rooms.take(sizes[item])
        if found is None:
            if bins == most:
                return None
            found = (max(capacity, sizes[item]), bins)
            bins += 1
        room, out[item] = found
        rooms.put(room - sizes[item], out[item])
    return out


def fewest_capacity(sizes: list[int], bins: int) -> list[int]:
    """The packing into at most `bins` bins with the least capacity that bisection finds (to 1/20000 of the lower bound)."""
    # An oversized item fills a bin alone; the others are levelled among themselves.
    rest, left = sorted(sizes, reverse=True), bins
    while left > 1 and rest and rest[0] * left > sum(rest):
        rest, left = rest[1:], left - 1
    low = max(-(-sum(rest) // left), rest[0] if rest else 1, 1)
    best, step = None, max(1, low // 20_000)
    high = low
    while best is None:
        best = best_fit_decreasing(sizes, high, bins)
        if best is None:
            low, high = high + 1, high + max(step, high // 200)
    while high - low > step:
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def shard(df: DataFrame, shards: int | None = 40, capacity: int | None = None, key: str = "doc_id", text: str = "text", overhead: int = 16, slot_rows: int = 512) -> DataFrame:
    """df with size, shard and slot; give the number of shards, or a capacity in bytes.

    size: UTF-8 bytes of the text (null: none) plus the overhead. Shards are numbered from 0; with a capacity there are as many
    as needed (bundles are at most a share of it, and only a group above it makes a fuller shard). slot: the row's place in
    its shard, gapless from 0, ordered within hashed parts by key and text; equal rows take consecutive slots. Null texts
    are one group, and so are empty ones. Null keys come first. Added columns that clash get an underscore. An empty table
    gives an empty result.
    """
    spark = ready(df)
    size, place, slot = (free_name(df.columns, x) for x in ("size", "shard", "slot"))
    hidden = [free_name([*df.columns, size, place, slot], x) for x in ("_item", "_group", "_part", "_before", "_lone", "_crc")]
    item, group, part, before, alone, crc = hidden
    sized = df.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).withColumn(group, F.xxhash64(text)).withColumn(crc, F.crc32(text))
    groups = sized.groupBy(group).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    whole, rows = total["bytes"] or 0, total["rows"] or 0
    bundles = BUNDLES if capacity is None else max(BUNDLES, SHARE * -(-whole // capacity))
    unit = max(1, whole // bundles)
    large = groups.where(F.col("bytes") > unit).select(F.col(group).alias("g"), "bytes").orderBy(F.desc("bytes"), "g").collect()
    names = [r["g"] for r in large]
    lone = spark.createDataFrame([(r["g"], k) for k, r in enumerate(large)], f"`{group}` long, `{alone}` int")
    bundle = (F.pmod(group, F.lit(bundles)) + len(names)).cast("int")
    numbered = groups.join(F.broadcast(lone), group, "left").withColumn(item, F.coalesce(alone, bundle))
    items = sorted((r[item], r["bytes"]) for r in numbered.groupBy(item).agg(F.sum("bytes").alias("bytes")).collect())
    sizes = [b for _, b in items]
    bins = best_fit_decreasing(sizes, capacity) if capacity is not None else fewest_capacity(sizes, shards)
    plan = spark.createDataFrame([(i, b) for (i, _), b in zip(items, bins, strict=True)], f"`{item}` int, `{place}` int")
    out = sized.join(F.broadcast(lone), group, "left").withColumn(item, F.coalesce(alone, bundle)).drop(alone, group)
    out = out.join(F.broadcast(plan), item).drop(item)

    # Slots: rows are ordered within parts of a shard, and each part begins where the rows before it end.
    parts = max(1, -(-rows // (slot_rows * max(1, max(bins, default=0) + 1))))
    out = out.withColumn(part, F.pmod(F.xxhash64(key, crc), F.lit(parts)).cast("int"))
    counts = out.groupBy(place, part).count()
    starts = counts.withColumn(before, F.sum("count").over(Window.partitionBy(place).orderBy(part)) - F.col("count")).drop("count")
    order = Window.partitionBy(place, part).orderBy(F.col(key).asc_nulls_first(), F.col(crc).asc_nulls_first())
    out = out.join(F.broadcast(starts) if parts * (max(bins, default=0) + 1) <= 200_000 else starts, [place, part])
    out = out.withColumn(slot, (F.row_number().over(order) - 1 + F.col(before)).cast("long"))
    return out.select(*df.columns, size, place, slot)
