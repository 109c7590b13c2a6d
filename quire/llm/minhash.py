"""Near-duplicate documents by MinHash with odd sketches.

A document's set is its distinct word shingles. `samples` MinHash values are cut into bands for candidates and folded into
an odd sketch: a bitmap in which each (position, value) flips one bit. The exclusive or of two sketches is the sketch of
the samples in which they differ, so its population count gives the resemblance, precisely where it is high. A second
odd sketch folds in every shingle: its exclusive or has no more bits than the sets have differences, so too many bits rule a
pair out for certain. Candidate pairs that fail either test go; the rest are confirmed on the full sets.

Nothing grows with the square of a group of copies. Documents with equal sets are one class from the start. In each
bucket all members are first paired with the smallest one, and confirmed pairs are contracted; only buckets that still
hold several components are compared further, pair by pair in bounded blocks, across components only, and only pairs that
pass the sketch leave a block. With 32 bands of 4, a pair at resemblance 0.75 is missed by all bands with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, discard, lean, ready, release, slices, small
from .components import components

SAMPLES, BANDS, SKETCH_BITS, SET_BITS = 128, 32, 512, 2048
_WORDS = SKETCH_BITS // 64
_BLOCK = 256
_MULTIPLY = (W.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (W.mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
BROADCAST_IDS = 400_000
"""Ids to look up are broadcast up to this many (8 bytes each), and joined by a shuffle beyond."""


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and where each text's begin."""
    words = W.words_of(texts)
    hashes, counts = words.hashes(), words.counts()
    starts, shingles = W.windows(hashes, words.first, size)
    owner = np.searchsorted(words.first, starts, side="right") - 1
    for n in range(1, size):
        brief = np.flatnonzero(counts == n)
        if len(brief):
            shingles, owner = np.concatenate([shingles, W.rolled(hashes, n)[words.first[brief]]]), np.concatenate([owner, brief])
    order = np.argsort(shingles, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples (documents x SAMPLES) of non-empty sets."""
    low = (W.mix(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, SAMPLES), np.uint32)
    for i in range(SAMPLES):
        mixed = (low ^ _FLIP[i]) * _MULTIPLY[i]
        out[:, i] = np.minimum.reduceat(mixed ^ (mixed >> np.uint32(15)), first[:-1])
    return out


def _parities(row: np.ndarray, spot: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Parity bitmaps (rows x bits / 64, int64) of flips given as sorted rows and spots."""
    out = np.empty((rows, bits // 64), np.int64)
    edges = np.searchsorted(row, np.arange(0, rows + 1024, 1024))
    for k, begin in enumerate(range(0, rows, 1024)):
        n, part = min(1024, rows - begin), slice(edges[k], edges[k + 1])
        flips = np.bincount((row[part] - begin) * bits + spot[part], minlength=n * bits)
        out[begin : begin + n] = np.packbits((flips & 1).astype(bool).reshape(n, bits), axis=1).view(np.int64)
    return out


def odd_sketches(samples: np.ndarray, sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Odd sketches of the samples (SKETCH_BITS), then of the whole sets (SET_BITS), as int64 words."""
    rows = len(samples)
    spots = W.mix(samples.astype(np.uint64) | (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    brief = _parities(np.repeat(np.arange(rows), SAMPLES), spots.astype(np.int64).ravel(), rows, SKETCH_BITS)
    spots = (W.mix(sets ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SET_BITS)).astype(np.int64)
    return np.concatenate([brief, _parities(np.repeat(np.arange(rows), np.diff(first)), spots, rows, SET_BITS)], axis=1)


def _signed(texts: list[bytes], size: int):
    sets, first = shingle_sets(texts, size)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    starts = first[:-1][full]
    low, high = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    bands, sketches = np.zeros((0, BANDS), np.int64), np.zeros((0, (SKETCH_BITS + SET_BITS) // 64), np.int64)
    if len(full):
        low[full] = np.add.reduceat(W.mix(sets), starts).view(np.int64)
        high[full] = np.bitwise_xor.reduceat(W.mix(sets + np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
        samples = signatures(sets, np.append(starts, len(sets)))
        keys = samples.astype(np.uint64).reshape(len(full), BANDS, -1)
        mixed = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS)).copy()
        for k in range(keys.shape[2]):
            mixed = W.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, k])
        bands, sketches = mixed.view(np.int64), odd_sketches(samples, sets, np.append(starts, len(sets)))
    return counts, low, high, full, bands, sketches


def _lists(rows: np.ndarray, full: np.ndarray, n: int, width: int) -> pa.Array:
    """List array with a row's values at `full`, null elsewhere."""
    sizes = np.zeros(n + 1, np.int32)
    sizes[full + 1] = width
    offsets = np.cumsum(sizes).astype(np.int32)
    empty = np.ones(n, bool)
    empty[full] = False
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=pa.array(empty))


def signature_table(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, low, high, bands, sketch) a row; bands and sketch are null for empty sets."""
    schema = "id long, n long, low long, high long, bands array<long>, sketch array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                counts, low, high, full, bands, sketches = _signed(W.utf8(part.column(1)), size)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(low), pa.array(high), _lists(bands, full, n, BANDS), _lists(sketches, full, n, sketches.shape[1])], names=["id", "n", "low", "high", "bands", "sketch"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lean(sign), schema)


def least_estimate(threshold: float) -> tuple[float, int]:
    """The resemblance below which an estimate rules a pair out, 4.5 standard errors below the threshold, and as differing sketch bits."""
    spread = (threshold * (1 - threshold) / SAMPLES) ** 0.5
    least = max(0.0, threshold - 4.5 * 1.25 * spread)
    return least, int(SKETCH_BITS / 2 * (1 - np.exp(-2 * 2 * SAMPLES * (1 - least) / SKETCH_BITS)))


def _differ(x: str, y: str, words: range):
    bits = F.lit(0)
    for i in words:
        bits = bits + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return bits


def _resemble(pairs: DataFrame, most_bits: int, percent: int) -> DataFrame:
    """The pairs that neither sizes nor sketches rule out, with how far apart they seem."""
    sizes = F.col("n") + F.col("n_c")
    whole = _differ("sketch", "sketch_c", range(_WORDS, _WORDS + SET_BITS // 64))
    pairs = pairs.where(100 * F.least("n", "n_c") >= percent * F.greatest("n", "n_c"))
    pairs = pairs.withColumn("whole", whole).where(F.col("whole") * (100 + percent) <= sizes * (100 - percent))
    pairs = pairs.withColumn("bits", _differ("sketch", "sketch_c", range(_WORDS))).where(F.col("bits") <= most_bits)
    return pairs.select("c", "id", (F.col("bits") / SKETCH_BITS + F.col("whole") / sizes).alias("apart"))


def _within(block: dict, most_bits: int, percent: int, most: int | None, out: list) -> bool:
    """Appends the pairs of one block that the sketch lets through, across components, and across sides if the block has two.

    Of each row only the `most` likeliest pairs count; returns whether that left any out.
    """
    ids, part, n, side, sketch = (block[c] for c in ("id", "part", "n", "side", "sketch"))
    apart = np.full((len(ids), len(ids)), np.inf, np.float32)
    for k in range(len(ids) - 1):
        rest = slice(k + 1, None)
        near = (part[rest] != part[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
        if block["kind"][0]:
            near &= side[rest] != side[k]
        at = np.flatnonzero(near) + k + 1
        if len(at):
            flips = np.bitwise_count(sketch[at] ^ sketch[k])
            bits, whole, sizes = flips[:, :_WORDS].sum(axis=1, dtype=np.int64), flips[:, _WORDS:].sum(axis=1, dtype=np.int64), n[at] + n[k]
            may = (bits <= most_bits) & (whole * (100 + percent) <= sizes * (100 - percent))
            at = at[may]
            apart[k, at] = apart[at, k] = (bits / SKETCH_BITS + whole / sizes)[may]
    good = apart < np.inf
    more = most is not None and bool((good.sum(axis=1) > most).any())
    if more:
        last = np.partition(apart, most - 1, axis=1)[:, most - 1]
        good &= apart <= last[:, None]
    a, b = np.nonzero(good)
    out.append((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])))
    return more


def _block_pairs(most_bits: int, percent: int, most: int | None):
    """Over rows sorted by (band, kind, i, j): the pairs of each block, distinct within a batch of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, ["band", "kind", "i", "j"]

        def work(table: pa.Table) -> pa.RecordBatch:
            columns = {c: table.column(c).to_numpy() for c in (*names, "id", "part", "n", "side")}
            columns["sketch"] = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
            keys = [columns[c] for c in names]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            out: list = []
            more = False
            for a, b in zip([0, *new], [*new, table.num_rows], strict=True):
                if b - a > 1:
                    more |= _within({c: x[a:b] for c, x in columns.items()}, most_bits, percent, most, out)
            pairs = np.unique(np.stack([np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])], axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(np.full(len(pairs), more))], names=["c", "id", "more"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [table.column(c).to_numpy() for c in names]
            last = np.all([x == x[-1] for x in keys], axis=0)
            begin = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if begin:
                yield work(table.slice(0, begin))
            held = table.slice(begin).combine_chunks()
        if held is not None and held.num_rows:
            yield work(held)

    return run


def _judge(asks: list[tuple[int, int]], bodies: list[tuple[int, bytes]], size: int, percent: int) -> pa.RecordBatch:
    """Which asks, pairs of places in `bodies`, resemble on their full sets; as ids."""
    sets, first = shingle_sets([body for _, body in bodies], size)
    found = []
    for x, y in asks:
        a, b = sets[first[x] : first[x + 1]], sets[first[y] : first[y + 1]]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= percent * (len(a) + len(b) - both):
            found.append((bodies[x][0], bodies[y][0]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["c", "id"])


def _confirm(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (c, id) whose full sets resemble. Each centre meets its partners in groups of about 64, about a megabyte of text at a time."""
    pairs = cut(pairs.select("c", "id"), "pairs")
    many = pairs.groupBy("c").agg(F.ceil(F.count("*") / 64).alias("salts"))
    dealt = pairs.join(many, "c").select("c", "id", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    asks = dealt.select("id", "c", "salt").unionAll(dealt.select(F.col("c").alias("id"), "c", "salt").distinct())
    bodies = texts.join(small(asks, BROADCAST_IDS), "id").select("c", "salt", (F.col("id") != F.col("c")).alias("partner"), "id", "text")
    rows = bodies.repartition("c", "salt").sortWithinPartitions("c", "salt", "partner")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held, asks, held_bytes = None, [], [], 0
        for batch in batches:
            for c, salt, partner, i, body in zip(*(batch.column(k).to_pylist() for k in range(4)), W.utf8(batch.column(4)), strict=True):
                if not partner:  # comes first in its group
                    centre = (c, salt, len(held))
                else:
                    asks.append((centre[2], len(held)))
                held.append((i, body))
                held_bytes += len(body)
                if held_bytes > 1 << 20:
                    yield _judge(asks, held, size, percent)
                    held, asks, centre = [held[centre[2]]], [], (*centre[:2], 0)
                    held_bytes = len(held[0][1]) if len(held[0][1]) < 1 << 19 else 1 << 19
        if asks:
            yield _judge(asks, held, size, percent)

    out = cut(rows.mapInArrow(lean(confirm), "c long, id long"), "confirmed")
    discard(pairs)
    return out


def _blocks(placed: DataFrame, slim: DataFrame) -> DataFrame:
    """Rows of unfinished buckets, dealt to blocks: those of the centre's component in one block each, which meets all blocks of strays; strays also meet each other."""
    mixed = placed.groupBy("band").agg(F.count_if(F.col("part") == F.col("main")).alias("mains"), F.count_if(F.col("part") != F.col("main")).alias("strays")).where("strays > 0")
    rows = placed.join(mixed, "band").join(slim, "id").withColumn("side", (F.col("part") != F.col("main")).cast("int"))
    mb, sb = F.ceil(F.col("mains") / _BLOCK).cast("int"), F.ceil(F.col("strays") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 1, sb).otherwise(mb)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    across = F.when(F.col("side") == 0, F.transform(upto(sb), lambda j: cell(1, own, j))).otherwise(F.transform(upto(mb), lambda i: cell(1, i, own)))
    inside = F.when(F.col("side") == 0, F.array().cast("array<struct<kind:int,i:int,j:int>>")).otherwise(F.transform(upto(sb), lambda k: cell(0, F.least(own, k), F.greatest(own, k))))
    rows = rows.select("band", "id", "part", "n", "side", "sketch", F.explode(F.concat(across, inside)).alias("x")).select("band", "x.kind", "x.i", "x.j", "id", "part", "n", "side", "sketch")
    order = ["band", "kind", "i", "j"]
    return rows.repartition(*order).sortWithinPartitions(*order)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(<key>, n_shingles, component_id, kept) a row of df.

    Words are runs outside [\\x20\\x09-\\x0D] after lower-casing A-Z; a text with fewer than `size` words has one shingle, all
    of it. Texts that are null or have no word have an empty set and link with nothing. Rows with a null key have a null
    component, are not kept and link with nothing. Rows that share a key but not a set link with equal sets only. The smallest key of a component is kept. Other columns are ignored. An empty table gives no rows.
    """
    spark = ready(df)
    most_bits = least_estimate(percent / 100)[1]
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut(signature_table(df, key, text, size), "signed")
    unclear = signed.groupBy("id").agg((F.min("low") != F.max("low")).alias("unclear"))
    named = signed.where("n > 0 and id is not null").join(unclear, "id")
    classes = cut(named.groupBy("low", "high").agg(F.min(F.when(~F.col("unclear"), F.col("id"))).alias("rep"), F.min("id").alias("least")), "classes")
    heads = cut(named.join(classes.select("low", "high", F.col("rep").alias("id")), ["low", "high", "id"], "left_semi").dropDuplicates(["low", "high", "id"]).select("id", "n", "bands", "sketch"), "heads")
    release(spark)

    bands = heads.select("id", F.explode("bands").alias("band"))
    shared = cut(bands.groupBy("band").agg(F.min("id").alias("c"), F.count("*").alias("members")).where("members > 1"), "shared")
    members = cut(bands.join(shared, "band").select("band", "c", "members", "id"), "members")
    discard(shared)
    release(spark)
    slim = heads.select("id", "n", "sketch")
    centre = slim.select(F.col("id").alias("c"), F.col("n").alias("n_c"), F.col("sketch").alias("sketch_c"))
    stars = members.where("id != c").select("c", "id").distinct().join(slim, "id").join(centre, "c")
    stars = cut(_resemble(stars, most_bits, percent), "stars")
    best = stars.groupBy("id").agg(F.min(F.struct("apart", "c")).alias("x")).select("x.c", "id")
    confirmed = [_confirm(texts, best, size, percent)]
    parts = cut(components(confirmed[0], "c", "id"), "parts")

    def part_of(frame: DataFrame, column: str, name: str) -> DataFrame:
        return frame.join(parts.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    def join_up(pairs: DataFrame) -> DataFrame:
        """The components once those of `pairs` that are confirmed are links too."""
        confirmed.append(_confirm(texts, pairs, size, percent))
        joined = cut(components(reduce(DataFrame.unionAll, confirmed), "c", "id"), "parts")
        discard(parts)
        return joined

    rest = part_of(part_of(stars.select("c", "id").join(best, ["c", "id"], "left_anti"), "c", "pc"), "id", "pi").where("pc != pi").select("c", "id")
    parts = join_up(rest)
    tested, seen = stars.select("c", "id"), []

    # Buckets with several components are compared across them, in blocks of _BLOCK rows a side: each row's likeliest pairs
    # first, as these join most of a group of copies; again, while any were left out; and at last all that still cross components.
    for most in (4, 4, None):
        placed = cut(part_of(part_of(members.where("members > 2"), "id", "part"), "c", "main"), "placed")
        found = cut(_blocks(placed, slim).mapInArrow(lean(_block_pairs(most_bits, percent, most)), "c long, id long, more boolean").distinct(), "found")
        seen.append(found)
        parts = join_up(found.select("c", "id").distinct().join(tested, ["c", "id"], "left_anti"))
        discard(placed)
        release(spark)
        if not found.where("more").limit(1).count():
            break
        tested = tested.unionAll(found.select("c", "id")).distinct()
    discard(heads, members, stars, *confirmed, *seen)

    reach = part_of(classes, "rep", "part")
    # A class with a shared key only has no rep and stays alone; elsewhere the smallest key may be a shared one.
    lowest = reach.where("part is not null").groupBy("part").agg(F.min("least").alias("lowest"))
    labels = reach.join(lowest, "part", "left").select("low", "high", F.coalesce("lowest", "least").alias("component_id"))
    # Empty sets have no class: their keys stand in for the pair of hashes, so that they do not meet in one task.
    alone = lambda h: F.when(F.col("n") > 0, F.col(h)).otherwise(F.col("id")).alias(h)
    out = signed.select("id", "n", alone("low"), alone("high")).join(labels, ["low", "high"], "left")
    least = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), least).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
