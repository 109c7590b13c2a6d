"""Building the chunk index: both kinds of sources, vectors through the cache, one published table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import l2_normalise
from ..functions import hashed
from ..operators.corpus import index_stats, union_corpus, with_keys
from ..sources.caches import VECTORS, CallCache
from ..sources.store import CHUNK_SCHEMA, current, publish

HASHED = "hashed-1"
"""The name of the vectors that need no model."""
INDEX_SCHEMA = f"{CHUNK_SCHEMA}, embedding array<double>"


@dataclass(frozen=True)
class Built:
    version: int | None
    stats: DataFrame


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id, a hash of where the chunk stands: the same chunk has the same id in every build.

    An address may be there twice: of several chunks in one place the second and further ones, by their texts, have their number in the hash too.
    """
    where = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_type", "file", "url", "page", "ordinal")]
    rows = chunks.withColumn("_place", F.xxhash64(*where))
    again = F.row_number().over(Window.partitionBy("_place", *where).orderBy("text"))
    return rows.withColumn("_again", again).withColumn("chunk_id", F.when(F.col("_again") == 1, F.col("_place")).otherwise(F.xxhash64(*where, "_again"))).drop("_place", "_again")


def build_index(pdf: DataFrame, web: DataFrame, root: str, cache_root: str, embed: Callable[[DataFrame], DataFrame] | None = None, model: str = HASHED) -> Built:
    """Publishes all chunks of both kinds with unit vectors below `root`; calls go through the cache below `cache_root`.

    `embed` maps (key, text) to (key, vector) and sees each text that the cache lacks once. Without it texts get hashed vectors,
    whose weights are learnt from all chunks and kept beside the table, below `<root>-weights`; they cost less than a cache.
    Chunks without text are left out; without any chunk nothing is published. Readers see the old or the new version.
    """
    spark = pdf.sparkSession
    chunks = union_corpus(pdf, web).where(F.trim("text") != "")
    if chunks.isEmpty():
        return Built(None, index_stats(chunks))
    chunks = numbered(chunks)
    if embed is None:
        vectors = hashed.fit(chunks)
        vectors.save(spark, f"{root}-weights")
        rows = vectors.embed(chunks)
    else:
        rows = CallCache(spark, cache_root, VECTORS).through(with_keys(chunks, model), lambda missing: embed(missing.select("key", "text")).select("key", F.col("vector").cast("array<double>").alias("vector")))
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    rows = rows.withColumn("embedding", l2_normalise("vector"))
    for c in set(names) - set(rows.columns):
        rows = rows.withColumn(c, F.lit(None))
    version = publish(rows.select(*(F.col(n).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in INDEX_SCHEMA.split(", ")))), root)
    return Built(version, index_stats(current(spark, root, INDEX_SCHEMA)))
