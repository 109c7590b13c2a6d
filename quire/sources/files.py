"""Keeping a table in step with a folder of files: only files that are new or changed are read, and what is gone is deleted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, written
from .log import LogTable
from .store import exists

SEEN = "path string, size long, modified timestamp"
PASS = 10_000
"""Files that are read at a time: their paths go through the driver."""


def listing(spark: SparkSession, folder: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """(path, size, modified) of the files below a folder; their content is not read. A folder that is not there has none, and an empty file is as good as none: Spark's readers pass over it."""
    if not exists(spark, folder):
        return spark.createDataFrame([], SEEN)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", deep).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def differences(now: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, size, modified, change) of files that are added, changed (by size or time) or removed since `seen`."""
    old = seen.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    both = now.join(old, "path", "full_outer")
    change = F.when(F.col("_size").isNull(), "added").when(F.col("size").isNull(), "removed").when((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified")), "changed")
    return both.select("path", "size", "modified", change.alias("change")).where("change is not null")


@dataclass(frozen=True)
class Ingested:
    added: int
    changed: int
    removed: int
    version: int
    """Of the table after the run."""


def ingest(spark: SparkSession, folder: str, root: str, schema: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*", buckets: int = 64) -> Ingested:
    """Brings the table of parsed rows below `root` in step with a folder.

    `parse` maps (path, content) to rows of `schema`, which has a column `path`; it sees added and changed files only. Rows of a
    changed file replace its old ones in one version, those of a removed one go, and a file that gives no rows is noted as seen, one that becomes empty counts as removed. The
    list of seen files is written last: a run that fails is made good by the next one, which does the same again.
    """
    rows = table(spark, root, schema, buckets)
    seen = LogTable(spark, f"{root}/seen", SEEN, "path", buckets)
    found = written(differences(listing(spark, folder, glob), seen.read()), "changes")
    counts = {r.change: r["count"] for r in found.groupBy("change").count().collect()}
    fresh, gone = found.where("change <> 'removed'"), found.where("change = 'removed'")
    passes = max(1, -(-(counts.get("added", 0) + counts.get("changed", 0)) // PASS))
    for p in range(passes):
        mine = fresh.where(F.pmod(F.xxhash64("path"), F.lit(passes)) == p)
        paths = [r.path for r in mine.select("path").collect()]  # about PASS
        if paths:
            also = mine.select("path") if p else mine.select("path").unionAll(gone.select("path"))
            rows.upsert(parse(spark.read.format("binaryFile").load(paths).select("path", "content")), also=also)
            seen.upsert(mine.drop("change"))
        elif counts.get("removed") and not p:
            rows.delete(gone)
    if counts.get("removed"):
        seen.delete(gone)
    for t in (rows, seen):
        t.vacuum()
    return Ingested(*(counts.get(c, 0) for c in ("added", "changed", "removed")), rows.snapshot().version)


def table(spark: SparkSession, root: str, schema: str, buckets: int = 64) -> LogTable:
    """The table that ingest() keeps."""
    return LogTable(spark, f"{root}/rows", schema, "path", buckets)


def forget(spark: SparkSession, root: str) -> None:
    """Deletes the table and the list of seen files: the next run reads all."""
    discard(spark, root)
