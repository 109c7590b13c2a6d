"""Caches of outside calls (embeddings, rewrites, judges' orders): what a call returns is in the files before anything reads it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, small, written
from .log import LogTable, create_if_absent
from .store import size_of

VECTORS, REWRITES, ORDERS = "key string, vector array<double>", "key string, rewrite string", "key string, ranking array<int>"
BUCKETS, CALLS, FILES, KEYS = 16, 1000, 8, 100_000
"""Buckets of keys; calls after which results are saved; folders a bucket before they are merged; keys that are sent to tasks at most."""


class CallCache:
    """A table of key and value that is written through.

    Keys that it lacks are claimed by bucket, called once, and appended bucket by bucket; only then are values read, from the
    files. So a result holds what the cache holds, whatever the call would say a second time. What was saved before a failure
    is not called again: a run that starts anew goes on where the other ended. Another caller that wants the same bucket waits
    until its claim ends, or `patience` seconds have passed, and calls only what is still missing then.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS, calls: int = CALLS, patience: float = 3600) -> None:
        self.spark, self.root, self.calls, self.patience = spark, root, calls, patience
        self.table = LogTable(spark, root, schema, "key", buckets)
        self.value = schema.split(",", 1)[1].split()[0]
        self.owner = uuid.uuid4().hex

    def load(self) -> DataFrame:
        """All entries; none if there is no cache."""
        return self.table.read()

    def save(self, entries: DataFrame) -> int:
        """Entries from elsewhere in place of all that there are."""
        return self.table.overwrite(entries)

    def stats(self) -> DataFrame:
        """One row: whether the cache exists, its entries, and the bytes of its files."""
        size = size_of(self.spark, self.root)
        return self.load().agg(F.lit(size is not None).alias("found"), F.count("*").alias("entries"), F.lit(size or 0).cast("long").alias("bytes"))

    def _claim(self, bucket: int) -> None:
        path = f"{self.root}/_claims/{bucket}"
        while not create_if_absent(self.spark, path, json.dumps({"owner": self.owner, "until": time.time() + self.patience})):
            fs, at = self.table._fs(path)
            try:
                source = fs.open(at)
                held = json.loads(bytes(source.readAllBytes()))
                source.close()
            except Exception:  # noqa: BLE001 - it has just gone
                continue
            if held["until"] < time.time():
                discard(self.spark, path)
            else:
                time.sleep(0.2)

    def _steps(self, counts: dict[int, int]) -> list[list[int]]:
        """Buckets in runs of about `calls` keys."""
        out, total = [], 0
        for b in sorted(counts):
            if out and total + counts[b] <= self.calls:
                out[-1].append(b)
                total += counts[b]
            else:
                out.append([b])
                total = counts[b]
        return out

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows (with a column `key`) and their values.

        `compute` maps one row of each key that the cache lacks to (key, value). A null value is a failed call: it is not kept,
        and the row has null.
        """
        rows = written(rows, "asked")
        once = rows.dropDuplicates(["key"]).where("key is not null")
        missing = written(once.join(self.load().select("key"), "key", "left_anti").withColumn("_b", self.table.bucket()), "missing")
        counts = {r["_b"]: r["count"] for r in missing.groupBy("_b").count().collect()}
        for step in self._steps(counts):
            try:
                for b in step:
                    self._claim(b)
                inside = missing.where(F.col("_b").isin(step)).drop("_b")
                left = inside.join(self.table.read(buckets=step).select("key"), "key", "left_anti")  # another caller may have been here
                self.table.append(compute(left).select("key", self.value).where(F.col(self.value).isNotNull()).dropDuplicates(["key"]))
            finally:
                for b in step:
                    self._release(b)
        if counts and len(self.table.snapshot().parts) > FILES * self.table.buckets:
            self.table.compact()
        found = self.load().join(small(rows.select("key").distinct(), KEYS), "key", "left_semi")
        return rows.join(found, "key", "left")

    def _release(self, bucket: int) -> None:
        path = f"{self.root}/_claims/{bucket}"
        fs, at = self.table._fs(path)
        if fs.exists(at):
            source = fs.open(at)
            mine = json.loads(bytes(source.readAllBytes()))["owner"] == self.owner
            source.close()
            if mine:
                discard(self.spark, path)
