"""Sends the library to executors whose Python cannot import it."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


BATCH = 2 << 20
"""Bytes of rows that a Python worker gets at a time: with rows counted alone (10,000 at first), its memory grows with the texts' length and the tasks' size."""


def ready(df: DataFrame) -> DataFrame:
    """df, once executors can import this library; the driver serves it as a zip file. Batches for Python have BATCH bytes at most, or what the session has if that is less."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not 0 < _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    if getattr(context, "_quire_sent", None) is None:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}_library", "zip", root.parent, root.name))
        context._quire_sent = True
    return df


def _bytes(x: str) -> int:
    """A size as Spark's settings write it."""
    number = x.strip().lower().rstrip("kmgtpb")
    return int(number or 0) << 10 * " kmgtp".find((x.strip().lower()[len(number) :] or "b").replace("b", " ")[0])


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the one that driver and executors share (spark.checkpoint.dir); local sessions have one under /tmp. It goes when Python ends, if not before (discard)."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(shared or f'file://{tempfile.gettempdir()}').rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a work folder and read back: what several branches of a plan need is computed once, and outlives lost executors."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            discard(spark, path)
