"""Shared plumbing: the shared work folder, cut tables, bounded broadcasts, name clashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
"""Rows cross to Python a few megabytes at a time, unless the user has set another size than Spark's own."""

_written: list[tuple[SparkSession, str]] = []


def ready(df: DataFrame) -> SparkSession:
    """df's session, once the executors' Python can import this library (it is sent to them as a zip file)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if getattr(context, "_quire_sent", None) is None:
        root = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}_library", "zip", root.parent, root.name))
        context._quire_sent = True
    if spark.conf.get(_BATCH_BYTES) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_BYTES, "4m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); local sessions get one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints/quire"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def cut(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._quire_path)
        _written.remove((df.sparkSession, df._quire_path))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_held: dict[str, object] = {}


def trim() -> None:
    """Give freed memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def kept(name: str, make: Callable[[], object]):
    """What a worker keeps from task to task under `name`. Another name's things go first: workers outlive operators, and keep those of one only."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def lean(run: Callable) -> Callable:
    """A mapInArrow function that leaves no freed memory behind when its task ends."""

    @wraps(run)
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            trim()

    return trimmed


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            _remove(spark, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(taken: list[str], name: str) -> str:
    """`name`, with underscores until no column of `taken` has it (names compare without case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts in `column` have about `most` bytes together, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total, begin, base = np.cumsum(sizes.astype(np.int64)), 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(begin, end - begin)
        base, begin = int(total[end - 1]), end
