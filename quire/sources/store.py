"""The chunk index, caches and reports as files that Spark reads and writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import LogTable

CHUNK_SCHEMA = "chunk_id long, text string, file string, page int, ordinal int, source_type string, url string, title string, fetched_on date"
CASE_SCHEMA = "id string, question string, expected_docs array<string>, expected_keywords array<string>"
ANSWER_SCHEMA = "id string, question string, expected_facts array<string>, forbidden_terms array<string>, must_have_citation boolean, expected_unknown boolean"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def size_of(spark: SparkSession, path: str) -> int | None:
    """Bytes of all files below a folder; None if there is none."""
    fs, at = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else None


def state_of(spark: SparkSession, path: str) -> tuple[int, ...]:
    """Files and bytes below a path, and when the newest of them was written: changes with the table."""
    fs, at = _at(spark, path)
    found = fs.listStatus(at)
    return len(found), sum(s.getLen() for s in found), max([s.getModificationTime() for s in found], default=0)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def move_files(spark: SparkSession, draft: str, folder: str, name: str = "{}/data") -> None:
    """Moves the file of each partition's folder of a written table below `folder`, in place of what is there; `name` has {} for the partition's folder."""
    fs, at = _at(spark, draft)
    for part in fs.listStatus(at):
        if part.isDirectory():
            place = name.format(part.getPath().getName())
            (source,) = (s.getPath() for s in fs.listStatus(part.getPath()) if s.getPath().getName().startswith("part-"))
            _, to = _at(spark, f"{folder}/{place}")
            fs.mkdirs(to.getParent())
            fs.delete(to, False)
            fs.rename(source, to)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one if there is none. Missing columns of older files are null."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def publish(df: DataFrame, root: str) -> int:
    """Writes a new version of the whole table; readers see the old or the new one, never a mixture. Returns its number."""
    return LogTable(df.sparkSession, root, schema_of(df)).overwrite(df)


def discard_versions(spark: SparkSession, root: str, keep: int = 2, schema: str = CHUNK_SCHEMA) -> None:
    """Deletes the files that only older versions than the newest `keep` have."""
    LogTable(spark, root, schema).vacuum(keep)


def current(spark: SparkSession, root: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """The version with the largest number; FileNotFoundError without one."""
    table = LogTable(spark, root, schema)
    now = table.snapshot()
    if not now.version:
        raise FileNotFoundError(f"no index below {root}")
    return table.read(now)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.option("wholetext", True).text(path).first()[0]
    items = json.loads(raw)
    if not isinstance(items, list):
        raise ValueError("the file must hold a list of cases")
    for k, item in enumerate(items, 1):
        if not isinstance(item, dict) or not str(item.get("question") or "").strip():
            raise ValueError(f"case {k} must be an object with a question")
    rows = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(i) for i in items], 1)) if items else spark.createDataFrame([], schema)
    return rows.withColumn("qid", F.coalesce("id", F.substring("question", 1, 40)))


def retrieval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; an id that is missing is the question's first 40 characters."""
    return _cases(spark, path, CASE_SCHEMA)


def answer_cases(spark: SparkSession, path: str) -> DataFrame:
    return _cases(spark, path, ANSWER_SCHEMA)


def prebuilt_answers(spark: SparkSession, path: str) -> DataFrame:
    """(qid, answer) of a JSON object from id to answer."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("qid", "answer"))


def write_report(path: str, configuration: dict, summary: DataFrame, results: DataFrame) -> None:
    """A report of a bounded evaluation set: one JSON object with configuration, summary and results."""
    rows = results.agg(F.sort_array(F.collect_list(F.struct(*sorted(results.columns, key=lambda c: (c != "qid", c))))).alias("results"))
    body = summary.select(F.struct(*summary.columns).alias("summary")).join(F.broadcast(rows))  # one row each
    body.select(F.to_json(F.struct(F.from_json(F.lit(json.dumps(configuration)), F.schema_of_json(F.lit(json.dumps(configuration)))).alias("configuration"), "summary", "results")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    report = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    if not isinstance(report, dict) or not isinstance(report.get("summary"), dict):
        raise ValueError("a report must be an object with a summary")
    return report
