"""PDF pages behind a pluggable parser.

`parse` maps the bytes of a file to pages (page from 1, text, tables). It runs once a file in a Python worker, so clients and
native libraries belong inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EXTRACT_TITLE, TABLE_PREFIX, TABLE_TITLE
from ..operators.tables import find_tables
from ..session import ready
from ..operators.segment import section_chunks, table_markdown, technical_windows

PAGES = 200
PAGE_SCHEMA = "file string, page int, text string, tables array<array<array<string>>>"


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(file, path, size) of the folder's own *.pdf files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("size"))


def read_pages(spark: SparkSession, folder: str, parse: Callable[[bytes], Iterable[tuple[int, str, list]]]) -> DataFrame:
    """Pages of the files. A worker holds one file's bytes and PAGES pages at a time, if `parse` gives its pages one by one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string()))))])
        for batch in batches:
            for k in range(batch.num_rows):
                name, pages = batch.column(0)[k].as_py().rsplit("/", 1)[-1], iter(parse(batch.column(1)[k].as_py()))
                while some := [(name, *page) for page in islice(pages, PAGES)]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(n).type) for n, c in enumerate(zip(*some, strict=True))], schema=kinds)

    return ready(files).mapInArrow(run, PAGE_SCHEMA)


def with_tables(pages: DataFrame, words: DataFrame) -> DataFrame:
    """pages (file, page, text) with the `tables` that are found from their words' places, so that no parser needs to find any."""
    return pages.drop("tables").join(find_tables(words, ["file", "page"]), ["file", "page"], "left")


def page_chunks(pages: DataFrame, size: int = 800, overlap: int = 2) -> DataFrame:
    """Chunks of pages: tables, then technical extracts, then sections, numbered within the page; pages without text keep their tables only."""
    key = ["file", "page"]
    tables = pages.select(*key, F.posexplode_outer(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), table_markdown)).alias("pos", "text")).where("text <> ''")
    head = F.concat(F.lit(TABLE_PREFIX), F.col("page").cast("string"), F.lit(", tableau "), (F.col("pos") + 1).cast("string"), F.lit("\n\n"), "text")
    tables = tables.select(*key, F.lit(0).alias("kind"), F.array("pos").alias("place"), head.alias("text"), F.lit(TABLE_TITLE).alias("title"))
    texts = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(*key, "text")
    windows = technical_windows(texts, key, "text", "page").select(*key, F.lit(1).alias("kind"), F.array(F.col("window_no").cast("int")).alias("place"), F.col("excerpt").alias("text"), F.lit(EXTRACT_TITLE).alias("title"))
    parts = section_chunks(texts, key, "text", size, overlap).select(*key, F.lit(2).alias("kind"), F.array(F.col("section").cast("int"), F.col("pos").cast("int")).alias("place"), F.col("chunk").alias("text"), "title")
    all_ = tables.unionByName(windows).unionByName(parts)
    ordinal = F.row_number().over(Window.partitionBy(*key).orderBy("kind", "place"))
    return all_.select(*key, ordinal.alias("ordinal"), "text", "title", F.lit("pdf").alias("source_type"))
