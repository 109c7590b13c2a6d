"""Streaming ingestion: new pages arrive as files, become chunks without state, and each batch replaces its addresses in the web chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import chunks
from ..sources.html import web_pages
from ..sources.log import LogTable

WEB_SCHEMA = "url string, file string, title string, page int, source_type string, fetched_on date, pos int, chunk string"


def page_stream(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files).parquet(folder)


def chunk_stream(pages: DataFrame, fetched_on: str, size: int = 800, overlap: int = 2, bare: bool = True) -> DataFrame:
    return chunks(web_pages(pages, fetched_on, bare=bare), "text", size, overlap).drop("text")


def keep_current(stream: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Runs over what is there and stops. Within a batch each address counts as a whole; a replayed batch changes nothing.

    A batch rewrites the buckets of its addresses only. Another writer may change the table at the same time.
    """

    def replace(batch: DataFrame, number: int) -> None:
        table = LogTable(batch.sparkSession, root, WEB_SCHEMA, "url", buckets)
        table.upsert(batch, stream=checkpoint, batch=number)
        table.vacuum()

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
