"""Corpus upkeep: union, upsert, caches, statistics, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXTRACT_PREFIX, TABLE_PREFIX
from ..functions.text import cache_key


def union_corpus(pdf: DataFrame, web: DataFrame) -> DataFrame:
    """All chunks of both kinds; columns that one lacks are null."""
    return pdf.unionByName(web, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """old without the rows whose key is in new, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, value: str, key: str = "url") -> DataFrame:
    return old.where(~F.col(key).eqNullSafe(F.lit(value)))


def clean_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Distinct non-empty trimmed addresses."""
    return urls.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, pages of PDF documents, web sources."""
    return chunks.agg(F.count_distinct("file").alias("documents"), F.count("*").alias("chunks"), F.count_distinct(F.when(F.col("source_type") == "pdf", F.struct("file", "page"))).alias("pdf_pages"), F.count_distinct(F.when(F.col("source_type") == "web", F.col("url"))).alias("web_sources"))


def inventory(chunks: DataFrame, folder: DataFrame | None = None) -> DataFrame:
    """Per document: chunks, pages, their range as a label, technical extracts and tables; with `folder` (file, size) also documents on one side only."""
    pages = F.when(F.min("page") == F.max("page"), F.min("page").cast("string")).otherwise(F.concat_ws("-", F.min("page").cast("string"), F.max("page").cast("string")))
    one = chunks.groupBy("file").agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), pages.alias("page_range"), F.count_if(F.col("text").startswith(EXTRACT_PREFIX)).alias("extracts"), F.count_if(F.col("text").startswith(TABLE_PREFIX.split()[0])).alias("tables"))
    if folder is None:
        return one
    both = one.join(folder.select("file", "size"), "file", "full_outer")
    status = F.when(F.col("chunks").isNull(), "not indexed").when(F.col("size").isNull(), "missing file").otherwise("indexed")
    return both.withColumn("status", status).withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def distinct_sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("file", "source_type").distinct()


def with_keys(texts: DataFrame, model: str, text: str = "text") -> DataFrame:
    return texts.withColumn("key", cache_key(model, text))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(key, text) once for each text that the cache lacks."""
    return with_keys(texts, model, text).select("key", text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def variants_once(variants: DataFrame, folded) -> DataFrame:
    """Query variants whose folded text is new for the question, first one kept."""
    order = Window.partitionBy("qid", folded).orderBy("variant_pos")
    return variants.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
