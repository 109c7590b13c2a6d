"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, discard, release, small
from quire.llm.decontaminate import find_leaks
from quire.llm.language_id import fit, identify
from quire.llm.minhash import BROADCAST_IDS, near_duplicates
from quire.llm.packing import pack
from quire.llm.queries import table, tokenizer
from quire.llm.substring import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that is more likely than not."""
    return identify(docs, fit(docs, "text", "lang"), host="source").where("accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, and one row of each key. Rows with a null key stay."""
    judged = cut(near_duplicates(docs.select("doc_id", "text")), "judged")
    removed = small(judged.where("doc_id is not null and not kept").select("doc_id").distinct(), BROADCAST_IDS)
    out = docs.join(removed, "doc_id", "left_anti")
    repeated = judged.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count():
        repeated = small(repeated, BROADCAST_IDS)
        out = out.join(repeated, "doc_id", "left_anti").unionByName(out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of texts. Texts that lose nothing stay as they are; a document keeps its row in any case."""
    out = remove_repeats(docs, kept="kept_text")
    kept, removed = out.columns[len(docs.columns)], out.columns[len(docs.columns) + 2]
    out = out.withColumn("text", F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    out = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.size(out.columns[-1]) == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", packing)]

ORACLE_SQL = None
"""No stage but the last filter is SQL; tests/llm holds the stages against brute-force versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
            if done is not None:
                discard(done)
            done = docs
            release(spark)
    return docs
