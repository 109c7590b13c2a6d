"""Fusion, filters, boosts, diversification and rerankers. All work on many questions at once, keyed by qid."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import POWER_WORDS, RetrievalConfig
from ..functions.text import contains_any, has_technical_value

_DEFAULT = RetrievalConfig()


@dataclass(frozen=True)
class MetadataFilter:
    """None or an empty set means no bound."""

    files: frozenset[str] = field(default_factory=frozenset)
    page_min: int | None = None
    page_max: int | None = None
    source_types: frozenset[str] = field(default_factory=frozenset)

    def active(self) -> bool:
        return bool(self.files or self.source_types or self.page_min is not None or self.page_max is not None)

    def column(self) -> Column:
        """A conjunction of plain comparisons, so that it reaches the scan."""
        out = F.lit(True)
        if self.source_types:
            out &= F.col("source_type").isin(*sorted(self.source_types))
        if self.files:
            out &= F.col("file").isin(*sorted(self.files))
        if self.page_min is not None:
            out &= F.col("page") >= self.page_min
        if self.page_max is not None:
            out &= F.col("page") <= self.page_max
        return out

    @staticmethod
    def from_form(files=(), page_min: int = 0, page_max: int = 0, source_types=()) -> MetadataFilter:
        """0 means no page bound."""
        return MetadataFilter(frozenset(files), page_min or None, page_max or None, frozenset(source_types))


def fuse(hits: DataFrame, config: RetrievalConfig = _DEFAULT) -> DataFrame:
    """(qid, chunk_id, semantic, matches, fused_rank) of hits (qid, variant_pos, chunk_id, score): the best score plus a bonus for each further variant; ties in the order first seen, by variant and then by its score."""
    one = hits.groupBy("qid", "chunk_id").agg(F.max("score").alias("best"), F.count_distinct("variant_pos").alias("matches"), F.min(F.struct("variant_pos", -F.col("score"))).alias("seen"))
    one = one.withColumn("semantic", F.col("best") + config.fusion_bonus * (F.col("matches") - 1))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("semantic", 9)), "seen", "chunk_id")
    return one.select("qid", "chunk_id", "semantic", "matches", F.row_number().over(order).alias("fused_rank"))


def hybrid(candidates: DataFrame, config: RetrievalConfig = _DEFAULT) -> DataFrame:
    """candidates (semantic, lexical, fused_rank) with final and rank."""
    out = candidates.withColumn("final", config.semantic_weight * F.col("semantic") + config.lexical_weight * F.col("lexical"))
    return rerank(out, "fused_rank")


def rerank(results: DataFrame, tie: str = "rank") -> DataFrame:
    """rank by final, best first; ties keep their order."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("final", 9)), tie)))


def keep_if_any(results: DataFrame, when: Column, flag: Column) -> DataFrame:
    """Where `when` holds for a question, its rows with the flag, unless none has it."""
    any_flag = F.coalesce(F.max((flag & when).cast("int")).over(Window.partitionBy("qid")), F.lit(0)) == 1
    marked = results.withColumn("_keep", ~any_flag | flag)
    return marked.where("_keep").drop("_keep")


def technical_filter(results: DataFrame, technical: Column, question: str = "question", focus: str | None = None) -> DataFrame:
    """Narrows technical questions' results to chunks with values, then to files in focus (an array column of terms), then to watts for power questions. A step that would leave nothing is skipped."""
    return narrowed(results, technical, has_technical_value("text"), contains_any(question, POWER_WORDS), F.contains(F.lower("text"), F.lit("watt")), focus)


def narrowed(results: DataFrame, technical: Column, with_values: Column, power: Column, watts: Column, focus: str | None = None) -> DataFrame:
    """technical_filter on flags, for rows without their texts: whether a question is technical, a chunk has values, a question asks for power, a chunk speaks of watts."""
    has = F.max((with_values & technical).cast("int")).over(Window.partitionBy("qid")) == 1
    out = results.withColumn("_narrow", has)
    out = out.where(~F.col("_narrow") | with_values)
    if focus:
        out = keep_if_any(out, F.col("_narrow") & (F.size(focus) > 0), F.exists(focus, lambda t: F.contains(F.lower("file"), t)))
    return keep_if_any(out, F.col("_narrow") & power, watts).drop("_narrow")


def boost(results: DataFrame, rules: Iterable[tuple[Column, float]]) -> DataFrame:
    """Adds the bonus of every rule whose condition holds, and ranks anew."""
    bonus = sum((F.when(condition, F.lit(float(b))).otherwise(0.0) for condition, b in rules), F.lit(0.0))
    return rerank(results.withColumn("final", F.col("final") + bonus))


def diversify(results: DataFrame, top_k: int | Column, per_file: int = 2, when: Column | None = None) -> DataFrame:
    """At most per_file chunks of a file, in rank order; if these are fewer than top_k, the others follow in rank order. `when`: only for questions where it holds."""
    place = F.row_number().over(Window.partitionBy("qid", "file").orderBy("rank"))
    over = results.withColumn("_over", (place > per_file) & (F.lit(True) if when is None else when))
    again = over.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_over", "rank")))
    return again.where(F.col("rank") <= top_k).drop("_over")


def top(results: DataFrame, k: int | Column) -> DataFrame:
    return results.where(F.col("rank") <= k)


def apply_order(results: DataFrame, orders: DataFrame, top_k: int | Column, window: int | None = None, config: RetrievalConfig = _DEFAULT) -> DataFrame:
    """Applies a judge's order (orders: qid, ranking array<int> of 1-based ranks) to the first `window` results.

    Chosen ranks come first, each with 0.30 over its place as a bonus; the others follow in order. Repeated, out-of-range and
    missing ranks do nothing. Questions with no more than top_k results, no order, or no valid rank stay as they are.
    """
    wide = F.greatest(F.lit(top_k), F.lit(window or config.rerank_window))
    rows = results.withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
    size = F.least(F.col("_n"), wide)
    rows = rows.join(orders, "qid", "left").withColumn("_order", F.array_distinct(F.filter(F.coalesce("ranking", F.array().cast("array<int>")), lambda x: (x >= 1) & (x <= size))))
    place = F.when((F.col("_n") > top_k) & (F.col("rank") <= size), F.array_position("_order", F.col("rank"))).otherwise(F.lit(0))
    rows = rows.withColumn("_place", place)
    chosen = F.col("_place") > 0
    rows = rows.withColumn("final", F.when(chosen, F.col("final") + 0.30 / F.col("_place")).otherwise(F.col("final")))
    order = Window.partitionBy("qid").orderBy(F.when(chosen, 0).otherwise(1), F.when(chosen, F.col("_place")).otherwise(F.col("rank")))
    return rows.withColumn("rank", F.row_number().over(order)).drop("_n", "_order", "_place", "ranking")


def apply_cross_scores(results: DataFrame, scores: DataFrame, top_k: int | Column, window: int | None = None, config: RetrievalConfig = _DEFAULT) -> DataFrame:
    """Adds a cross-encoder's scores (qid, chunk_id, cross) within the first `window` results, and ranks these anew; the tail keeps its order, rows without a score stay in, and a question without any score keeps its order."""
    wide = F.greatest(F.lit(top_k), F.lit(window or config.cross_window))
    rows = results.join(scores, ["qid", "chunk_id"], "left").withColumn("_n", F.when(F.count("cross").over(Window.partitionBy("qid")) > 0, F.count("*").over(Window.partitionBy("qid"))).otherwise(0))
    inside = (F.col("_n") > top_k) & (F.col("rank") <= wide)
    rows = rows.withColumn("final", F.when(inside, F.col("final") + F.coalesce("cross", F.lit(0.0))).otherwise(F.col("final")))
    order = Window.partitionBy("qid").orderBy(F.col("rank") > wide, F.when(inside, -F.round("final", 9)).otherwise(0.0), "rank")
    return rows.withColumn("rank", F.row_number().over(order)).drop("_n", "cross")


def same_top(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """(qid, same): whether two result sets have the same first k chunks in the same order."""
    first = lambda d, name: d.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias(name))
    both = first(a, "x").join(first(b, "y"), "qid", "full_outer")
    return both.select("qid", F.col("x").eqNullSafe(F.col("y")).alias("same"))


def with_fallback(base: DataFrame, fallback: DataFrame) -> DataFrame:
    """base, and the fallback's rows for questions without any."""
    return base.unionByName(fallback.join(base.select("qid").distinct(), "qid", "left_anti"))
