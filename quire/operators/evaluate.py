"""Retrieval and answer evaluation, gates, report comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN_SIGNALS
from ..functions.text import contains_any, has_citation, signed


def retrieval_metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case (qid, expected_docs, expected_keywords): hits and recalls of the results (qid, file, text), rounded half-even to 2 places; 1.0 if nothing is expected."""
    found = results.groupBy("qid").agg(F.sort_array(F.collect_set("file")).alias("retrieved_docs"), F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")).alias("_all"))
    rows = cases.join(found, "qid", "left")
    docs = F.coalesce("expected_docs", F.array().cast("array<string>"))
    words = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    rows = rows.withColumn("docs_hits", F.filter(docs, lambda d: F.coalesce(F.array_contains("retrieved_docs", d), F.lit(False))))
    rows = rows.withColumn("keyword_hits", F.filter(words, lambda k: F.contains(F.coalesce("_all", F.lit("")), F.lower(k))))
    share = lambda hits, all_: F.bround(F.coalesce(F.try_divide(F.size(hits), F.size(all_)), F.lit(1.0)), 2)
    return rows.withColumns({"doc_recall": share("docs_hits", docs), "keyword_recall": share("keyword_hits", words)}).drop("_all")


def retrieval_summary(metrics: DataFrame) -> DataFrame:
    """One row: questions and mean recalls (of the rounded values) to 3 places; zeros without cases."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(f"mean_{c}")
    return metrics.agg(F.count("*").alias("questions"), mean("doc_recall"), mean("keyword_recall"))


def gate(metrics: DataFrame, least_doc: float | None = None, least_keyword: float | None = None, any_miss: bool = False) -> DataFrame:
    """One row: whether the run passes. A mean strictly below its bound fails; with any_miss, so does a case without a found document or keyword."""
    s = metrics.agg(F.bround(F.coalesce(F.avg("doc_recall"), F.lit(0.0)), 3).alias("d"), F.bround(F.coalesce(F.avg("keyword_recall"), F.lit(0.0)), 3).alias("k"), F.count_if((F.col("doc_recall") == 0) | (F.col("keyword_recall") == 0)).alias("misses"))
    ok = F.lit(True)
    if least_doc is not None:
        ok &= F.col("d") >= least_doc
    if least_keyword is not None:
        ok &= F.col("k") >= least_keyword
    if any_miss:
        ok &= F.col("misses") == 0
    return s.select(ok.alias("passed"), "misses")


def says_unknown(answer: str):
    return contains_any(answer, UNKNOWN_SIGNALS)


def answer_metrics(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Per case (qid, expected_facts, forbidden_terms, must_have_citation, expected_unknown) with its answer; a missing answer is empty (see plans.ask.complete for answers that are yet to be given)."""
    rows = cases.join(answers, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    low = F.lower("answer")
    inside = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.contains(low, F.lower(t)))
    rows = rows.withColumns({"facts_present": inside("expected_facts"), "forbidden_present": inside("forbidden_terms")})
    facts = F.coalesce(F.try_divide(F.size("facts_present"), F.size(F.coalesce("expected_facts", F.array().cast("array<string>")))), F.lit(1.0))
    citation = ~F.coalesce("must_have_citation", F.lit(False)) | has_citation("answer")
    unknown = ~F.coalesce("expected_unknown", F.lit(False)) | says_unknown("answer")
    rows = rows.withColumns({"_facts": facts, "citation_ok": citation, "unknown_ok": unknown})
    ok = (F.col("_facts") == 1) & (F.size("forbidden_present") == 0) & F.col("citation_ok") & F.col("unknown_ok")
    return rows.withColumns({"ok": ok, "facts_recall": F.bround("_facts", 2)}).drop("_facts")


def answer_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("questions"), F.bround(F.coalesce(F.avg(F.col("ok").cast("int")), F.lit(0.0)), 3).alias("success_rate"), F.bround(F.coalesce(F.avg("facts_recall"), F.lit(0.0)), 3).alias("mean_facts_recall"))


def report_delta(baseline: DataFrame, current: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, baseline, current, delta, label) of two one-row summaries; a missing metric counts as 0."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), (F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in df.columns else F.lit(0.0)).alias(name)) for m in metrics]
        return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")

    both = long(baseline, "baseline").join(long(current, "current"), "metric")
    delta = F.col("current") - F.col("baseline")
    return both.select("metric", "baseline", "current", delta.alias("delta"), signed(delta).alias("label"))


def delta_lines(deltas: DataFrame) -> DataFrame:
    """(metric, line) of report_delta's rows, as a console shows them; latencies are in seconds."""
    unit = F.when(F.col("metric") == "latency", F.lit("s")).otherwise("")
    return deltas.select("metric", F.format_string("%s %.2f%s -> %.2f%s  %s%s", F.rpad("metric", 16, " "), "baseline", unit, "current", unit, "label", unit).alias("line"))
