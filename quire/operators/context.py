"""Budgeted context, prompts, citations, exports."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import estimate_tokens, excerpt, source_link
from ..session import ready

# An empty context's sentence, the rules of a prompt, and the head of a source's block (in source_block).
NO_CONTEXT = "Aucun contexte disponible."
RULES = ("Réponds en français.", "N'utilise que le contexte.", "Cite les sources sous la forme [N].", "Présente les valeurs techniques en tableau.", "Si le contexte ne suffit pas, dis-le.")


def source_block() -> Column:
    """The numbered block of one ranked result."""
    where = F.when(F.col("source_type") == "web", F.concat(F.lit("url "), F.coalesce("url", F.lit("")), F.lit(", consulte le "), F.coalesce(F.col("fetched_on").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("page "), F.col("page").cast("string")))
    head = F.format_string("[Source %d | Document : %s | %s, chunk %d, score final %.3f, score FAISS %.3f, score lexical %.3f]\n%s", F.col("rank").cast("long"), F.col("file"), where, F.col("ordinal").cast("long"), F.col("final"), F.col("semantic"), F.col("lexical"), F.col("text"))
    return head


def fit_budget(results: DataFrame, budget: int) -> DataFrame:
    """(qid, file, rank, cost, block) of the results that fit: in rank order, one that does not fit is passed over and later ones may.

    The fold runs over one question's ranked results, at most top_k of them.
    """
    rows = results.withColumn("block", source_block()).withColumn("cost", estimate_tokens("block"))
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "cost", "file", "block"))).alias("r"))
    start = F.expr("named_struct('used', 0L, 'ranks', cast(array() as array<int>))")
    fits = lambda acc, x: acc["used"] + x["cost"] <= budget
    grown = lambda acc, x: F.struct(F.when(fits(acc, x), acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits(acc, x), F.concat(acc["ranks"], F.array(x["rank"].cast("int")))).otherwise(acc["ranks"]).alias("ranks"))
    kept = F.aggregate("r", start, grown)
    picked = lists.select("qid", F.explode("r").alias("x"), kept.alias("k"))
    return picked.where(F.array_contains("k.ranks", F.col("x.rank").cast("int"))).select("qid", "x.file", "x.rank", "x.cost", "x.block")


def assemble(fitted: DataFrame) -> DataFrame:
    """(qid, context): blocks under a heading for each document, documents in the order of their first block."""
    docs = fitted.groupBy("qid", "file").agg(F.min("rank").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))
    body = F.concat(F.lit("## Document : "), "file", F.lit("\n"), "blocks")
    return docs.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", body.alias("body")))), lambda x: x["body"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, rules: tuple[str, ...] = (), hints: Column | None = None) -> DataFrame:
    """(qid, prompt) of questions (qid, question) and their contexts; an empty context gives a fixed sentence."""
    rows = questions.join(contexts, "qid", "left")
    context = F.when(F.coalesce("context", F.lit("")) == "", F.lit(NO_CONTEXT)).otherwise(F.col("context"))
    parts = [F.lit("Règles :\n" + "\n".join(f"- {r}" for r in (*RULES, *rules)))]
    if hints is not None:
        parts.append(F.nullif(hints, F.lit("")))
    parts += [F.concat(F.lit("Question :\n"), "question"), F.concat(F.lit("Contexte :\n"), context)]
    return rows.select("qid", F.concat_ws("\n\n", *parts).alias("prompt"))


def mentions(results: DataFrame, patterns: Iterable[tuple[str, str]], most: int = 4) -> DataFrame:
    """(qid, name, sources): for each named pattern the ranks, at most `most`, of the results it matches, whatever the case.

    A text is searched for all patterns at once first; only texts that have one are searched for each. Nothing is joined.
    """
    patterns = list(patterns)
    if not patterns:
        return results.select("qid", F.lit("").alias("name"), F.array("rank").alias("sources")).where("false")
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(f"(?i){p}"), F.lit(n)) for n, p in patterns)))
    if not any(re.search(r"\\\d", p) for _, p in patterns):  # a joined pattern would number groups anew
        found = F.when(F.col("text").rlike("(?i)" + "|".join(f"(?:{p})" for _, p in patterns)), found)
    hits = results.select("qid", "rank", F.explode_outer(found).alias("name")).where("name is not null")
    return hits.groupBy("qid", "name").agg(F.slice(F.array_sort(F.collect_set("rank")), 1, most).alias("sources"))


def mention_hints(found: DataFrame, title: str) -> DataFrame:
    """(qid, hints): a header and a line for each name."""
    line = F.concat(F.lit("- "), "name", F.lit(" : "), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("["), s.cast("string"), F.lit("]"))), ", "))
    return found.groupBy("qid").agg(F.concat(F.lit(title + "\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("hints"))


@F.pandas_udf(StringType())
def link_citations(answer: pd.Series, links: pd.Series, files: pd.Series, pages: pd.Series) -> pd.Series:
    """Turns [n], (file, page p) and (file, p. p) into Markdown links; with no link at all, the first three sources follow. The patterns depend on the row."""
    out = []
    for text, urls, names, numbers in zip(answer, links, files, pages, strict=True):
        if text is None:
            out.append(None)
            continue
        urls = [] if urls is None else list(urls)
        for url, name, page in zip(urls, names if names is not None else (), numbers if numbers is not None else (), strict=False):
            if url:
                text = re.sub(rf"\(({re.escape(str(name))},? (?:page|p\.) ?{page})\)", lambda m, u=url: f"([{m[1]}]({u}))", text)
        text = re.sub(r"\[(\d+)\](?!\()", lambda m, u=urls: f"[[{m[1]}]]({u[int(m[1]) - 1]})" if 0 < int(m[1]) <= len(u) and u[int(m[1]) - 1] else m[0], text)
        if "](" not in text and any(urls):
            text += "\n\n" + " ".join(f"[[{k}]]({u})" for k, u in list(enumerate(urls, 1))[:3] if u)
        out.append(text)
    return pd.Series(out)


def with_links(answers: DataFrame, results: DataFrame, base: str = "/app/static/pdfs/") -> DataFrame:
    """answers (qid, answer) with `linked`."""
    sources = results.withColumn("link", source_link("source_type", "url", "file", "page", base)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "link", "file", "page"))).alias("s"))
    rows = ready(answers).join(sources, "qid", "left")
    return rows.select("qid", link_citations("answer", "s.link", "s.file", "s.page").alias("linked"))


def export_markdown(questions: DataFrame, answers: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, markdown): question, answer and numbered sources."""
    line = F.format_string("%d. %s, page %d (score %.3f)", F.col("rank").cast("long"), "file", F.col("page").cast("long"), "final")
    sources = results.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("sources"))
    rows = questions.join(answers, "qid", "left").join(sources, "qid", "left")
    parts = [F.concat(F.lit("# Question\n\n"), "question"), F.concat(F.lit("## Réponse\n\n"), F.coalesce("answer", F.lit(""))), F.concat(F.lit("## Sources\n\n"), F.coalesce("sources", F.lit("")))]
    return rows.select("qid", F.concat_ws("\n\n", *parts).alias("markdown"))


def recent(history: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The newest n rows; with a session key, use a window instead."""
    return history.orderBy(*order).limit(n)


def result_lines(results: DataFrame, size: int = 700) -> DataFrame:
    """(qid, rank, line): a ranked result as a console shows it, with the start of its text."""
    place = F.when(F.col("source_type") == "web", F.concat(F.lit("Web : "), "file", F.lit(" | "), F.coalesce("url", F.lit("")))).otherwise(F.concat("file", F.lit(", page "), F.col("page").cast("string")))
    head = F.format_string("[%d] %s, chunk %d\nscore_final=%.3f | faiss=%.3f | lexical=%.3f\n%s", F.col("rank").cast("long"), place, F.col("ordinal").cast("long"), "final", "semantic", "lexical", excerpt("text", size))
    return results.select("qid", "rank", head.alias("line"))
