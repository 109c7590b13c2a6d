"""From a question to a linked answer: search, a wider search where nothing was found, context, prompt, generation, links."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.text import asks_technical
from ..operators.context import assemble, fit_budget, prompts, with_links
from ..operators.rank import MetadataFilter, with_fallback
from ..session import written
from ..sources.profiles import GENERIC, Profile
from .models import Step, offline_answer
from .search import SearchResult, search

# Fixed values of the wider search for technical questions.
WIDE_TOP_K, WIDE_CANDIDATE_K, WIDE_SOURCES = 8, 120, ("pdf", "web")
_DEFAULT = RetrievalConfig()


@dataclass(frozen=True)
class Answers:
    answers: DataFrame
    """qid, question, prompt, answer, linked, fallback (whether the wider search gave the sources)."""
    results: DataFrame
    found: SearchResult


def wider(questions: DataFrame, chunks: DataFrame, embed: Step, config: RetrievalConfig = _DEFAULT, **given) -> SearchResult:
    """The search for technical questions that found nothing: more candidates, no threshold, all kinds of sources."""
    wide = replace(config, top_k=max(config.top_k, WIDE_TOP_K), candidate_k=max(config.candidate_k, WIDE_CANDIDATE_K), min_score=0.0)
    return search(questions.where(asks_technical("question")), chunks, embed, where=MetadataFilter(source_types=frozenset(WIDE_SOURCES)), config=wide, **given)


def ask(questions: DataFrame, chunks: DataFrame, embed: Step, generate: Step = offline_answer, profile: Profile = GENERIC, where: MetadataFilter | None = None, config: RetrievalConfig = _DEFAULT, fallback: bool = True, **given) -> Answers:
    """The whole way for a batch of questions (qid, question). `generate` maps (qid, prompt) to (qid, answer).

    Technical questions without a result get those of the wider search. Further arguments go to search().
    """
    found = search(questions, chunks, embed, profile=profile, where=where, config=config, **given)
    results = found.results.withColumn("_wide", F.lit(False))
    if fallback:
        results = with_fallback(results, wider(questions, chunks, embed, config, profile=profile, **given).results.withColumn("_wide", F.lit(True)))
    widened = results.groupBy("qid").agg(F.max("_wide").alias("fallback"))
    results = results.drop("_wide")
    asked = prompts(questions, assemble(fit_budget(results, config.context_tokens)), profile.prompt_lines())
    said = written(generate(asked).select("qid", "answer"), "answers")  # two branches read it, and a model is to be asked once
    answers = questions.join(asked, "qid").join(said, "qid", "left")
    linked = with_links(answers.select("qid", "answer"), results)
    out = answers.join(linked, "qid", "left").join(widened, "qid", "left")
    return Answers(out.select("qid", "question", "prompt", "answer", "linked", F.coalesce("fallback", F.lit(False)).alias("fallback")), results, found)


def complete(cases: DataFrame, given: DataFrame, answer: Step) -> DataFrame:
    """(qid, answer) of all cases (qid, question): the given answers, and what `answer` says to the questions that have none.

    A given answer counts even if it is empty or null. `answer` maps (qid, question) to (qid, answer, ...) and sees the other
    cases only; answers to no case are left out.
    """
    known = given.select("qid", "answer").join(cases.select("qid"), "qid", "left_semi")
    return known.unionByName(answer(cases.join(known, "qid", "left_anti").select("qid", "question")).select("qid", "answer"))
