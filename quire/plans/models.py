"""Outside models as pluggable steps: query rewriting, a judge's order, a cross-encoder's scores, generation.

Each is a function from rows to rows (or, for the cross-encoder, from pairs of texts to scores inside an Arrow UDF), so clients
live in the caller's code. Null stands for a failed call, and a failed call leaves things as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import REWRITE_CHARS, RetrievalConfig
from ..functions.text import cache_key, json_ints, squash
from ..operators.rank import apply_cross_scores, apply_order
from ..session import ready
from ..sources.caches import CallCache
from ..sources.profiles import GENERIC, Profile

REWRITE_VERSION, JUDGE_VERSION = "v2", "v1"
"""Versions of the prompts; part of the caches' keys, so that a new prompt meets no old entry."""
_DEFAULT = RetrievalConfig()
Step = Callable[[DataFrame], DataFrame]


def rewrites(questions: DataFrame, cache: CallCache, model: str, call: Step, profile: Profile = GENERIC) -> DataFrame:
    """questions with `rewrite`, through the cache. `call` maps (key, prompt) to (key, reply). Replies are squashed and cut; failed calls give null and are not kept."""
    keyed = questions.withColumn("key", cache_key(REWRITE_VERSION, F.lit(profile.name), F.lit(model), "question"))

    def compute(missing: DataFrame) -> DataFrame:
        replies = call(missing.select("key", profile.rewrite_prompt("question").alias("prompt")))
        return replies.select("key", F.substring(squash("reply"), 1, REWRITE_CHARS).alias("rewrite"))

    return cache.through(keyed, compute).drop("key")


def judge_prompts(results: DataFrame, questions: DataFrame, model: str, top_k: int | Column, config: RetrievalConfig = _DEFAULT) -> DataFrame:
    """(qid, key, prompt) of the questions with more than top_k results: their first results, numbered, each cut to 900 characters. The key covers the passages."""
    rows = results.withColumn("_n", F.count("*").over(Window.partitionBy("qid"))).where((F.col("_n") > top_k) & (F.col("rank") <= F.greatest(F.lit(top_k), F.lit(config.rerank_window))))
    rows = rows.withColumn("_k", F.lit(top_k))
    print_ = F.concat_ws("|", "file", F.col("page").cast("string"), F.col("ordinal").cast("string"), F.substring(F.sha2("text", 256), 1, 16))
    block = F.concat(F.format_string("%d. Document: %s | page %d | score hybride %.3f\n", F.col("rank").cast("long"), "file", F.col("page").cast("long"), "final"), F.substring(squash("text"), 1, 900))
    lists = rows.groupBy("qid").agg(F.max("_k").alias("_k"), F.array_sort(F.collect_list(F.struct("rank", print_.alias("p"), block.alias("b")))).alias("r")).join(questions.select("qid", "question"), "qid")
    k, passages = F.col("_k").cast("string"), F.array_join(F.transform("r", lambda x: x["b"]), "\n")
    key = cache_key(JUDGE_VERSION, F.lit(model), k, "question", F.array_join(F.transform("r", lambda x: x["p"]), "\0"))
    prompt = F.concat(F.lit("Voici une question et des extraits numérotés. Quels extraits aident le plus à y répondre ? Donne seulement leurs numéros, du plus utile au moins utile, dans un tableau JSON de "), k, F.lit(" entiers au plus.\n\nQuestion :\n"), "question", F.lit("\n\nPassages :\n\n"), passages)
    return lists.select("qid", key.alias("key"), prompt.alias("prompt"))


def judged(results: DataFrame, questions: DataFrame, cache: CallCache, model: str, call: Step, top_k: int | Column, config: RetrievalConfig = _DEFAULT) -> DataFrame:
    """results in the judge's order, through the cache. `call` maps (key, prompt) to (key, reply); a reply without a list gives an empty order."""
    asked = judge_prompts(results, questions, model, top_k, config)
    orders = cache.through(asked, lambda missing: call(missing.select("key", "prompt")).select("key", F.when(F.col("reply").isNotNull(), json_ints("reply")).alias("ranking")))
    return apply_order(results, orders.select("qid", "ranking"), top_k, config=config)


def cross_encoded(results: DataFrame, questions: DataFrame, score: Callable[[Sequence[str], Sequence[str]], Sequence[float]], top_k: int | Column, config: RetrievalConfig = _DEFAULT) -> DataFrame:
    """results ranked anew by `score(questions, texts)` within each question's first results, in Arrow batches; texts are squashed and cut.

    Questions with at most top_k results are not scored. If `score` raises, the questions of its batch keep their order.
    """

    @F.pandas_udf(DoubleType())
    def scores(question: pd.Series, text: pd.Series) -> pd.Series:
        try:
            return pd.Series([float(x) for x in score(list(question), list(text))], dtype="float64")
        except Exception:  # noqa: BLE001 - whatever a model's client raises
            return pd.Series([None] * len(question), dtype="float64")

    rows = results.withColumn("_n", F.count("*").over(Window.partitionBy("qid"))).where((F.col("_n") > top_k) & (F.col("rank") <= F.greatest(F.lit(top_k), F.lit(config.cross_window))))
    pairs = rows.select("qid", "chunk_id", F.substring(squash("text"), 1, config.cross_chars).alias("_t")).join(questions.select("qid", F.col("question").alias("_q")), "qid")
    found = ready(pairs).select("qid", "chunk_id", scores("_q", "_t").alias("cross"))
    return apply_cross_scores(results, found, top_k, config=config)


def offline_answer(prompts: DataFrame) -> DataFrame:
    """(qid, answer) without a model: the start of the first source with its number, or that the context is empty."""
    first = squash(F.regexp_extract("prompt", r"(?s)\[Source (\d+) \|[^\]]*\]\n(.*)", 2))
    number = F.regexp_extract("prompt", r"\[Source (\d+) \|", 1)
    return prompts.select("qid", F.when(number == "", F.lit("Je ne sais pas : aucun contexte disponible.")).otherwise(F.concat(F.substring(first, 1, 200), F.lit(" ["), number, F.lit("]"))).alias("answer"))
