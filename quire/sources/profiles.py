"""Domain profiles: rules of a field as JSON files, one a profile. The generic profile has none."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, contains_any, count_terms
from ..operators.rank import rerank
from .store import exists

RULE_SCHEMA = "profile string, rule_pos int, text string, any_terms array<string>, all_terms array<string>"
GENERIC_NAMES = ("", "generic", "generique")  # fixed values
REWRITE_CONTEXT = "Les questions portent sur un fonds de documents et de pages web ; la recherche a besoin de leurs termes techniques."
REWRITE_DEMANDS = ("Écris la même demande avec d'autres mots, sans y répondre.", "Garde chaque nom, nombre et unité.", "Réponds par une ligne de 45 mots au plus.")


@dataclass(frozen=True)
class Expansion:
    text: str
    any_terms: tuple[str, ...] = ()
    all_terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Focus:
    any_terms: tuple[str, ...] = ()
    filename_contains: tuple[str, ...] = ()


@dataclass(frozen=True)
class Boost:
    """Bonuses for results of the questions that have one of any_terms (if there are some) and all of all_terms."""

    any_terms: tuple[str, ...] = ()
    all_terms: tuple[str, ...] = ()
    count_terms: tuple[str, ...] = ()
    """Terms that are counted in a result's text, each once."""
    count_bonus: tuple[tuple[int, float], ...] = ()
    """(terms at least, bonus); the largest number that is reached counts."""
    file_bonus: tuple[tuple[str, float], ...] = ()
    """(part of the file's name, bonus); all that apply add up, as those of texts do."""
    text_bonus: tuple[tuple[str, float], ...] = ()

    def bonus(self, question: Column | str, text: Column | str, file: Column | str) -> Column:
        has = lambda c: lambda t: F.contains(F.lower(col(c)), F.lit(t.lower()))
        out, found = F.lit(0.0), count_terms(text, map(str.lower, self.count_terms))
        steps = sorted(self.count_bonus, reverse=True)
        if steps and self.count_terms:
            out += reduce(lambda c, s: c.when(found >= s[0], float(s[1])), steps[1:], F.when(found >= steps[0][0], float(steps[0][1]))).otherwise(0.0)
        for c, bonuses in ((file, self.file_bonus), (text, self.text_bonus)):
            out = sum((F.when(has(c)(part), float(b)).otherwise(0.0) for part, b in bonuses), out)
        asked = contains_any(question, map(str.lower, self.any_terms)) if self.any_terms else F.lit(True)
        asked &= reduce(lambda c, t: c & has(question)(t), self.all_terms, F.lit(True))
        return F.when(asked, out).otherwise(0.0)


@dataclass(frozen=True)
class Profile:
    name: str = "generic"
    display_name: str = "Generique"
    description: str = ""
    query_rewrite_context: str = REWRITE_CONTEXT
    query_rewrite_extra_constraints: tuple[str, ...] = ()
    expansion_rules: tuple[Expansion, ...] = ()
    technical_focus_rules: tuple[Focus, ...] = ()
    prompt_extra_rules: tuple[str, ...] = ()
    prompt_extra_formats: tuple[str, ...] = ()
    boost_rules: tuple[Boost, ...] = ()
    mention_patterns: tuple[tuple[str, str], ...] = ()
    """(name, pattern) of what is pointed out in results."""

    def boosted(self, results: DataFrame, question: str = "question") -> DataFrame:
        """results ranked anew with the bonuses of all boost rules; nothing is joined."""
        if not self.boost_rules:
            return results
        bonus = sum((b.bonus(question, "text", "file") for b in self.boost_rules), F.lit(0.0))
        return rerank(results.withColumn("final", F.col("final") + bonus))

    def rules(self, spark: SparkSession) -> DataFrame:
        """The expansion rules as a table, in their order."""
        rows = [(self.name, k, r.text, list(r.any_terms), list(r.all_terms)) for k, r in enumerate(self.expansion_rules)]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def focus(self, question: Column | str) -> Column:
        """Lower-case terms of the files that a question is narrowed to: those of every focus rule of which it has a term."""
        none = F.array().cast("array<string>")
        found = [F.when(contains_any(question, map(str.lower, r.any_terms)), F.array(*(F.lit(t.lower()) for t in r.filename_contains if t)).cast("array<string>")).otherwise(none) for r in self.technical_focus_rules]
        return F.concat(*found) if found else none

    def prompt_lines(self) -> tuple[str, ...]:
        """What the profile adds to the rules of an answer's prompt."""
        return (*self.prompt_extra_rules, *self.prompt_extra_formats)

    def rewrite_prompt(self, question: Column | str) -> Column:
        demands = "\n".join(f"- {d}" for d in (*REWRITE_DEMANDS, *self.query_rewrite_extra_constraints))
        return F.concat(F.lit(f"{self.query_rewrite_context}\n\nReformule la question pour la recherche documentaire.\n\n{demands}\n\nQuestion :\n"), col(question))


GENERIC = Profile()


def from_json(body: str) -> Profile:
    """A profile of a JSON object; `name` and each expansion's `text` are required (ValueError), all else has defaults."""
    given = json.loads(body)
    if not isinstance(given, dict) or not given.get("name"):
        raise ValueError("a profile must be an object with a name")
    texts = lambda rule, *names: {n: tuple(rule.get(n) or ()) for n in names}
    if not all(r.get("text") for r in given.get("expansion_rules", [])):
        raise ValueError("an expansion rule must have a text")
    fields = {n: given[n] for n in ("display_name", "description", "query_rewrite_context") if n in given}
    fields |= texts(given, "query_rewrite_extra_constraints", "prompt_extra_rules", "prompt_extra_formats")
    expansions = tuple(Expansion(r["text"], **texts(r, "any_terms", "all_terms")) for r in given.get("expansion_rules", []))
    focus = tuple(Focus(**texts(r, "any_terms", "filename_contains")) for r in given.get("technical_focus_rules", []))
    pairs = lambda x: tuple((k, v) for k, v in (x.items() if isinstance(x, dict) else x or ()))
    boosts = tuple(Boost(**texts(r, "any_terms", "all_terms", "count_terms"), **{n: pairs(r.get(n)) for n in ("count_bonus", "file_bonus", "text_bonus")}) for r in given.get("boost_rules", []))
    fields |= {"boost_rules": boosts, "mention_patterns": pairs(given.get("mention_patterns"))}
    return Profile(given["name"], **({"display_name": given["name"]} | fields), expansion_rules=expansions, technical_focus_rules=focus)


def load(spark: SparkSession, folder: str, name: str | None) -> Profile:
    """The profile of <folder>/<name>.json; the generic one for its names, no name and unknown ones."""
    name = (name or "").strip().lower()
    path = f"{folder}/{name}.json"
    if name in GENERIC_NAMES or not exists(spark, path):
        return GENERIC
    return from_json(spark.read.option("wholetext", True).text(path).first()[0])


def available(spark: SparkSession, folder: str) -> Sequence[str]:
    """Names that load() knows, in order."""
    names = {GENERIC.name}
    if exists(spark, folder):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = (s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
        names |= {n.removesuffix(".json") for n in found if n.endswith(".json")}
    return sorted(names)
