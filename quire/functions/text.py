"""Scalar text functions as Column expressions, all on the JVM except the full Unicode fold."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import STOP_WORDS, TECHNICAL_HINTS, TRUE_WORDS, UNITS


@cache
def folds() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of characters in ASCII: of those that leave one character, and of those that leave more."""
    one, more = {}, {}
    for x in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.decomposition(x):
            plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
            if plain:
                (one if len(plain) == 1 else more)[x] = plain
    return one, more


def ranges(characters: Iterable[str]) -> str:
    """Characters as ranges of a regular expression's class."""
    codes = sorted(map(ord, characters))
    ends = [k for k in range(len(codes)) if k + 1 == len(codes) or codes[k + 1] != codes[k] + 1]
    return "".join(f"{chr(codes[a])}-{chr(codes[b])}" for a, b in zip([0, *(k + 1 for k in ends)], ends))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squash(x: Column | str) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"(?U)[\s\x1c-\x1f]+", " "))


def fold(x: Column | str) -> Column:
    """Compatibility decomposition of all of Unicode, what is not ASCII dropped, lower-cased. Plain ASCII texts skip the tables."""
    x, (one, more) = col(x), folds()
    long, may = ranges(more), ranges(c for c in more if c < "\u2000") + "\u2000-\U0010ffff"  # few ranges, tried first
    pieces, table = F.regexp_extract_all(x, F.lit(f"[{long}]|[^{long}]+"), F.lit(0)), F.from_json(F.lit(json.dumps(more)), "map<string,string>")
    whole = F.when(x.rlike(f"[{may}]"), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")).otherwise(x)
    plain = F.regexp_replace(F.translate(whole, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    return F.lower(F.when(x.rlike(r"[^\x00-\x7F]"), plain).otherwise(x))


@F.pandas_udf(StringType())
def fold_full(x: pd.Series) -> pd.Series:
    """The same as fold through the Unicode library, in an Arrow UDF."""
    return pd.Series([None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii").lower() for s in x])  # a text at a time, no copies of the whole batch


TOKEN_PATTERN = "[a-zA-Z0-9_/-]{3,}"


def tokens(x: Column | str) -> Column:
    """Runs of three or more letters, digits, _, / or - of the folded text."""
    return F.regexp_extract_all(fold(x), F.lit(TOKEN_PATTERN), F.lit(0))


def query_terms(x: Column | str) -> Column:
    """Distinct tokens that are no stop words, in order."""
    return F.array_except(tokens(x), F.array(*map(F.lit, STOP_WORDS)))


def token_overlap(query: Column | str, text: Column | str) -> Column:
    """The share of the query's terms that the text has; 0 without terms."""
    terms = query_terms(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(terms, tokens(text))), F.size(terms)), F.lit(0.0))


def upper(x: Column | str) -> Column:
    """Upper case letter by letter: one that would become several (ß, ligatures) stays, so that the lower case of it is the word's again."""
    return F.array_join(F.transform(F.split(col(x), ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def contains_any(x: Column | str, terms: Iterable[str]) -> Column:
    """Whether the lower-cased text has one of the terms (lower case) as a substring."""
    low = F.lower(col(x))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in terms), F.lit(False))


def contains_all(x: Column | str, terms: Iterable[str]) -> Column:
    low = F.lower(col(x))
    return reduce(lambda a, b: a & b, (F.contains(low, F.lit(t)) for t in terms), F.lit(True))


def count_terms(x: Column | str, terms: Iterable[str]) -> Column:
    """How many of the terms the lower-cased text has."""
    low = F.lower(col(x))
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def has_technical_value(x: Column | str) -> Column:
    """A digit anywhere and a unit as a substring anywhere."""
    return col(x).rlike(r"\d") & contains_any(x, UNITS)


def asks_technical(x: Column | str) -> Column:
    return contains_any(x, TECHNICAL_HINTS)


def asks_both(x: Column | str, first: Iterable[str], second: Iterable[str]) -> Column:
    """Intents that need a word of each of two lists (portfolio capacity, product inventories)."""
    return contains_any(x, first) & contains_any(x, second)


def cache_key(model: str, *parts: Column | str) -> Column:
    """SHA-256 of the model and the parts, joined by the zero character."""
    return F.sha2(F.concat_ws("\0", F.lit(model), *map(col, parts)), 256)


def estimate_tokens(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(x)) / 4)).cast("long")


def l2_normalise(v: Column | str) -> Column:
    """The vector divided by its length; a zero vector stays."""
    v = col(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def has_citation(x: Column | str) -> Column:
    return col(x).rlike(r"\[\d+\]")


def signed(x: Column | str, suffix: str = "") -> Column:
    """A delta with its sign and two decimals."""
    x = col(x)
    return F.format_string(f"%s%.2f{suffix}", F.when(x >= 0, "+").otherwise(""), x)


def json_ints(x: Column | str) -> Column:
    """The integers of the first JSON array in a text; other elements are dropped, true counts as 1, no array gives an empty list."""
    found = F.try_parse_json(F.regexp_extract(col(x), r"(?s)\[[^\]]*\]", 0))
    items = F.coalesce(F.transform(F.try_variant_get(found, "$", "array<variant>"), lambda e: F.when(F.schema_of_variant(e).isin("BIGINT", "BOOLEAN"), F.try_variant_get(e, "$", "int"))), F.array().cast("array<int>"))
    return F.filter(items, lambda e: e.isNotNull())


def domain_allowed(url: Column | str, domains: Iterable[str]) -> Column:
    """Whether the address's authority (lower case, without www.) is a listed domain or below one. An empty list allows nothing."""
    host = F.regexp_replace(F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    tests = [(host == d) | host.endswith("." + d) for d in (x.lower().removeprefix("www.") for x in domains)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def excerpt(x: Column | str, size: int = 700) -> Column:
    return F.substring(squash(x), 1, size)


def source_link(source_type: Column | str, url: Column | str, file: Column | str, page: Column | str, base: str = "/app/static/pdfs/") -> Column:
    """A web chunk's address, or a page link to the file; null without a file."""
    path = F.replace(F.url_encode(col(file)), F.lit("+"), F.lit("%20"))
    return F.when(col(source_type) == "web", col(url)).otherwise(F.concat(F.lit(base), path, F.lit("#page="), col(page).cast("string")))


def flag(x: Column | str, default: bool = False) -> Column:
    """parse_bool as a Column."""
    return F.coalesce(F.lower(squash(x)).isin(*TRUE_WORDS), F.lit(default))


def parse_bool(text: str | None, default: bool = False) -> bool:
    return default if text is None else text.strip().lower() in TRUE_WORDS
