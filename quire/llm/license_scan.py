"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Phrases are matched on the normalised words of the whole text (lower-cased A-Z, joined by one space), so that line breaks and
punctuation do not matter. An SPDX identifier tag is found in the text itself; the expression after it is parsed with
WITH above AND above OR, and judged: AND is as strict as its strictest part, OR as its least strict, WITH an exception one step milder.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import free_name, lean, ready, slices

# Notice phrases and the labels they stand for.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "isc license": "isc", "creative commons attribution": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "all rights reserved": "proprietary", "public domain": "public-domain", "the unlicense": "unlicense",
}
TAG = "spdx-license-identifier:"
# How strict the families of identifiers are, from 0 (permissive) to 3 (closed).
STRICT = {"mit": 0, "apache": 0, "bsd": 0, "isc": 0, "cc0": 0, "unlicense": 0, "zlib": 0, "cc-by": 0, "mpl": 1, "lgpl": 1, "epl": 1, "cc-by-sa": 2, "gpl": 2, "agpl": 2, "cc-by-nc": 3, "cc-by-nd": 3, "proprietary": 3}
_WORD = re.compile(r"\(|\)|[^\s()]+")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of an identifier: its longest known family, else itself."""
    name = identifier.lower().removesuffix("+")
    return max((f for f in STRICT if name == f or name.startswith(f + "-")), key=len, default=name)


def postfix(text: str) -> list[str]:
    """An expression in postfix order by the shunting-yard method; reads as far as the text is an expression."""
    return _parse(text)[0]


def _parse(text: str) -> tuple[list[str], bool]:
    """The postfix order, and whether text that is added at the end could change it."""
    more = True
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for found in _WORD.finditer(text):
        token, more = found.group(), found.end() == len(text)
        low = token.lower()
        if operand and token == "(":
            stack.append(token)
        elif operand and low not in _RANK and token != ")" and _IDENTIFIER.fullmatch(token.rstrip(".,;")):
            out.append(token.rstrip(".,;"))
            operand = False
            if token[-1] in ".,;":
                break
        elif not operand and low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif not operand and token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    else:
        more = True
    if operand and stack and stack[-1] in _RANK:
        stack.pop()  # a dangling operator
    return out + [x for x in reversed(stack) if x != "("], more


def expression(text: bytes, begin: int) -> list[str]:
    """The expression from a place to the end of its line, in postfix order; decodes no more than about twice what it needs."""
    end, size = text.find(b"\n", begin), 4096
    end = len(text) if end < 0 else end
    while True:
        tokens, more = _parse(text[begin : min(end, begin + size)].decode("utf-8", "replace"))
        if not more or begin + size >= end:
            return tokens
        size *= 2


def evaluate(tokens: list[str]) -> tuple[set[str], float | None]:
    """The labels named in a postfix expression and how strict it is (0 to 3; None if nothing in it is known)."""
    stack: list[tuple[set[str], float | None]] = []
    for t in tokens:
        if t not in _RANK:
            stack.append(({family(t)}, STRICT.get(family(t))))
        elif len(stack) > 1:
            (b, y), (a, x) = stack.pop(), stack.pop()
            known = [v for v in (x, y) if v is not None]
            if t == "with":
                stack.append((a, None if x is None else max(0, x - 1)))
            else:
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a |= b
                stack.append((a, (max if t == "and" else min)(known) if known else None))
    labels = set().union(*(s for s, _ in stack))
    return labels, stack[-1][1] if stack else None


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**MORE, **BASE}.items():
        phrases.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    tags.add_word(TAG, True)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in W.NOT_ALNUM else b for b in range(256))


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, strictness of one text."""
    phrases, tags = _automata()
    words = text.translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    line = b" " + b" ".join(words) + b" "
    places, base, labels, covered, starts = [], set(), set(), 0, None
    for end, (phrase, label, is_base) in phrases.iter(line.decode("latin-1")):
        labels.add(label)
        covered += phrase.count(" ") + 1
        if is_base:
            starts = starts or list(accumulate((len(w) + 1 for w in words), initial=1))
            places.append(bisect_left(starts, end - len(phrase)))
            base.add(label)
    expressions, strict = [], None
    for end, _ in tags.iter(text.lower().decode("latin-1")) if b"SPDX" in text or b"spdx" in text.lower() else ():
        tokens = expression(text, end + 1)
        found, level = evaluate(tokens)
        if tokens:
            labels |= found
            covered += 3 + len(tokens)
            expressions.append(" ".join(tokens))
            strict = level if strict is None else max(strict, level or 0)
    share = min(1.0, covered / len(words)) if words else 0.0
    score = 0.0 if not labels else 1.0 if expressions else 0.5 + 0.5 * share
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, strict)


_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "strictness")
_TYPES = ("long", "long", "long", "long", "string", "string", "double", "array<string>", "double")


def scan_licenses(df: DataFrame, text: str = "text", chunk_bytes: int = 1 << 20) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels, score, expressions (postfix) and strictness.

    A null text counts as empty: no words, no labels (""), null places and strictness, score 0. score is 0 without a label,
    1 with a parsed identifier tag, else between 0.5 and 1 by the share of words that belong to notices. Overlapping phrases
    all count. Other columns pass through; added columns that clash get an underscore. An empty table gives an empty result.
    """
    ready(df)
    names = [free_name(df.columns, x) for x in _NAMES]
    schema = df.withColumns({n: F.lit(None).cast(t) for n, t in zip(names, _TYPES, strict=True)}).schema
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, chunk_bytes):
                found = zip(*map(scan, W.utf8(part.column(part.schema.get_field_index(text)))), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=[*part.schema.names, *names])

    return df.mapInArrow(lean(run), schema)
