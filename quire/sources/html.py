"""Web pages: HTML to text and title, in one pass over each page in Arrow batches.

The reader follows the rules of lenient HTML parsers: comments and declarations are no text, a quoted value may hold `>`,
scripts and styles are raw up to their own end tag, and elements are kept on a stack, so that an end tag closes what was left
open inside, and an element that is dropped ends with its parent even if nobody closed it.
"""

from __future__ import annotations

import json
import re
from functools import cache
from html import unescape as plain_unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import col, domain_allowed
from ..session import ready

# Elements dropped with all they hold.
DROPPED = ("script", "style", "noscript", "svg", "header", "footer", "nav")


@cache
def _references() -> tuple[str, str]:
    """Named character references as JSON, and a pattern of those that need no semicolon, longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps({f"&{n}": text for n, text in html5.items()}), f"&(?:{'|'.join(bare)})"


def _numbered(reference: Column) -> Column:
    """The character of &#...; numbers that stand for none give U+FFFD, controls nothing, and 128 to 159 are read as Windows-1252."""
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    n = F.when(F.length(digits) > 7, "0").when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.nullif(digits, F.lit("")))
    n = F.coalesce(n.cast("long"), F.lit(0))
    western = [bytes([k]).decode("cp1252", "replace").replace("�", chr(k)) for k in range(0x80, 0xA0)]
    windows = F.get(F.array(*map(F.lit, western)), (n - 0x80).cast("int"))
    dropped = n.between(1, 8) | n.between(0xE, 0x1F) | n.isin(0xB, 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(n.between(0x80, 0x9F), windows).when(dropped, "").otherwise(char)


def _named(reference: Column) -> Column:
    """A named reference's text. An unknown name may begin with one that needs no semicolon; otherwise it stays."""
    table, bare = _references()
    known = lambda name: F.try_element_at(F.from_json(F.lit(table), "map<string,string>"), name)
    head = F.regexp_extract(reference, f"^{bare}", 0)
    return F.coalesce(known(reference), F.concat(known(head), F.substr(reference, F.length(head) + 1)), reference)


def unescape(x: Column) -> Column:
    """Character references replaced, named and numbered ones."""
    pieces = F.regexp_extract_all(x, F.lit(f"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;|{_references()[1]}|[^&]+|&"), F.lit(0))
    one = lambda p: F.when(p.rlike("^&#[xX0-9]"), _numbered(p)).when(p.startswith("&"), _named(p)).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


_TAG = re.compile(
    r"<(?:"
    r"!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment
    r"|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)"  # a declaration
    r"|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|/(?:[^a-zA-Z>][^>]*)?>"  # an end tag, or nothing
    r"""|(?P<start>[a-zA-Z][^\s/>]*)(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+(?:>|\Z)"""
    r")",
    re.DOTALL,
)
_RAW, _TEXT_ONLY = ("script", "style"), ("title", "textarea")
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def closed_unescape(x: str) -> str:
    """Character references that end with a semicolon replaced; what lacks it, or names nothing, stays as it is."""
    return _CLOSED.sub(lambda m: plain_unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], x)


def read_html(html: str, bare: bool = True) -> tuple[str, str]:
    """(title, text): the runs of text outside dropped elements, with single spaces, and those of the first title.

    bare: whether references without a semicolon count, as in browsers; without it they stay, so that a text that was cut inside one keeps its end.
    """
    unescaped = plain_unescape if bare else closed_unescape
    out: list[str] = []
    held: list[str] = []
    stack: list[str] = []
    inside, title, begin, pos = 0, None, None, 0  # dropped elements that are open; where the title's runs begin

    def flush() -> None:
        run = " ".join(unescaped("".join(held)).split())
        held.clear()
        if run and not inside:
            out.append(run)

    while pos < len(html):
        at = html.find("<", pos)
        if at < 0:
            held.append(html[pos:])
            break
        held.append(html[pos:at])
        found = _TAG.match(html, at)
        if not found:  # a mere sign
            held.append("<")
            pos = at + 1
            continue
        flush()
        pos, start, end = found.end(), found["start"], found["end"]
        if start:
            name = start.lower()
            closed = html.endswith("/>", at, pos) or name in _VOID
            if not closed:
                stack.append(name)
                inside += name in DROPPED
                if name == "title" and title is None and begin is None and not inside:
                    begin = len(out)
                if name in _RAW or name in _TEXT_ONLY:
                    last = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, pos)
                    if name in _TEXT_ONLY:
                        held.append(html[pos : last.start() if last else len(html)])
                    pos = last.start() if last else len(html)
        elif end and (name := end.lower()) in stack:
            while True:
                gone = stack.pop()
                inside -= gone in DROPPED
                if gone == "title" and begin is not None and title is None:
                    title = " ".join(out[begin:])
                if gone == name:
                    break
    flush()
    if begin is not None and title is None:
        title = " ".join(out[begin:])
    return title or "", " ".join(out)


@cache
def _reader(bare: bool):
    @F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else read_html(x, bare) for x in html], columns=["title", "text"])

    return run


def html_text(html: Column | str, bare: bool = True) -> Column:
    """The page's text: comments, dropped elements and tags removed, character references replaced (bare ones too, if wanted), with single spaces. Null stays null."""
    return _reader(bare)(col(html))["text"]


def html_title(html: Column | str, url: Column | str, bare: bool = True) -> Column:
    """The title, or the address if there is none. Beside html_text a page is read once for both."""
    return F.coalesce(F.nullif(_reader(bare)(col(html))["title"], F.lit("")), col(url))


def web_pages(pages: DataFrame, fetched_on: str, domains: tuple[str, ...] | None = None, bare: bool = True) -> DataFrame:
    """(url, file, title, text, page 0, source_type, fetched_on) of fetched pages (url, html); only allowed domains if given."""
    rows = ready(pages) if domains is None else ready(pages).where(domain_allowed("url", domains))
    title = html_title("html", "url", bare)
    return rows.select("url", title.alias("file"), title.alias("title"), html_text("html", bare).alias("text"), F.lit(0).alias("page"), F.lit("web").alias("source_type"), F.lit(fetched_on).cast("date").alias("fetched_on"))
