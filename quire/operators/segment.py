"""Text segmentation: sentences, packed chunks, sections, technical windows, table Markdown.

All but the chunk packer, a sequential fold, are Column expressions and windows. Rows are exploded with the outer forms: for
the others Spark puts a filter on the array's size below, and works the whole array out again for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import BOILERPLATE_LINES, EXTRACT_PREFIX, TITLE_PREFIX, TITLE_UNIT, VALUE_PATTERN
from ..functions.text import col, squash
from ..session import ready


def sentences(x: Column | str) -> Column:
    return F.split(squash(x), r"(?<=[.!?])\s+")


def hard_split(x: Column | str, size: int) -> Column:
    """Slices of `size` characters; an empty text has none."""
    x = col(x)
    count = F.ceil(F.length(x) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(x, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def pack(sentences_: list[str], size: int, overlap: int) -> list[str]:
    """Packs sentences into chunks. A buffer is always a run of consecutive sentences: its start and its length are the state."""
    out: list[str] = []
    sizes = [len(x) for x in sentences_]
    start = length = 0  # of the buffer; length 0 means none

    def flush(end: int) -> None:
        if length:
            out.append(" ".join(sentences_[start:end]))

    for i, n in enumerate(sizes):
        if n > size:
            flush(i)
            out.extend(sentences_[i][k : k + size] for k in range(0, n, size))
            length = 0
        elif not length:
            start, length = i, n
        elif length + 1 + n <= size:
            length += 1 + n
        else:
            flush(i)
            begin = max(start, i - overlap)
            carried = sum(sizes[begin:i]) + i - begin
            while begin < i and carried + n > size:
                carried -= sizes[begin] + 1
                begin += 1
            start, length = begin, carried + n
    flush(len(sizes))
    return [x for x in out if x.strip()]


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@cache
def _packer(size: int, overlap: int):
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        flat = [None if t is None else " ".join(t.split()) for t in texts]
        return pd.Series([None if t is None else [t] if len(t) <= size else pack([s for s in _SENTENCE_END.split(t) if s], size, overlap) for t in flat])

    return run


def pack_sentences(df: DataFrame, text: str, size: int = 800, overlap: int = 2, out: str = "chunks") -> DataFrame:
    """df with an array of chunks of at most `size` characters; up to `overlap` sentences are repeated at each start.

    0 means the default for both. A text that fits is one chunk, even an empty one; null stays null. A sentence that is too long is sliced,
    and nothing is carried over it. The fold is sequential, so it runs in an Arrow UDF; as a SQL aggregate it took minutes where this takes seconds.
    """
    return ready(df).withColumn(out, _packer(size or 800, overlap or 2)(F.col(text)))


def chunks(df: DataFrame, text: str, size: int = 800, overlap: int = 2) -> DataFrame:
    """One row a chunk: df's columns with pos (from 0) and chunk."""
    packed = pack_sentences(df, text, size, overlap, out="_chunks")
    return packed.select(*df.columns, F.posexplode_outer("_chunks").alias("pos", "chunk")).where("chunk is not null")  # the plain form would pack twice, in a pushed filter


def lines(x: Column | str) -> Column:
    """Lines as str.splitlines has them: all Unicode line breaks end one, and a final break opens none."""
    x = F.regexp_replace(F.regexp_replace(col(x), "\r\n", "\n"), "[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    return F.split(F.regexp_replace(x, r"\n\z", ""), "\n")


def is_boilerplate(line: Column | str, exact: Iterable[str] = BOILERPLATE_LINES) -> Column:
    low = F.lower(col(line))
    return low.isin(*exact) | low.startswith("©") | F.contains(low, F.lit("all rights reserved"))


def is_title(line: Column | str, after_blank: Column | str) -> Column:
    """Whether a squashed line looks like a section title."""
    line, after_blank = col(line), col(after_blank)
    words = F.size(F.split(line, " "))
    letters, capitals = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    never = ~F.length(line).between(4, 90) | line.rlike(r"^(\||- |\* |• )") | line.rlike(f"(?i){TITLE_UNIT}") | (words > 12) | (letters < 3)
    return (
        F.when(never, False)
        .when(line.rlike(r"^\d+(\.\d+)*\s+\S+"), True)
        .when((capitals > 0.65 * letters) & (words <= 10), True)
        .otherwise(after_blank & ~line.rlike(r"[.!?;:]$") & (words <= 9))
    )


def _marked(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, the text and `_lines`: its non-blank, non-boilerplate lines as (line_no, line, title). A text's lines stay in its row."""
    numbered = F.transform(lines(text), lambda x, i: F.struct(i.alias("line_no"), squash(x).alias("line")))
    rows = df.select(*key, F.col(text).alias("_text"), F.filter(numbered, lambda r: ~is_boilerplate(r["line"])).alias("_all"))
    after_blank = lambda i: (i == 0) | (F.get("_all", i - 1)["line"] == "")
    judged = F.transform("_all", lambda r, i: F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), ((r["line"] != "") & is_title(r["line"], after_blank(i))).alias("title")))
    return rows.select(*key, "_text", F.filter(judged, lambda r: r["line"] != "").alias("_lines"))


def title_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Non-blank, non-boilerplate lines: key, line_no (from 0), line, title (whether it is one)."""
    return _marked(df, key, text).select(*key, F.explode_outer("_lines").alias("_x")).where("_x is not null").select(*key, "_x.*")


def sections(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, pos (from 0), title (empty if none), body. A title without a body goes; a text without sections is one, squashed."""
    titles = F.filter(F.transform("_lines", lambda r, i: F.when(r["title"], i)), lambda i: i.isNotNull())
    rows = _marked(df, key, text).withColumn("_starts", F.concat(F.array(F.lit(-1)), titles))
    until = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
    body = lambda s, k: F.array_join(F.transform(F.slice("_lines", s + 2, until(k) - s - 1), lambda r: r["line"]), " ")
    parts = F.transform("_starts", lambda s, k: F.struct(F.coalesce(F.get("_lines", s)["line"], F.lit("")).alias("title"), body(s, k).alias("body")))
    rows = rows.select(*key, "_text", F.filter(parts, lambda x: x["body"] != "").alias("_parts"))
    whole = F.array(F.struct(F.lit("").alias("title"), squash("_text").alias("body")))
    found = F.when(F.size("_parts") > 0, F.col("_parts")).when(squash("_text") != "", whole)
    return rows.select(*key, F.posexplode_outer(found).alias("pos", "_x")).where("_x is not null").select(*key, "pos", "_x.*")


def clean_title(x: Column | str) -> Column:
    return F.rtrim(F.substring(squash(x), 1, 90))


def section_chunks(df: DataFrame, key: list[str], text: str, size: int = 800, overlap: int = 2) -> DataFrame:
    """key, section, pos, title, chunk: sections packed one by one, each chunk after its section's title."""
    found = chunks(sections(df, key, text).withColumnRenamed("pos", "section").withColumn("title", clean_title("title")), "body", size, overlap)
    text_ = F.when(F.col("title") != "", F.concat(F.lit(TITLE_PREFIX), "title", F.lit("\n\n"), "chunk")).otherwise(F.col("chunk"))
    return found.select(*key, "section", "pos", "title", text_.alias("chunk"))


def technical_windows(df: DataFrame, key: list[str], text: str, page: Column | str, pattern: str = VALUE_PATTERN, before: int = 4, after: int = 3, most: int = 4, least: int = 80) -> DataFrame:
    """key, window_no (from 1), excerpt: merged windows around lines that match; needs two such lines; the first `most`, short ones dropped but numbered."""
    rows = df.select(*key, col(page).alias("_page"), F.posexplode_outer(F.filter(F.transform(lines(text), squash), lambda x: x != "")).alias("i", "line")).where("line is not null")
    whole, order = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("i")
    hits = rows.withColumn("n_lines", F.count("*").over(whole)).where(F.col("line").rlike(f"(?iu){pattern}")).withColumn("hits", F.count("*").over(whole)).where("hits >= 2")
    step = F.col("i") - F.lag("i").over(order)
    hits = hits.withColumn("window_no", F.sum(F.coalesce((step > before + after).cast("int"), F.lit(1))).over(order)).where(F.col("window_no") <= most)
    spans = hits.groupBy(*key, "window_no").agg(F.greatest(F.lit(0), F.min("i") - before).alias("a"), F.least(F.max("n_lines"), F.max("i") + after).alias("b"))
    body = rows.join(spans, key).where("i >= a and i < b").groupBy(*key, "_page", "window_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit(EXTRACT_PREFIX), F.col("_page").cast("string"), F.lit(", bloc "), F.col("window_no").cast("string"), F.lit("\n\n"), "body")
    return body.where(F.length("body") >= least).select(*key, "window_no", head.alias("excerpt"))


def table_markdown(rows: Column | str) -> Column:
    """An array of rows of cells as a Markdown table; empty rows go, ragged ones are filled, fewer than two rows give ''."""
    clean = F.filter(F.transform(col(rows), lambda r: F.transform(r, lambda c: squash(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    full = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.concat(F.array(bar(full[0]), bar(F.array_repeat(F.lit("---"), width))), F.transform(F.slice(full, 2, F.size(full)), bar))
    return F.when(F.size(clean) >= 2, F.array_join(body, "\n")).otherwise(F.lit(""))
