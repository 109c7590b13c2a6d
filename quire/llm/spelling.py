"""Spelling variants of a corpus's words by a rare-first q-gram prefix filter.

Bigrams are put in one order by frequency, then text, then position. An edit destroys two bigrams of a word at most, so of two
words one edit apart both keep, among their three rarest, the rarest bigram that the edit leaves alone. It stands either
before the edit, and then all before it is equal, or after it, and then all after it is equal. So the join's key is a hash of such a
bigram with the whole side of the word that ends or begins with it, which fixes its position from that side, and of the length,
equal or one more. Inside the join a pair must also agree on one half of the rest, by its hash, and at last one edit of distance
is verified on the words. All of this is Column expressions; nothing else than the bigrams' order (the alphabet squared) is
sent to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, ready

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
ALPHABET = 26 + 64
"""a-z, then U+00C0 to U+00FF."""
LEAST, TIMES, RARE, NOISE = 7, 10, 3, 31
"""Code points of a word at least; how many times more often its form occurs; bigrams joined; one run in so many is misspelt."""


def words(df: DataFrame, key: str, text: str, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """(word, n) of the runs of letters in all texts, with at least `least` code points and two occurrences.

    Only A-Z are lower-cased. Where `noise` divides the CRC-32 of `<key>:<run>`, the run loses the code point at that number
    modulo its length. Runs that are too short to end as words are not even read.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode_outer(runs).alias("_run"))  # a plain explode would match twice, in a pushed filter
    rows = rows.where(F.col("_run").isNotNull()).withColumn("_run", F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", UPPER, LOWER)).otherwise(F.col("_run")))
    rows = rows.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut_out = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    rows = rows.select(F.when(F.col("_h") % noise == 0, cut_out).otherwise(F.col("_run")).alias("word"))
    return rows.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def _bigrams(word: Column) -> Column:
    """The number of each bigram of a word, in order."""
    letter = lambda i: F.ascii(F.substring(word, i, F.lit(1)))
    number = lambda c: F.when(c < 128, c - ord("a")).otherwise(c - 0xC0 + 26)
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: number(letter(i)) * ALPHABET + number(letter(i + 1)))


def _rare(vocabulary: DataFrame) -> DataFrame:
    """(word, n, at): where each word's three rarest bigrams begin, from 1."""
    graded = vocabulary.withColumn("_grams", _bigrams(F.col("word")))
    counts = graded.select(F.explode_outer("_grams").alias("g")).groupBy("g").count().orderBy("count", "g").select("g").collect()  # at most 90 x 90
    place = [0] * (ALPHABET * ALPHABET)
    for k, r in enumerate(counts):
        place[r.g] = k
    order = F.lit(place)
    rare = F.slice(F.array_sort(F.transform("_grams", lambda g, i: F.struct(F.get(order, g).alias("rank"), (i + 1).alias("at")))), 1, RARE)
    return graded.select("word", "n", F.explode_outer(rare).alias("_r")).select("word", "n", F.col("_r.at").alias("at"))


def _side(longer: bool) -> Column:
    """For each side of a bigram and each length of a partner (equal; or one more, or one less if `longer`): the key, and hashes of two halves of the rest.

    The edit is in the rest, so the halves before or those behind the middle of the shorter word's rest are equal too.
    """
    size, at = F.char_length("word"), F.col("at")
    out = []
    for side, piece, begin, length in ((0, F.substring("word", F.lit(1), at + 1), at + 2, size - at - 1), (1, F.substring("word", at, size), F.lit(1), at - 1)):
        for other in (0, 1):
            short = length - other if longer else length  # of the shorter word's rest
            half = F.floor(short / 2).cast("int")
            head, tail = F.substring("word", begin, half), F.substring("word", begin + length - (short - half), short - half)
            key = F.xxhash64(F.lit(2 * side + other), piece, size - other if longer else size)
            out.append(F.when(short >= 0, F.struct(key.alias("key"), F.hash(head).alias("head"), F.hash(tail).alias("tail"), F.lit(other == 0).alias("equal"))))
    return F.array(*out)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words (word, n) that one inserted, deleted or replaced code point turns into each other."""
    rare = cut(_rare(vocabulary), "bigrams")
    one = rare.select("word", "n", F.explode_outer(_side(False)).alias("x")).select("word", "n", "x.*")
    other = rare.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode_outer(_side(True)).alias("x")).where("x is not null").select("near", "near_n", F.col("x.key").alias("key"), F.col("x.head").alias("near_head"), F.col("x.tail").alias("near_tail"))
    halves = (F.col("head") == F.col("near_head")) | (F.col("tail") == F.col("near_tail"))
    sound = halves & (~F.col("equal") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1)
    pairs = cut(one.join(other, "key").where(sound).select("word", "n", "near", "near_n").distinct(), "near")
    discard(rare)
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), back)).alias("_p")).select("_p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the chain. n grows tenfold at each step, so chains are short; each round doubles the steps."""
    roots = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, roots = roots, cut(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
    return roots.select("word", "root")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a corpus.

    A word's form is its near word of largest n (the first in code-point order of equal ones) if that is at least `times` its
    own n. A null text has no words; a null key reads as an empty string before the colon; rows that share a key are texts of
    their own. Words may be of any length. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    ready(df)
    found = cut(words(df.select(F.col(key).alias("_doc"), F.col(text).alias("_text")), "_doc", "_text", least, noise), "words")
    best = near_words(found).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("_b"))
    fits = -F.col("_b.m") >= times * F.col("n")
    best = cut(best.select("word", "n_near", F.when(fits, F.col("_b.w")).alias("form"), F.when(fits, -F.col("_b.m")).alias("form_n")), "forms")
    out = found.join(best, "word", "left").join(_roots(best.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
