"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet as log odds: the text (naive Bayes over hashed character trigrams), the language that the
markup declares, the address (its suffix and a language code in its path), and a prior of the host. Host priors come from
grouped aggregation of the first three over all rows, smoothed towards the host's parent domain and that towards the whole.
The text model is fitted on a bounded sample of labelled rows; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, free_name, lean, ready, slices, small

BUCKETS = 1 << 15
FIT_ROWS = 6000
"""Labelled rows that the text model is fitted on at most; the sample is by hash, so it is spread over the table."""
DECLARED, ADDRESS, HOST_WEIGHT, LEAST = 3.0, 1.5, 20.0, 0.5
"""Log odds of a declared language and of an address hint, pseudo-rows of a parent in a host's prior, least posterior to keep a row."""
# Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts (bytes; A-Z lowered; a space at either end; runs of what is no letter as one space) and where each text's begin."""
    table = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
    buffer = np.frombuffer(b" " + b"  ".join(texts).translate(table) + b" ", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 2 for x in texts], out=at[1:])
    space = buffer == 0x20
    keep = ~(space & np.concatenate([[False], space[:-1]]))
    keep[at[:-1]] = True
    first = np.concatenate([[0], np.cumsum(keep)])[at]
    codes = buffer[keep].astype(np.uint32)
    grams = np.zeros(len(codes), np.uint32)
    grams[:-2] = codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]
    # The last two places of a text have no trigram of their own.
    whole = np.ones(len(codes), bool)
    for back in (1, 2):
        whole[np.maximum(first[1:] - back, first[:-1])] = False
    return ((grams[whole] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), np.concatenate([[0], np.cumsum(whole)])[first]


def _letters(texts: list[bytes]) -> list[int]:
    drop = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
    return [len(x.translate(None, drop)) for x in texts]


class TextModel:
    """Log likelihood ratios of trigrams against their mean over the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        """counts: languages x BUCKETS."""
        self.languages = languages
        rates = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        logs = np.log(rates)
        self.weights = np.ascontiguousarray((logs - (logs.mean(axis=0) if len(logs) else 0)).T.astype(np.float32))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Texts x languages. Trigrams are not independent, so the evidence of n of them counts as that of 4 sqrt(n), or n if less."""
        grams, first = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            sums = np.stack([np.add.reduceat(self.weights[grams, k], first[:-1][full], dtype=np.float64) for k in range(len(self.languages))], axis=1)
            n = np.diff(first)[full]
            out[full] = sums * np.minimum(1, 4 / np.sqrt(n))[:, None]
        return out


def fit(df: DataFrame, text: str, label: str, rows: int = FIT_ROWS) -> TextModel:
    """A model of the labels of at most `rows` rows of df. Their counts, at most one row a language and bucket, come to the driver."""
    ready(df)
    labelled = df.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    # The sample is the texts with the smallest hashes. Only hashes meet in one task; equal texts count once.
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    bound = hashed.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(bound).cast("long")).groupBy("h", "text").agg(F.min("label").alias("label")).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                grams, first = trigrams(W.utf8(part.column(0)))
                names, index = np.unique(np.array(part.column(1).to_pylist(), object), return_inverse=True)
                keys, n = np.unique(np.repeat(index, np.diff(first)) * BUCKETS + grams[: first[-1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[keys // BUCKETS].tolist(), pa.string()), pa.array(keys % BUCKETS, pa.int64()), pa.array(n, pa.int64())], names=["label", "bucket", "n"])

    found = sample.repartition(8).mapInArrow(lean(count), "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["label"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, found["label"].to_numpy(str)) if languages else [], found["bucket"]] = found["n"]
    return TextModel(languages, counts)


def _points(languages: list[str], said, weight: float):
    """The log odds that a language code column gives each language; none if it is null or unknown."""
    code = F.lower(F.substring_index(F.substring_index(said, "-", 1), "_", 1))
    return F.array(*(F.coalesce(F.when(code == x, F.lit(weight)), F.lit(0.0)) for x in languages))


def _add(*arrays):
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def _softmax(scores):
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def identify(df: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, url: str | None = None, host: str | None = None, accepted: list[str] | None = None, least: float = LEAST, min_letters: int = 1, keep_text: bool = True) -> DataFrame:
    """df with language, confidence and accepted.

    declared, url and host name optional columns; without `host` the url's host is used. A row is accepted if its text has at
    least `min_letters` letters, its language is among the accepted ones (all of the model's if not given) and the posterior
    is at least `least`. Null or empty texts give no evidence: the others decide, but the row is not accepted. A
    model without languages gives null and accepts nothing. Rows with a null host share no prior. Ties go to the first
    language by name. Other columns pass through (the text only if `keep_text`); added columns that clash get an underscore.
    An empty table stays empty. With hosts, the scored rows are written to the shared folder once, and read for the priors and
    for the result.
    """
    ready(df)
    names = [free_name(df.columns, x) for x in ("language", "confidence", "accepted")]
    languages = model.languages
    columns = [c for c in df.columns if keep_text or c != text]
    if not languages:
        return df.select(*columns).withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(0.0), names[2]: F.lit(False)})
    scores, letters, home, parent, prior = (free_name([*df.columns, *names], x) for x in ("_scores", "_letters", "_host", "_parent", "_prior"))
    schema = df.withColumns({scores: F.array(F.lit(0.0)), letters: F.lit(0)}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 19):
                texts = W.utf8(part.column(part.schema.get_field_index(text)))
                found = model.score(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(languages)), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(_letters(texts), pa.int32())], names=[*part.schema.names, scores, letters])

    def evidence() -> DataFrame:
        out = df.mapInArrow(lean(score), schema).select(*columns, scores, letters)
        parts = [F.col(scores)]
        if declared:
            parts.append(_points(languages, F.col(declared), DECLARED))
        if url:
            site = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
            suffix = F.substring_index(site, ".", -1)
            known = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
            parts += [_points(languages, F.try_element_at(known, suffix), ADDRESS), _points(languages, F.regexp_extract(F.col(url), r"^[^?#]*?://[^/?#]+/([a-zA-Z]{2})(?:[-_/.?#]|$)", 1), ADDRESS)]
        out = out.withColumn(scores, _add(*parts))
        if host or url:
            at = F.lower(F.col(host)) if host else F.nullif(site, F.lit(""))
            out = out.withColumn(home, at).withColumn(parent, F.coalesce(F.substring_index(at, ".", -2), F.lit("")))
        return out

    out = evidence()
    total = F.col(scores)
    if host or url:
        out = cut(out, "scored")
        soft = out.where(F.col(home).isNotNull()).select(F.col(home).alias("home"), F.col(parent).alias("parent"), _softmax(F.col(scores)).alias("posterior"))
        priors = small(cut(host_priors(soft, languages), "priors"), 200_000)
        out = out.join(priors.select(F.col("home").alias(home), F.col("prior").alias(prior)), home, "left")
        total = _add(F.col(scores), F.coalesce(prior, F.array(*(F.lit(0.0) for _ in languages))))
    out = out.withColumn(scores, _softmax(total))
    which = F.array_position(scores, F.array_max(scores)).cast("int")
    out = out.withColumns({names[0]: F.element_at(F.array(*(F.lit(x) for x in languages)), which), names[1]: F.array_max(scores)})
    good = (F.col(letters) >= min_letters) & (F.col(names[1]) >= least) & F.col(names[0]).isin(accepted or languages)
    return out.withColumn(names[2], good).select(*columns, *names)


def host_priors(soft: DataFrame, languages: list[str]) -> DataFrame:
    """(home, prior): log prior over the mean of all hosts. A host's counts are smoothed by HOST_WEIGHT rows of its parent's rates, those by as many of the whole's."""
    sums = lambda prefix: [F.sum(F.col("posterior")[k]).alias(f"{prefix}{k}") for k in range(len(languages))]
    hosts = soft.groupBy("home", "parent").agg(*sums("h"), F.count("*").alias("rows"))
    up = hosts.groupBy("parent").agg(*(F.sum(f"h{k}").alias(f"p{k}") for k in range(len(languages))), F.sum("rows").alias("p_rows"))
    whole = up.agg(*(F.sum(f"p{k}").alias(f"w{k}") for k in range(len(languages))), F.sum("p_rows").alias("w_rows"))
    joined = hosts.join(up, "parent").join(F.broadcast(whole))  # one row
    prior = []
    for k in range(len(languages)):
        all_rate = (F.col(f"w{k}") + 1) / (F.col("w_rows") + len(languages))
        rate = (F.col(f"p{k}") + HOST_WEIGHT * all_rate) / (F.col("p_rows") + HOST_WEIGHT)
        prior.append(F.log((F.col(f"h{k}") + HOST_WEIGHT * rate) / (F.col("rows") + HOST_WEIGHT)))
    return joined.select("home", F.array(*prior).alias("prior"))
