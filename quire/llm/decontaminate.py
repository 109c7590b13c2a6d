"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every passage of every document (overlapping windows of words) is a query; all items whose score reaches a share of their
score for their own text are retrieved, and a hit stands if the document repeats enough of the item's question and
of its answer. An item longer than a passage is also indexed in pieces that fit in one wherever they begin, and any piece
retrieves it. Posting weights are divided by the own score of the item or piece, so one threshold serves all. Whole batches
of passages are first held against WAND's upper bounds at once; only those that could reach the threshold are searched.
The index is cut into slices of bounded size. A worker holds one slice at a time, and documents meet slice after slice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import free_name, lean, ready, slices

K1, B = 1.2, 0.75
PASSAGE, STRIDE, SHARE, OVERLAP, GRAM = 64, 32, 0.5, 0.6, 3
"""Words of a passage, words between passages, share of an item's own score to retrieve it, overlap of question and of answer, words of a compared n-gram."""
SLICE_BYTES, BLOCK, HELD_BYTES = 4 << 20, 64, 32 << 20
"""Item text that one index holds at most, postings of a block, document text that is held while it meets one index after another."""


def words(text: str | None) -> list[str]:
    buffer = (text or "").encode()
    w = W.words_of([buffer], W.NOT_ALNUM)
    return [w.buffer[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item up to its last sentence, and those of its last sentence (its last third if there is one sentence)."""
    whole = words(text)
    cut = max((text or "").rstrip().rstrip(".!?").rfind(x) for x in ".!?\n") + 1
    answer = len(words((text or "")[cut:])) if cut else -(-len(whole) // 3)
    return whole[: len(whole) - answer], whole[len(whole) - answer :]


def pieces(whole: list[str]) -> list[list[str]]:
    """The words of an item of more than PASSAGE words in even runs; each is inside some passage of a text that holds it. None for shorter items, as two passages cover them, so one has half of their score."""
    count = -(-len(whole) // min(STRIDE, PASSAGE - STRIDE)) if len(whole) > PASSAGE else 0
    return [whole[len(whole) * k // count : len(whole) * (k + 1) // count] for k in range(count)]


class Index:
    """Postings of units with block maxima. Units are the items in the order given, then the pieces of long items; owner has each unit's item."""

    def __init__(self, items: list[tuple[int, str]], count: int, mean: float, documents: dict[str, int]) -> None:
        """count, mean and documents (items that hold a word) are those of all items, whatever the slice."""
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        cut = [(k, piece) for k, (q, a) in enumerate(self.parts) for piece in pieces(q + a)]
        self.owner = [*range(len(items)), *(k for k, _ in cut)]
        bags = [*(Counter(q + a) for q, a in self.parts), *(Counter(piece) for _, piece in cut)]
        idf = {t: math.log(1 + (count - n + 0.5) / (n + 0.5)) for t, n in documents.items()}
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            size = sum(bag.values())
            weights = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in bag.items()}
            own = sum(weights.values())
            for t, w in weights.items():
                postings.setdefault(t, []).append((k, w / own))
        self.terms = sorted(postings)
        self.lists = [([k for k, _ in postings[t]], [w for _, w in postings[t]]) for t in self.terms]
        self.blocks = [([(max(ws[i : i + BLOCK]), ks[min(i + BLOCK, len(ks)) - 1]) for i in range(0, len(ks), BLOCK)]) for ks, ws in self.lists]
        self.most = [max(ws) for _, ws in self.lists]
        encoded = W.words_of([t.encode() for t in self.terms], W.NOT_ALNUM).hashes() if self.terms else np.zeros(0, np.uint64)
        order = np.argsort(encoded)
        self.keys, self.numbers = encoded[order], order

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings one after another: where each term's begin, their units, their weights."""
        first = np.concatenate([[0], np.cumsum([len(ks) for ks, _ in self.lists])]).astype(np.int64)
        return first, np.array([k for ks, _ in self.lists for k in ks], np.int64), np.array([w for _, ws in self.lists for w in ws])

    @cached_property
    def essential(self) -> tuple[np.ndarray, np.ndarray]:
        """Per posting: whether it is essential to its unit; per unit: what the others can give together.

        A unit's other terms are its most common ones (by posting list), as long as they give less than half of SHARE.
        """
        first, item, weight = self.pairs
        spread = np.repeat(np.diff(first), np.diff(first))
        order = np.lexsort((weight, -spread, item))
        sums = np.cumsum(weight[order])
        begin = np.searchsorted(item[order], np.arange(len(self.owner)))
        before = np.concatenate([[0], sums])[begin]
        inside = sums - before[item[order]]
        other = np.zeros(len(item), bool)
        other[order] = inside < SHARE / 2
        rest = np.bincount(item[other], weight[other], minlength=len(self.owner)) if len(item) else np.zeros(len(self.owner))
        return ~other, rest

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words that no item has."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.numbers[at], -1)

    def possible(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Which of n passages can reach SHARE for some unit: the essential terms' weights plus all that the others could add."""
        out = np.zeros(n, bool)
        if not len(term):
            return out
        first, item, weight = self.pairs
        keep, rest = self.essential
        sizes = np.diff(first)[term]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        posting = np.repeat(first[term] - edges[:-1], sizes) + np.arange(edges[-1])
        owner = np.repeat(passage, sizes)
        good = keep[posting]
        key, place = np.unique(owner[good] * len(self.owner) + item[posting[good]], return_inverse=True)
        total = np.bincount(place, weight[posting[good]], minlength=len(key)) + rest[key % len(self.owner)]
        out[key[total >= SHARE - 1e-9] // len(self.owner)] = True
        return out

    def search(self, terms: list[int], least: float = SHARE) -> list[tuple[int, float]]:
        """All (unit, score) with score >= least for a set of terms, by block-max WAND."""
        least -= 1e-9
        cursors = [[self.lists[t][0][0], 0, t] for t in set(terms)]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for n, (item, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = n
                    while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                        pivot += 1
                    break
            if pivot is None:
                break
            target = cursors[pivot][0]
            block, ends = 0.0, []
            for _, at, t in cursors[: pivot + 1]:
                k = at // BLOCK
                while k < len(self.blocks[t]) and self.blocks[t][k][1] < target:
                    k += 1
                if k < len(self.blocks[t]):
                    block += self.blocks[t][k][0]
                    ends.append(self.blocks[t][k][1])
            if block < least:
                # No item up to the nearest block end, or the next cursor, can do it.
                jump = min([e + 1 for e in ends] + [c[0] for c in cursors[pivot + 1 : pivot + 2]], default=target + 1)
                target = max(jump, target + 1)
            elif cursors[0][0] == target:
                score = sum(self.lists[t][1][at] for item, at, t in cursors if item == target)
                if score >= least:
                    found.append((target, score))
                target += 1
            for c in cursors[: pivot + 1]:
                items = self.lists[c[2]][0]
                at = c[1]
                while at < len(items) and items[at] < target:
                    k = at // BLOCK
                    at = (k + 1) * BLOCK if self.blocks[c[2]][k][1] < target else at + 1
                c[1] = at
                c[0] = items[at] if at < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def overlap(part: list[str], grams: dict[int, set], near: list[str]) -> float:
    """The share of a part's n-grams (of GRAM words, or all of a shorter part) in a text; 1 for an empty part."""
    if not part:
        return 1.0
    n = min(GRAM, len(part))
    if n not in grams:
        grams[n] = {tuple(near[i : i + n]) for i in range(len(near) - n + 1)}
    mine = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    return len(mine & grams[n]) / len(mine)


def _indexes(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    rows = items.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = rows.withColumn("w", F.array_remove(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""))
    total = split.where("size(w) > 0").agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"), F.sum(F.octet_length("text")).alias("bytes")).first()
    count = -(-(total["bytes"] or 0) // SLICE_BYTES)
    split = split.where("size(w) > 0").withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(max(count, 1))))
    documents = split.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    for k in range(count):
        # Skew of the hash aside, a slice holds SLICE_BYTES of text; its words are fewer than its bytes.
        mine = split.where(F.col("slice") == k)
        terms = documents.join(mine.select(F.explode("w").alias("t")).distinct(), "t", "left_semi").collect()
        yield Index(sorted((r["id"], r["text"]) for r in mine.where("id is not null").select("id", "text").collect()), total["n"], total["mean"], {r["t"]: r["n"] for r in terms})


def find_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", hits: str = "hits", chunk_bytes: int = 1 << 20) -> DataFrame:
    """df with `hits`: an array of (item_id, score, question_overlap, answer_overlap, first_word) by item, empty for clean rows.

    score is the best of the document's passages, for items of more than PASSAGE words that of their best piece. Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z.
    Null and empty texts have no hits; items without words or with a null key match nothing; repeated items each match.
    Other columns pass through; if `hits` is taken, it gets an underscore. Empty tables of either kind are fine.
    """
    spark = ready(df)
    name = free_name(df.columns, hits)
    hit = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,first_word:bigint>>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]))
    schema = df.withColumn(name, F.array().cast(hit)).schema

    def verify(index: Index, found: dict[int, dict[int, tuple[float, int]]], w: W.Words) -> dict[int, list]:
        out: dict[int, list] = {}
        for doc, by_item in found.items():
            a, b = w.first[doc], w.first[doc + 1]
            near = [w.buffer[x:y].decode() for x, y in zip(w.starts[a:b], w.ends[a:b], strict=True)]
            grams: dict[int, set] = {}
            for item, (score, at) in sorted(by_item.items()):
                q, ans = (overlap(p, grams, near) for p in index.parts[item])
                if q >= OVERLAP and ans >= OVERLAP:
                    out.setdefault(doc, []).append({"item_id": index.ids[item], "score": score, "question_overlap": q, "answer_overlap": ans, "first_word": at})
        return out

    def look(index: Index, texts: list[bytes]) -> dict[int, list]:
        """The hits of each text that has any."""
        w = W.words_of(texts, W.NOT_ALNUM)
        counts = w.counts()
        per = np.maximum(1, -(-(counts - PASSAGE) // STRIDE) + 1) * (counts > 0)
        base = np.concatenate([[0], np.cumsum(per)])
        n = int(base[-1])
        terms = index.lookup(w.hashes())
        hit_at = np.flatnonzero(terms >= 0)
        doc = np.searchsorted(w.first, hit_at, side="right") - 1
        # A word is in the passages that begin at (k * STRIDE) for k in [last - PASSAGE / STRIDE + 1, last].
        last = (hit_at - w.first[doc]) // STRIDE
        spots = [(last - k) for k in range(PASSAGE // STRIDE)]
        pairs = [(base[doc] + s, terms[hit_at]) for s in spots]
        ok = [(s >= 0) & (s < per[doc]) for s in spots]
        passage = np.concatenate([p[g] for (p, _), g in zip(pairs, ok, strict=True)])
        term = np.concatenate([t[g] for (_, t), g in zip(pairs, ok, strict=True)])
        both = np.unique(passage * max(1, len(index.terms)) + term) if len(term) else np.zeros(0, np.int64)
        passage, term = both // max(1, len(index.terms)), both % max(1, len(index.terms))
        edges = np.searchsorted(passage, np.arange(n + 1))
        found: dict[int, dict[int, tuple[float, int]]] = {}
        for p in np.flatnonzero(index.possible(passage, term, n)):
            d = int(np.searchsorted(base, p, side="right") - 1)
            for unit, score in index.search(term[edges[p] : edges[p + 1]].tolist()):
                item = index.owner[unit]
                old = found.setdefault(d, {}).get(item)
                if old is None or score > old[0]:
                    found[d][item] = (score, int(p - base[d]) * STRIDE)
        return verify(index, found, w)

    slices_of = [spark.sparkContext.broadcast(index) for index in _indexes(items, item_key, item_text)]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Parts of about `chunk_bytes`: one at a time for one index, more for several."""
        group, size = [], 0
        for batch in batches:
            for part in slices(batch, text, chunk_bytes):
                group.append(part)
                size += chunk_bytes
                if len(slices_of) == 1 or size >= HELD_BYTES:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in held(batches):
            texts = [W.utf8(part.column(part.schema.get_field_index(text))) for part in group]
            hits = [[[] for _ in range(part.num_rows)] for part in group]
            for handle in slices_of:
                index = handle.value
                for mine, own in zip(hits, texts, strict=True):
                    for k, more in look(index, own).items():
                        mine[k] += more
                if len(slices_of) > 1:
                    index = handle.__dict__.pop("_value", None)  # the worker keeps one slice only
            for part, mine in zip(group, hits, strict=True):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sorted(x, key=lambda h: h["item_id"]) for x in mine], kind)], names=[*part.schema.names, name])

    if not slices_of:
        return df.withColumn(name, F.array().cast(hit))
    return df.mapInArrow(lean(run), schema)
