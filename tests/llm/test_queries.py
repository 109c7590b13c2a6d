"""The registered queries as they are, over whole tables, against SQL or plain versions."""

import re
import zlib
from collections import defaultdict

import brute
import duckdb
import pytest

from quire.llm import queries

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in rows(spark, name)) == sorted(want.fetchall())


def encode(name, texts):
    return [e.ids for e in tokenizers.Tokenizer.from_file(queries.tokenizer(name)).encode_batch(list(texts), add_special_tokens=False)]


def test_packing(spark, texts):
    ids = {d: [*x, 1] for d, x in zip(texts, encode("byte_bpe_50k.json", texts.values()), strict=True)}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op2_packing"):
        mine = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in mine)) and r.doc_tokens == len(ids[r.doc_id]) and r.length == len(mine) > 0
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for found, whole in [(p, len(ids[d])) for d, p in pieces.items()] + [(p, None) for p in places.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == whole if whole else at <= 2048
    assert set(pieces) == set(texts)


def test_sharding(spark, texts):
    found = rows(spark, "op4_sharding")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in found:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 16, zlib.crc32(body), "bytes", None) and 0 <= r.shard < 40
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    # No more than the largest indivisible group above the mean.
    group = defaultdict(int)
    for r in found:
        group[texts[r.doc_id]] += r.size
    assert max(sizes.values()) <= sum(sizes.values()) / 40 + max(group.values())


def test_leaks(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = rows(spark, "op5_decontamination")
    assert {(r.doc_id, r.item_id) for r in found} == brute.leaks(texts.items(), items) and len(found) == len({(r.doc_id, r.item_id) for r in found})


def test_language(spark, texts):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = rows(spark, "op6_language_id")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert sum(r.language == labels[r.doc_id] for r in found) > 0.97 * len(found)
    assert all(r.kept for r in found if len(texts[r.doc_id]) > 200)


def test_languages_against_plain_arithmetic(spark):
    """Both language queries, row by row. All labelled texts are fewer than the model's bound here."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sample = [(r.lang, r.text) for r in docs if r.text is not None and r.lang is not None]
    names = sorted({x for x, _ in sample})
    want = brute.languages(sample, [(r.doc_id, r.text, None, None, r.source) for r in docs])
    found = rows(spark, "op6_language_id")
    assert len(found) == len(docs)
    for r in found:
        brute.same_language(r.language, r.confidence, names, want[r.doc_id])
    pages = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        said = re.search(r"<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3}(?:-[a-z]+)?)", r.html, re.IGNORECASE)
        body = re.sub(r"<(script|style|noscript)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", r.html, flags=re.IGNORECASE | re.DOTALL)
        pages.append((r.page_id, body, r.url, said and said[1]))
    want = brute.languages(sample, pages)
    found = rows(spark, "language_id_pages")
    assert sorted(r.page_id for r in found) == sorted(want)
    for r in found:
        brute.same_language(r.language, r.confidence, names, want[r.page_id])


def test_token_counts(spark, texts):
    ids = dict(zip(texts, encode("word_bpe_49k.json", texts.values()), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op8_token_counts")} == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 2048) for d, t in texts.items()}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licenses(spark, texts):
    for r in rows(spark, "op9_license_scan"):
        words = brute.alnum_words(texts[r.doc_id])
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, re.split(",", r.labels))) and 0 <= r.score <= 1
