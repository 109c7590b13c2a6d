import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import components, decontaminate, embedding_dedup, language_id, license_scan, minhash, packing, queries, sharding, substring, token_count, warc, words

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "A  b", "x" * 5000, "mot " * 3000, "é日本 ß y", "<|endoftext|> a <| b"]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def odd_rows(start=10_000):
    return [(start + k, t) for k, t in enumerate(ODD * 2)]


def thue_morse(n, a, b):
    """Two strings that polynomial hashes modulo powers of two cannot tell apart."""
    ones = [k.bit_count() % 2 for k in range(n)]
    return "".join(b if x else a for x in ones), "".join(a if x else b for x in ones)


THUE_MORSE = [x for n in (1024, 2048) for pair in ("ab", "eq", "no", "th") for x in thue_morse(n, *pair)]


# words and components


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\né0-_.", max_size=30), max_size=6))
def test_words(texts):
    raw = [t.encode() for t in texts]
    w = words.words_of(raw, lower=False)
    assert [w.buffer[a:b].decode() for a, b in zip(w.starts, w.ends)] == [x for t in texts for x in brute.plain_words(t)]
    assert w.counts().tolist() == [len(brute.plain_words(t)) for t in texts]
    w = words.words_of(raw, words.NOT_ALNUM)
    assert [w.buffer[a:b].decode() for a, b in zip(w.starts, w.ends)] == [x for t in texts for x in brute.alnum_words(t)]
    by_hash = defaultdict(set)
    for h, a, b in zip(w.hashes().tolist(), w.starts, w.ends):
        by_hash[h].add(w.buffer[a:b])
    assert all(len(x) == 1 for x in by_hash.values())


def test_hashes_of_structured_words():
    w = words.words_of([x.encode() for x in THUE_MORSE])
    for lane in (0, 1):
        assert len(set(w.hashes(lane).tolist())) == len(THUE_MORSE)
    rng = random.Random(9)
    runs = words.words_of([" ".join(rng.choice("xy") for _ in range(3000)).encode(), " ".join(thue_morse(2048, "x ", "y ")).encode()])
    for size in (1, 2, 3, 5, 35, 64, 1024):
        starts, hashes = words.windows(runs.hashes(), runs.first, size)
        spans = [runs.buffer[runs.starts[k] : runs.ends[k + size - 1]].split() for k in starts]
        assert len(set(hashes.tolist())) == len({tuple(x) for x in spans})
        of_words = {}
        assert all(of_words.setdefault(tuple(x), h) == h for x, h in zip(spans, hashes.tolist()))


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    for most in (components.EDGES, 100, 7):  # one task, and star rounds between tasks
        found = components.components(spark.createDataFrame(links, "a long, b long"), most=most).collect()
        assert {r.node: r.component for r in found} == brute.groups(real, {x for p in real for x in p})
        assert len(found) == len({r.node for r in found})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (7, "http://a/7", big), (None, None, big), (3, "u\r\nx y", "small"), (4, "u4", "small"), (5, "u5", None), (6, "u6", ""), (8, "u8", "WARC/1.1\r\nfake\r\n\r\n" * 90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k", F.lit(1)).withColumn("digest_", F.lit("x"))
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    got = sorted((tuple(r) for r in warc.payloads(warc.read_warc(spark, path)).collect()), key=repr)
    import hashlib

    want = []
    for i, u, h in rows:
        body = (h or "").encode()
        revisit = h == big and (i, u) != (7, "http://a/7")
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=repr)
    read = warc.read_warc(spark, path)
    assert read.where("record_type = 'revisit'").count() == 2
    assert {bytes(r.payload) for r in read.where("record_type = 'response'").select("payload").collect()} == {(h or "").encode() for _, _, h in rows}
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    warc.write_warc(pages.where("false"), f"{path}-none")
    assert warc.read_warc(spark, f"{path}-none").count() == 0


def test_warc_inflates_what_is_wanted(spark, tmp_path, monkeypatch):
    big = "<p>long</p>" * 3000
    pages = spark.createDataFrame([(k, f"u{k}", big if k < 20 else f"{k} " * 500) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/w"
    warc.write_warc(pages, f"file://{path}")
    inflated = []
    monkeypatch.setattr(warc, "inflate", lambda m, f=warc.inflate: inflated.append(len(x := f(m))) or x)

    def read(*tests, payload="true"):
        from pyspark.sql.datasource import EqualTo

        inflated.clear()
        reader = warc.WarcReader({"path": f"file://{path}", "payload": payload})
        assert list(reader.pushFilters([EqualTo((n,), v) for n, v in tests])) == []
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    assert len(read()) == 40 and len(inflated) == 40
    whole = sum(inflated)
    revisits = read(("record_type", "revisit"))
    assert len(revisits) == 19 == len(inflated) and sum(inflated) < 0.3 * whole  # revisits have headers only
    assert len(read(("target_uri", "u30"))) == 1 == len(inflated)
    assert len(read(payload="false")) == 40 and not inflated
    # the same records without the index, as of an archive from elsewhere, and with any tool
    import gzip
    import pathlib

    (archive,) = pathlib.Path(path).glob("*.warc.gz")
    assert gzip.decompress(archive.read_bytes()).count(b"WARC/1.1") == 40
    want = read(("record_type", "response"))
    archive.with_name(archive.name + warc.INDEX).unlink()
    assert read(("record_type", "response")) == want and not inflated and len(want) == 21


def test_warc_pushes_filters(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("content_length",), 3)]))
    assert len(kept) == 1 and reader.tests == [("warc-type", ("response",))]


# 2 packing


def test_structured_pieces():
    for name, make in (("byte_bpe_50k.json", packing.Encoder), ("word_bpe_49k.json", token_count.Counter)):
        path = queries.tokenizer(name)
        library, own = tokenizers.Tokenizer.from_file(path), make(path)
        want = [library.encode(x, add_special_tokens=False).ids for x in THUE_MORSE]
        if name.startswith("byte"):
            ids, first = own.encode(THUE_MORSE)
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
        else:
            assert own.counts(THUE_MORSE).tolist() == [len(x) for x in want]


def check_packing(rows, found, path):
    library = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    by_doc = Counter()
    for r in found:
        by_doc[r.doc_id] += r.length
    total = Counter()
    for (i, n, _), k in want.items():
        total[i] += n * k
    assert by_doc == total
    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in found if r.length == r.doc_tokens)
    assert not whole - want
    return sum(by_doc.values()), len(sequences)


def test_packing(spark, docs):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = docs + odd_rows() + [(None, "null key"), (3, "again"), (3, "again")]
    found = packing.pack(frame(spark, rows).withColumn("start", F.lit(1)).repartition(2), path).collect()
    tokens, sequences = check_packing(rows, found, path)
    assert 1 - tokens / (2048 * sequences) < 0.03
    assert packing.pack(frame(spark, []), path).count() == 0
    # pieces of one document cover its ids
    library = tokenizers.Tokenizer.from_file(path)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    for r in found:
        if r.doc_id in ids and r.doc_id != 3:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_padding_does_not_follow_partitions(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for parts in (1, 16, 64):
        found = packing.pack(df.repartition(parts), path).selectExpr("sum(length) as n", "count(distinct sequence_id) as s", "max(length + offset) as top").first()
        assert found.top <= 2048 and 1 - found.n / (2048 * found.s) < 0.01


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_tightest(sizes):
    bins = packing.best_fit(sizes, 64)
    room, want = [], []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room[room.index(min(fits))] -= sizes[i]
        else:
            room.append(64 - sizes[i])
        want = room
    assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == sorted(want)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    filled = packing._fill([[(i, 0, sizes[i]) for i in b] for b in bins], 64, 2)
    assert sum(64 - sum(p[2] for p in b) > 2 for b in filled) <= 1


# 3 embeddings


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    v = [(base[k % 40] + rng.normal(size=8) * rng.choice([0.02, 0.2, 0.6])).tolist() for k in range(900)]
    v += [v[0]] * 30 + [[2 * x for x in v[1]], [1e-200 * x for x in v[1]], [1e200 * x for x in v[2]]]
    rows = [(k, x) for k, x in enumerate(v)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [float("nan")] * 8), (5004, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (5005, [float("inf")] * 8), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (None, v[0])]
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 16 * 64)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("size", F.lit(1)).withColumn("rep", F.lit(2))
    found = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_embeddings(df).collect()}
    m = np.array(v)
    m /= np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    top = brute.groups(list(zip(*np.nonzero(linked))), range(len(v)))
    assert linked.sum() > 1000
    assert {k: found[k] for k in range(len(v))} == {k: (int(linked[k].sum()), top[k], top[k] == k) for k in range(len(v))}
    assert all(found[k] == (0, k, True) for k in range(5000, 5006)) and found[5006][0] == 1 and found[None] == (0, None, False)
    assert embedding_dedup.near_embeddings(df.where("false")).count() == 0


# 4 sharding


def test_sharding(spark, docs):
    rows = docs + odd_rows() + [(50_000 + k, "same text for many rows " * 20) for k in range(80)] + [(None, "n"), (1, "dup"), (1, "dup")]
    df = frame(spark, rows).withColumns({c: F.lit(0) for c in ("shard", "count", "lone", "bytes", "_item")})
    found = sharding.shard(df, shards=7)
    size, shard, slot = found.columns[-3:]
    got = found.select("doc_id", "text", size, shard, slot).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    slots, load, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        assert r[size] == len((r.text or "").encode()) + 16
        slots[r[shard]].append(r[slot])
        load[r[shard]] += r[size]
        where[r.text].add(r[shard])
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    assert max(load.values()) / min(load.values()) < 1.02
    assert sharding.shard(frame(spark, []), shards=7).count() == 0
    by_size = sharding.shard(frame(spark, docs), shards=None, capacity=60_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert all(r.b <= 60_000 for r in by_size) and len(by_size) <= -(-sum(r.b for r in by_size) // 60_000) + 1


def least_possible(sizes, bins):
    """The smallest largest bin of any packing, by trying all."""
    best = sum(sizes)

    def place(k, load):
        nonlocal best
        if max(load) >= best:
            return
        if k == len(sizes):
            best = max(load)
            return
        for b in range(bins):
            if load[b] not in load[:b]:  # bins as full as an earlier one are the same
                place(k + 1, [*load[:b], load[b] + sizes[k], *load[b + 1 :]])

    place(0, [0] * bins)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9), st.integers(1, 4))
def test_shards_against_all_packings(sizes, bins):
    """Best-fit decreasing stays within its bounds of what is possible: 11/9 of the best capacity (and a piece), 3/2 of the fewest bins."""
    where = sharding.fewest_capacity(sizes, bins)
    load = Counter()
    for s, b in zip(sizes, where, strict=True):
        load[b] += s
    best = least_possible(sorted(sizes, reverse=True), bins)
    assert set(where) <= set(range(bins)) and best <= max(load.values()) <= 11 / 9 * best + 1
    fewest = next(n for n in range(1, len(sizes) + 1) if least_possible(sorted(sizes, reverse=True), n) <= 60)
    assert fewest <= max(sharding.best_fit_decreasing(sizes, 60)) + 1 <= 1.5 * fewest


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_rooms(sizes):
    rooms, plain = sharding.Rooms(), []
    def balanced(node):
        if not node:
            return 0
        a, b = balanced(node[1]), balanced(node[2])
        assert abs(a - b) < 2 and node[3] == 1 + max(a, b)
        return node[3]

    for k, n in enumerate(sizes):
        balanced(rooms.root)
        if k % 3 == 2:
            found = rooms.take(n)
            fits = [x for x in plain if x[0] >= n]
            assert found == min(fits, default=None)
            if found:
                plain.remove(found)
        else:
            rooms.put(n, k)
            plain.append((n, k))


def test_many_shards_of_a_capacity(spark):
    rng = random.Random(5)
    rows = [(k, f"{k} " + "x" * rng.randrange(200)) for k in range(4000)]
    got = sharding.shard(frame(spark, rows), shards=None, capacity=1500).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    filled = Counter()
    for r in got:
        filled[r.shard] += r.size
    least = -(-sum(filled.values()) // 1500)
    assert 128 < least <= len(filled) <= 1.05 * least and max(filled.values()) <= 1500


# 5 decontamination


def test_leaks(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs + odd_rows() + [(20_000 + i, f"Before it. {t.upper()} After!") for i, t in items] + [(30_000, " ".join(t for _, t in items))]
    odd = [(900, None), (901, ""), (902, "..."), (None, "some words of a null key"), (903, "One. Two.")]
    bench = spark.createDataFrame(items + odd, "item_id long, text string").withColumn("n", F.lit(1)).withColumn("slice", F.lit(1))
    df = frame(spark, rows).withColumn("hits", F.lit(1))
    found = {(r.doc_id, h.item_id) for r in decontaminate.find_leaks(df, bench).collect() for h in r.hits_}
    assert found == brute.leaks(rows, items)
    assert {i for d, i in found if d == 30_000} == {i for i, _ in items}
    assert decontaminate.find_leaks(df.where("false"), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, docs), bench.where("false")).where("size(hits) > 0").count() == 0


def test_long_items(spark, docs):
    rng = random.Random(3)
    items = [(n, " ".join(f"w{int(rng.paretovariate(0.4)) % 20_000}" for _ in range(n)) + ".") for n in (33, 64, 65, 66, 96, 97, 112, 150, 187, 299, 300, 1000)]
    items = [(n, t[: len(t) // 2] + ". " + t[len(t) // 2 :]) for n, t in items]
    rows = docs[:50] + [(100_000 * gap + n, "zz " * gap + t + " yy" * 90) for n, t in items for gap in (1, 16, 17, 31, 32, 33)]
    # Every eighth word is another one: about 0.64 of the 3-grams stay.
    rows += [(900_000 + n, "zz " * 40 + " ".join("changed" if k % 8 == 5 and k < n - 3 else w for k, w in enumerate(t.split()))) for n, t in items]
    found = {(r.doc_id, h.item_id) for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect() for h in r.hits}
    assert {(100_000 * gap + n, n) for n, _ in items for gap in (1, 16, 17, 31, 32, 33)} <= found
    assert found == brute.leaks(rows, items)


def test_slices_of_the_index(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 1500)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = docs + [(20_000 + r.item_id, f"x {r.text} y") for r in items.collect()]
    found = {(r.doc_id, h.item_id) for r in decontaminate.find_leaks(frame(spark, rows), items).collect() for h in r.hits}
    assert found == brute.leaks(rows, [(r.item_id, r.text) for r in items.collect()])


def test_block_max_wand(spark):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choice(["aa", "bb", "cc", f"w{rng.randrange(60)}", f"v{rng.randrange(400)}"]) for _ in range(rng.randint(3, 40)))) for k in range(300)]
    counts = Counter(t for _, x in items for t in set(decontaminate.words(x)))
    index = decontaminate.Index(items, len(items), sum(len(decontaminate.words(x)) for _, x in items) / len(items), counts)
    for _ in range(400):
        terms = rng.sample(range(len(index.terms)), rng.randint(1, 40))
        if rng.random() < 0.5:
            terms = list({*terms, *(t for t in range(len(index.terms)) if rng.randrange(300) in index.lists[t][0])})
        scores = Counter()
        for t in terms:
            for k, w in zip(*index.lists[t]):
                scores[k] += w
        want = sorted(k for k, s in scores.items() if s >= decontaminate.SHARE - 1e-9)
        assert sorted(k for k, _ in index.search(terms)) == want
        if want:
            assert index.possible(np.zeros(len(terms), np.int64), np.array(terms), 1)[0]


# 6 language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 3 <> 0"), "text", "lang")
    held = docs.where("doc_id % 3 = 0")
    right = language_id.identify(held, model, host="source").where("lang = language and accepted").count()
    assert right / held.count() > 0.98
    rows = [(k, t, "http://www.site.de/de/x" if k % 2 else None, "de-DE" if k % 3 == 0 else None) for k, t in odd_rows(0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, said string").withColumn("language", F.lit("?")).withColumn("prior", F.lit(1)).withColumn("home", F.lit(1))
    out = language_id.identify(df, model, declared="said", url="url")
    assert out.columns[-3:] == ["language_", "confidence", "accepted"] and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].language_ == "de" and not got[0].accepted and not got[1].accepted
    assert language_id.identify(df.where("false"), model, declared="said", url="url").count() == 0
    empty = language_id.fit(docs.where("false"), "text", "lang")
    assert language_id.identify(frame(spark, [(1, "x")]), empty).first().accepted is False


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aBc \té0.", max_size=12), max_size=5))
def test_trigrams(texts):
    grams, first = language_id.trigrams([t.encode() for t in texts])
    for k, t in enumerate(texts):
        plain = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in f" {t} ".encode()).lower()
        while b"  " in plain:
            plain = plain.replace(b"  ", b" ")
        want = [(int.from_bytes(plain[i : i + 3], "big") * 2654435761 % 2**32) >> 17 for i in range(len(plain) - 2)]
        assert grams[first[k] : first[k + 1]].tolist() == want


def test_fusion_against_plain_arithmetic(spark):
    """Text likelihoods, declared language, address and host priors, all in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = [(r.lang, r.text) for r in docs.select("lang", "text").collect() if r.text is not None and r.lang is not None]
    model = language_id.fit(docs, "text", "lang", rows=10_000)
    assert model.languages == sorted({x for x, _ in sample})
    sites = ["http://a.example.de/x", "http://b.example.de/fr/y", "https://u@c.example.com:80/en-us", None, "mailto:x", "http://a.example.de/z"]
    rows = [(k, t, sites[k % 6], [None, "de-DE", "fr_FR", "xx"][k % 4]) for k, (_, t) in enumerate(sample[:90])] + [(900, None, sites[0], None), (901, "", sites[1], "es")]
    want = brute.languages(sample, rows)
    for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, url string, said string"), model, declared="said", url="url").collect():
        brute.same_language(r.language, r.confidence, model.languages, want[r.doc_id])


# 7 substring


@pytest.mark.parametrize("window", [35, 4])
def test_substring(spark, window):
    rng = random.Random(window)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (34, 35, 36, 60, 120)]
    rows = []
    for k in range(150):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts += [rng.choice(passages), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50)))]
        rows.append((k, "\n".join(parts)))
    rows += odd_rows() + [(900, "same " * 10), (901, "A b " * 60), (902, "a b " * 60), (None, rows[0][1]), (5, rows[5][1])]
    df = frame(spark, rows).withColumn("n_words", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("chunk", F.lit(3)).repartition(5)
    found = substring.remove_repeats(df, window=window, chunk_bytes=4000)
    got = Counter((r.doc_id, r.text, r.n_words_, r.n_removed, substring.sha256(r.kept_text or "")) for r in found.collect())
    want = Counter((i, t, *x) for (i, t), x in zip(rows, brute.repeats([t for _, t in rows], window)))
    assert got == want
    assert found.where("text is null and kept_text is not null").count() == 0
    assert substring.remove_repeats(df.where("false")).count() == 0


def test_substring_of_structured_words(spark):
    rows = [(k, " ".join([f"w{j}" for j in range(20)] + [x] + [f"w{j}" for j in range(14)])) for k, x in enumerate(THUE_MORSE)]
    assert {(r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect()} == {(35, 0)}
    assert {(r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows + rows)).collect()} == {(35, 35)}


# 8 tokens


def test_token_counts(spark, docs):
    path = queries.tokenizer("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    mixed = ["".join(random.Random(k).choice("ab's'tre'll D \n\t\x85\xa0é1²ßİΣσ!?<|’日\U0001f600") for _ in range(30)) for k in range(300)]
    rows = docs + odd_rows() + [(40_000 + k, t) for k, t in enumerate(mixed)] + [(None, "x")]
    df = frame(spark, rows).withColumn("n_tokens", F.lit(0))
    for r in token_count.count_tokens(df, path, limit=50).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens_, r.over_limit) == (len((r.text or "").encode()), n, n > 50)
    assert token_count.count_tokens(frame(spark, []), path).count() == 0


# 9 licences


def test_long_license_expressions():
    names = [f"Licence-{k}" for k in range(3000)]
    for n in (370, 371, 372, 373, 374, 3000):
        text = ("x SPDX-License-Identifier: " + " OR ".join(names[:n]) + "\nMIT").encode()
        assert license_scan.scan(text)[5] == ",".join(sorted(x.lower() for x in names[:n]))
        assert license_scan.scan(text)[7] == [" ".join(license_scan.postfix(" OR ".join(names[:n])))]
    for blanks in (*range(4080, 4100), 20_000):
        assert license_scan.scan(b"SPDX-License-Identifier:" + b" " * blanks + b"MIT OR GPL-2.0. AND BSD\n")[5] == "gpl,mit"
        assert license_scan.scan("SPDX-License-Identifier:".encode() + b" " * blanks + "MIT é ISC".encode())[5] == "mit"
    assert license_scan.scan(b"SPDX-License-Identifier:" + b" " * 5000 + b"\nMIT")[5] == ""


def test_many_notices_in_a_text():
    words_, n = "a mit license b cc by nc c ", 30_000
    found = license_scan.scan((words_ * n).encode())
    assert found[:6] == (8 * n, 2 * n, 1, 8 * (n - 1) + 4, "cc-by,mit", "cc-by,cc-by-nc,mit")


def test_licenses(spark, docs):
    rows = docs + odd_rows() + [(1, "MIT   License mit-license CC\nBY-NC; gnu General PUBLIC license."), (2, "SPDX-License-Identifier: MIT OR (GPL-2.0-only AND BSD-3-Clause)\nx"), (None, "Apache License")]
    df = frame(spark, rows).withColumn("labels", F.lit("x")).withColumn("score", F.lit(1))
    for r in license_scan.scan_licenses(df).collect():
        w, places, labels = brute.alnum_words(r.text), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels_.split(",")) and 0 <= r.score_ <= 1
    assert license_scan.scan_licenses(df.where("false")).count() == 0


def test_expressions():
    judge = lambda x: license_scan.evaluate(license_scan.postfix(x))
    assert license_scan.postfix("A OR B AND C WITH D") == ["A", "B", "C", "D", "with", "and", "or"]
    assert judge("MIT OR GPL-3.0") == ({"mit", "gpl"}, 0)
    assert judge("MIT AND GPL-3.0") == ({"mit", "gpl"}, 2)
    assert judge("(MIT OR GPL-3.0) AND GPL-2.0 WITH X") == ({"mit", "gpl"}, 1)
    assert judge("") == (set(), None) and judge("((") == (set(), None) and judge("MIT OR") == ({"mit"}, 0)


# 10 near-duplicates


def test_near_duplicates(spark, docs):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = list(docs)
    for k in range(320):
        w = list(base)
        for p in rng.sample(range(120), rng.choice([1, 2, 3, 6])):
            w[p] = rng.choice(vocabulary)
        rows.append((20_000 + k, " ".join(w)))
    rows += [(30_000 + k, " ".join([rng.choice(vocabulary) for _ in range(30)] + base[:50])) for k in range(60)]
    rows += odd_rows() + [(40_000, "one two three four"), (40_001, "ONE two\tthree four"), (40_002, "one two three four five")]
    df = frame(spark, rows + [(None, rows[0][1]), rows[1], rows[1]]).withColumn("n", F.lit(1)).withColumn("low", F.lit(1)).repartition(6)
    got = minhash.near_duplicates(df).collect()
    want = brute.near(rows)
    assert len(got) == len(rows) + 3
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    assert [tuple(r)[2:] for r in got if r.doc_id is None] == [(None, False)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_of_structured_words(spark):
    rows = [(k, f"one two {x} four five") for k, x in enumerate(THUE_MORSE)]
    assert all(r.component_id == r.doc_id and r.kept for r in minhash.near_duplicates(frame(spark, rows)).collect())


def test_confirming_very_long_texts(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    rows = [(k, " ".join(base[: 60_000 - 900 * k] + [f"x{k}"])) for k in range(8)]
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, rows).repartition(3)).collect()}
    assert got == brute.near(rows)


def test_sketch_never_rules_out_a_link():
    rng = np.random.default_rng(1)
    for n in (3, 20, 150, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: max(1, int(n * 0.9))], rng.integers(0, 1 << 63, n // 12).astype(np.uint64)])
        sets, first = np.concatenate([np.unique(a), np.unique(b)]), np.array([0, len(np.unique(a)), len(np.unique(a)) + len(np.unique(b))])
        sketch = minhash.odd_sketches(minhash.signatures(sets, first), sets, first).view(np.uint64)
        flips = np.bitwise_count(sketch[0] ^ sketch[1])
        assert flips[minhash._WORDS :].sum() <= len(np.setxor1d(a, b))
        assert flips[: minhash._WORDS].sum() <= minhash.least_estimate(0.75)[1]
