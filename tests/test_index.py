"""The kept inverted index, hashed vectors, and how often texts are read."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import hashed
from quire.operators import cells, lexical, postings, segment, vector


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{k:03d}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(words, [1 / (1 + j) for j in range(300)], k=rng.randint(0, 80)))) for k in range(400)] + [(500, None), (501, ""), (502, "the w001 w001"), (503, "w299 w298")]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(5), rows


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(2)
    rows = [(q, " ".join(f"w{min(299, int(rng.expovariate(0.02))):03d}" for _ in range(9))) for q in range(25)] + [(90, "unseen words"), (91, "a"), (92, "w000 w001 w002 w298")]
    return spark.createDataFrame(rows, "qid long, question string"), rows


def bm25(rows, questions, k, k1=1.5, b=0.75):
    texts = {i: (t or "").split() for i, t in rows if t is not None}
    mean, df = sum(map(len, texts.values())) / len(texts), Counter(w for t in texts.values() for w in set(t))
    out = []
    for q, question in questions:
        scores = {}
        for i, t in texts.items():
            tf = Counter(t)
            hit = [w for w in set(question.split()) if tf[w] and len(w) > 2]
            if hit:
                scores[i] = sum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean)) for w in hit)
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
        out += [(q, i, r + 1, round(scores[i], 6)) for r, i in enumerate(best)]
    return sorted(out)


def rows_of(found):
    return sorted((r.qid, r.chunk_id, r.rank, round(r.score, 6)) for r in found.collect())


@pytest.mark.parametrize("first", [1, 200, postings.FIRST, 1 << 40])
def test_bm25_leaves_common_terms_alone_without_loss(spark, tmp_path, corpus, asked, monkeypatch, first):
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "ALL", 0 if first < postings.SENT // 10 + 1 else postings.ALL)
    texts = corpus[0].where("text is not null")
    want = bm25(corpus[1], asked[1], 5)
    assert rows_of(lexical.bm25_topk(texts, asked[0], 5)) == want
    root = f"file://{tmp_path}/index"
    postings.write_postings(corpus[0], root)
    assert rows_of(postings.search_postings(spark, root, asked[0], 5)) == want
    assert rows_of(postings.search_postings(spark, root, asked[0].where("qid = 91"), 5)) == []


def test_index_reads_only_asked_buckets(spark, tmp_path, corpus):
    root = f"file://{tmp_path}/index"
    postings.write_postings(corpus[0], root, buckets=64)
    terms = spark.createDataFrame([("w001",), ("w298",)], "_term string")
    found = postings.read_postings(spark, root, terms, buckets=64)
    buckets = sorted(r[0] for r in terms.select(postings.bucket(buckets=64)).distinct().collect())
    assert f"PartitionFilters: [isnotnull(_bucket#" in plan(found.postings) or "PartitionFilters: [_bucket#" in plan(found.postings)
    assert all(str(b) in plan(found.postings).split("PartitionFilters: ")[1].split("]")[0] for b in buckets)
    read = {f.split("_bucket=")[1].split("/")[0] for f in (r[0] for r in found.postings.select(F.input_file_name()).distinct().collect())}
    assert read == {str(b) for b in buckets}
    assert {(r._term, r._df) for r in found.terms.collect()} == {(w, sum(w in (t or "").split() for _, t in corpus[1])) for w in ("w001", "w298")}
    postings.write_postings(corpus[0].where("false"), f"{root}-none")
    assert postings.read_postings(spark, f"{root}-none", terms).texts == 0
    assert postings.search_postings(spark, f"{root}-none", spark.createDataFrame([(1, "w001")], "qid long, question string"), 3).count() == 0


def test_unasked_words_are_not_shuffled(spark, corpus):
    vocabulary = spark.createDataFrame([("w001",), ("w007",)], "_term string")
    found = lexical.asked_words(corpus[0], "chunk_id", "text", vocabulary)
    assert found.where("_term <> ''").count() == sum(w in (t or "").split() for _, t in corpus[1] for w in ("w001", "w007"))
    text = plan(found)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, many(corpus[0], vocabulary).collect()), key=repr)


def many(texts, vocabulary):
    """The same beyond the bound of what is sent."""
    bound, lexical.VOCABULARY = lexical.VOCABULARY, 1
    try:
        return lexical.asked_words(texts, "chunk_id", "text", vocabulary)
    finally:
        lexical.VOCABULARY = bound


def test_texts_are_packed_once(spark):
    texts = spark.createDataFrame([(1, "One. Two. " * 200), (2, None), (3, ""), (4, "short")], "k int, text string")
    found = segment.chunks(texts, "text")
    assert Counter(r.k for r in found.collect()) == {1: 3, 3: 1, 4: 1}
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("ArrowEvalPython") == 1


def test_hashed_vectors(spark, tmp_path):
    rows = [(1, "alpha beta beta"), (2, "beta beta alpha"), (3, None), (4, ""), (5, "gamma alpha"), (6, "delta " * 500), (7, "alpha")]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("_other", F.lit("x")).repartition(3)
    model = hashed.fit(df)
    texts = [t.split() for _, t in rows if t is not None]
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
    for w in ("alpha", "beta", "gamma", "delta", "unseen"):
        assert model.weights[slot(w)] == math.floor(1024 * math.log((len(texts) + 1) / (sum(w in t for t in texts) + 1)))
    found = {r.k: np.array(r.vector) for r in model.embed(df).collect()}
    assert all(len(v) == hashed.DIMENSIONS for v in found.values()) and (found[1] == found[2]).all()
    assert not found[3].any() and not found[4].any()
    assert all(abs(found[k] @ found[k] - 1) < 1e-12 for k in (1, 5, 6, 7)) and (found[6] != 0).sum() == 1
    assert found[1] @ found[5] < found[1] @ found[2] and model.embed(df).columns == ["k", "text", "_other", "vector"]
    model.save(spark, f"file://{tmp_path}/weights")
    assert (hashed.HashedVectors.load(spark, f"file://{tmp_path}/weights").weights == model.weights).all()
    assert not hashed.fit(df.where("false")).weights.any() and model.embed(df.where("false")).count() == 0


def vectors(rng, n, clusters, spread):
    base = rng.normal(size=(clusters, 16))
    return [(k, [round(float(x), 3) for x in base[k % clusters] + rng.normal(size=16) * spread]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_cells_give_what_a_whole_search_gives(spark, tmp_path, spread):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 3000, 40, spread)
    rows += [(9000 + k, rows[5][1]) for k in range(30)]  # ties
    chunks = spark.createDataFrame([*rows, (9999, None)], "chunk_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(q, 0, rows[q * 7][1]) for q in range(25)] + [(90, 1, [0.0] * 16), (91, 0, None)], "qid long, variant_pos int, embedding array<double>")
    root = f"file://{tmp_path}/cells"
    cells.write_cells(chunks, root, cells=40)
    for k in (1, 7, 50):
        found = cells.search_cells(spark, root, asked, k)
        want = vector.vector_topk(chunks, asked, k)
        assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, want.select(found.hits.columns).collect()))
    visits = {r.qid: r for r in found.visits.collect()}
    assert all(r.all_rows == 3030 for r in visits.values())
    if spread < 1:
        assert sum(visits[q].cells for q in range(25)) < 0.5 * sum(visits[q].all_cells for q in range(25))
    scan = plan(cells.search_cells(spark, root, asked.where("qid = 3"), 1).hits)
    few = cells.search_cells(spark, root, asked.where("qid = 3"), 1).visits.first()
    assert spread > 1 or few.cells < few.all_cells / 2 and scan
    everything = cells.search_cells(spark, root, asked.where("qid = 3"), 5000).hits
    assert everything.count() == 3030
    cells.write_cells(chunks.where("false"), f"{root}-none")
    assert cells.search_cells(spark, f"{root}-none", asked, 3).hits.count() == 0


def test_chunks_in_one_place_have_ids_of_their_own(spark):
    from quire.plans.index import numbered

    rows = [("web", "t", "u", 0, None, "b"), ("web", "t", "u", 0, None, "a"), ("web", "t", "u", 0, None, "a"), ("web", "t", "v", 0, None, "c")]
    chunks = spark.createDataFrame(rows, "source_type string, file string, url string, page int, ordinal int, text string")
    first, again = ({(r.url, r.text, r.chunk_id) for r in numbered(c).collect()} for c in (chunks, chunks.repartition(3)))
    assert len({i for *_, i in first}) == 4 and first == again
    alone = {r.text: r.chunk_id for r in numbered(chunks.where("text = 'c'")).collect()}
    assert ("v", "c", alone["c"]) in first


def test_postings_are_shuffled_and_written_once(spark, tmp_path, corpus, monkeypatch):
    def twice(*_):
        raise AssertionError("the postings are written beside the index")

    monkeypatch.setattr(postings, "written", twice)
    root = f"file://{tmp_path}/once"
    postings.write_postings(corpus[0], root, buckets=4)
    found = {(r._key, r._term): (r._tf, r._length) for r in spark.read.parquet(f"{root}/postings").collect()}
    assert found == {(i, w): (n, len(t.split())) for i, t in corpus[1] if t for w, n in Counter(t.split()).items()}
    stats = spark.read.parquet(f"{root}/stats").first()
    assert (stats.texts, stats.tokens) == (403, sum(len((t or "").split()) for _, t in corpus[1]))


def test_overlaps_hold_and_shuffle_no_pairs(spark, corpus, asked, monkeypatch):
    found = lexical.overlaps(corpus[0], asked[0])
    assert "hashpartitioning" not in plan(found) and "Aggregate" not in plan(found)
    rows = lambda d: {(r.qid, r.chunk_id): round(r.overlap, 9) for r in d.collect()}
    few = rows(found)
    monkeypatch.setattr(lexical, "VOCABULARY", 1)
    assert few and few == rows(lexical.overlaps(corpus[0], asked[0]))


def test_python_gets_batches_of_bounded_size(spark):
    import pyarrow as pa

    from quire import session

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(3000).select(F.repeat(F.lit("abcdefgh"), 500).alias("t")).coalesce(1)
    assert session.ready(rows).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 2 * session.BATCH
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    session.ready(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    assert [session._bytes(x) for x in ("64MB", "256m", "2097152", "67108864b", "1g", "-1", "3kb")] == [64 << 20, 256 << 20, 2097152, 64 << 20, 1 << 30, -1, 3072]
