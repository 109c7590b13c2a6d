import json

import pytest
from pyspark.sql import functions as F

from quire.functions import hashed
from quire.functions.text import parse_bool
from quire.operators import context, evaluate, lexical, rank
from quire.plans import ask, index, models
from quire.plans import search as plans
from quire.sources import caches, pdf, profiles, store

GIVEN = {"name": "demo", "expansion_rules": [{"text": "extra words", "any_terms": ["Cat"]}, {"text": "both", "all_terms": ["cat", "dog"]}], "technical_focus_rules": [{"any_terms": ["Cat"], "filename_contains": ["CATS", ""]}, {"any_terms": [], "filename_contains": ["never"]}], "prompt_extra_rules": ["Be brief."], "query_rewrite_extra_constraints": ["No dogs."]}


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "The cat"), (2, "Cat and dog"), (3, "nothing")], "qid int, question string")


@pytest.fixture(scope="module")
def results(spark):
    rows = [(q, q * 100 + i, f"text {i}", f"f{i % 3}.pdf", i, i, "pdf", "", 1.0 - i / 20, 0.5, 1.0 - i / 20, i + 1) for q in (1, 2) for i in range(10 if q == 1 else 3)]
    return spark.createDataFrame(rows, "qid int, chunk_id long, text string, file string, page int, ordinal int, source_type string, url string, semantic double, lexical double, final double, rank int")


def ids(df, qid=1):
    return [r.chunk_id % 100 for r in df.where(F.col("qid") == qid).orderBy("rank").collect()]


def test_profiles(spark, tmp_path, asked):
    (tmp_path / "demo.json").write_text(json.dumps(GIVEN))
    folder = f"file://{tmp_path}"
    assert profiles.available(spark, folder) == ["demo", "generic"] and profiles.available(spark, f"{folder}/none") == ["generic"]
    for name in (None, "", " Generic ", "generique", "unknown"):
        assert profiles.load(spark, folder, name) is profiles.GENERIC
    found = profiles.load(spark, folder, " DEMO")
    assert found.display_name == "demo" and found.query_rewrite_context == profiles.REWRITE_CONTEXT
    expanded = [r.expansion for r in plans.expand(asked, found.rules(spark)).orderBy("qid").collect()]
    assert [e.partition(" : ")[2] for e in expanded] == ["extra words", "extra words both", ""]
    assert [r[0] for r in asked.orderBy("qid").select(found.focus("question")).collect()] == [["cats"], ["cats"], []]
    assert plans.expand(asked, profiles.GENERIC.rules(spark)).where("expansion <> question").count() == 0
    assert "- No dogs." in asked.select(found.rewrite_prompt("question")).first()[0]
    for bad in ("[]", "{}", '{"name": "x", "expansion_rules": [{}]}'):
        with pytest.raises(ValueError):
            profiles.from_json(bad)


def test_rewrites_are_cached(spark, tmp_path, asked):
    seen = []

    def call(rows):
        seen.extend(r.prompt for r in rows.collect())
        return rows.select("key", F.when(~F.contains("prompt", F.lit("dog")), F.lit("  a \n b ")).alias("reply"))

    root = f"file://{tmp_path}/cache"
    cache = caches.CallCache(spark, root, caches.REWRITES)
    assert cache.stats().first().asDict() == {"found": False, "entries": 0, "bytes": 0}
    out = models.rewrites(asked.unionAll(asked.where("qid = 1").withColumn("qid", F.lit(9))), cache, "m", call)
    assert {r.qid: r.rewrite for r in out.collect()} == {1: "a b", 2: None, 3: "a b", 9: "a b"}
    assert len(seen) == 3
    seen.clear()
    out = models.rewrites(asked, caches.CallCache(spark, root, caches.REWRITES), "m", call)
    assert out.where("rewrite is not null").count() == 2 and len(seen) == 1  # the failed call again
    assert cache.stats().first().entries == 2
    other = models.rewrites(asked, cache, "other model", lambda rows: rows.select("key", F.lit("x").alias("reply")))
    assert {r.rewrite for r in other.collect()} == {"x"}


def test_judge(spark, tmp_path, asked, results):
    cache = lambda n: caches.CallCache(spark, f"file://{tmp_path}/{n}", caches.ORDERS)
    say = lambda reply: lambda rows: rows.select("key", F.lit(reply).alias("reply"))
    out = models.judged(results, asked, cache("a"), "m", say("see [3, 3, 99, 1]"), 8)
    assert ids(out) == [2, 0, 1, 3, 4, 5, 6, 7, 8, 9] and ids(out, 2) == [0, 1, 2] and cache("a").load().count() == 1
    assert ids(models.judged(results, asked, cache("a"), "m", say("[5]"), 8))[:2] == [2, 0]
    assert ids(models.judged(results, asked, cache("b"), "m", say(None), 8)) == list(range(10)) and cache("b").load().count() == 0
    changed = models.judged(results.withColumn("text", F.upper("text")), asked, cache("b"), "m", say("[5]"), 8)
    assert ids(changed)[0] == 4


def test_cross_encoder(asked, results):
    out = models.cross_encoded(results, asked, lambda q, t: [float(x[-1]) for x in t], 8)
    assert ids(out) == list(range(9, -1, -1)) and ids(out, 2) == [0, 1, 2]

    def broken(q, t):
        raise RuntimeError("no model")

    shuffled = results.withColumn("final", -F.col("final"))
    assert ids(models.cross_encoded(shuffled, asked, broken, 8)) == list(range(10))


def test_ask_with_fallback(spark):
    chunks = spark.createDataFrame([(i, f"{i} watt", f"f{i}.pdf", 1, i, "pdf", "", None, [1.0 - i / 10, 0.0]) for i in range(10)], "chunk_id long, text string, file string, page int, ordinal int, source_type string, url string, fetched_on date, embedding array<double>")
    asked = spark.createDataFrame([(1, "combien de watts"), (2, "hello")], "qid int, question string")
    embed = lambda v: v.select("qid", "variant_pos", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    nothing = rank.MetadataFilter(files=frozenset({"none.pdf"}))
    rows = {r.qid: r for r in ask.ask(asked, chunks, embed, where=nothing).answers.collect()}
    assert rows[1].fallback and not rows[2].fallback
    assert rows[1].answer.endswith("[1]") and rows[1].linked.endswith("[[1]](/app/static/pdfs/f0.pdf#page=1)")
    assert rows[2].answer.startswith("Je ne sais pas")
    assert not any(r.fallback for r in ask.ask(asked, chunks, embed, where=nothing, fallback=False).answers.collect())
    said = ask.ask(asked, chunks, embed, generate=lambda p: p.where("qid = 1").select("qid", F.lit("see [2]").alias("answer")))
    assert {r.qid: r.linked for r in said.answers.collect()} == {1: "see [[2]](/app/static/pdfs/f1.pdf#page=1)", 2: None}


def test_answers_are_completed(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid int, question string")
    given = spark.createDataFrame([(1, "given"), (2, None), (9, "no case")], "qid int, answer string")
    seen = []

    def answer(rows):
        seen.extend(r.question for r in rows.collect())
        return rows.select("qid", F.concat(F.lit("said "), "question").alias("answer"), F.lit(True).alias("fallback"))

    assert sorted(map(tuple, ask.complete(cases, given, answer).collect())) == [(1, "given"), (2, None), (3, "said c")] and seen == ["c"]


def test_boosts_and_mentions_of_a_profile(spark, tmp_path, results):
    rules = [{"any_terms": ["Which"], "count_terms": ["text", "1", "2"], "count_bonus": [[1, 0.1], [2, 0.5]], "file_bonus": [["F1", 1.0]], "text_bonus": {"TEXT 9": 5}}, {"all_terms": ["which", "two"], "file_bonus": {"f2": -9}}]
    (tmp_path / "shop.json").write_text(json.dumps({"name": "shop", "boost_rules": rules, "mention_patterns": {"nine": "TEXT 9", "odd": r"[1357]\b", "same": r"(t)ex\1"}}))
    profile = profiles.load(spark, f"file://{tmp_path}", "shop")
    rows = results.where("qid = 1").withColumn("question", F.lit("which one"))
    bonus = {k: (0.5 if k in (1, 2) else 0.1) + (k % 3 == 1) + 5 * (k == 9) for k in range(10)}
    want = sorted(range(10), key=lambda k: (-round(1 - k / 20 + bonus[k], 9), k))
    assert ids(profile.boosted(rows)) == want
    assert ids(profile.boosted(rows.withColumn("question", F.lit("how")))) == list(range(10)) and profiles.GENERIC.boosted(rows) is rows
    found = profile.boosted(rows)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    said = context.mentions(rows, profile.mention_patterns)
    assert {r.name: r.sources for r in said.collect()} == {"nine": [10], "odd": [2, 4, 6, 8], "same": [1, 2, 3, 4]}
    assert {r.name: r.sources for r in context.mentions(rows, profile.mention_patterns[:2]).collect()} == {"nine": [10], "odd": [2, 4, 6, 8]}
    assert "NestedLoop" not in said._jdf.queryExecution().toString() and context.mentions(rows, []).count() == 0


def test_a_profile_s_boosts_work_in_a_search(spark):
    chunks = spark.createDataFrame([(i, "text", f"f{i}.pdf", 1, i, "pdf", "", [1.0 - i / 100, 0.0]) for i in range(12)], "chunk_id long, text string, file string, page int, ordinal int, source_type string, url string, embedding array<double>")
    asked = spark.createDataFrame([(1, "hello"), (2, "bye")], "qid int, question string")
    embed = lambda v: v.select("qid", "variant_pos", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    profile = profiles.Profile("p", boost_rules=(profiles.Boost(any_terms=("hello",), file_bonus=(("f11", 1.0),)),))
    found = plans.search(asked, chunks, embed, profile=profile, traced=True)
    assert ids(found.results, 1)[:2] == [11, 0] and ids(found.results, 2)[:2] == [0, 1]
    stages = {r.stage: r for r in plans.stage_table(spark, found).collect()}
    assert {n: s.rows for n, s in stages.items()} == {"variants": 2, "hits": 24, "candidates": 24, "passed": 24, "results": 16}
    assert all(s.seconds > 0 for s in stages.values()) and found.flags["boosts"] == "True" and found.flags["profile"] == "p"
    assert plans.search(asked, chunks, embed).stages == ()


def test_only_portfolio_questions_are_diversified(spark):
    chunks = spark.createDataFrame([(i, "text", "one.pdf" if i < 15 else "two.pdf", 1, i, "pdf", "", [1.0 - i / 100, 0.0]) for i in range(30)], "chunk_id long, text string, file string, page int, ordinal int, source_type string, url string, embedding array<double>")
    asked = spark.createDataFrame([(1, "toutes les capacités"), (2, "hello")], "qid int, question string")
    embed = lambda v: v.select("qid", "variant_pos", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    out = plans.search(asked, chunks, embed).results
    assert ids(out, 1)[:4] == [0, 1, 15, 16] and ids(out, 2) == list(range(8))
    trace = {r.qid: (r.branch, r.top_k, r.candidates, r.results) for r in plans.trace(plans.search(asked, chunks, embed)).collect()}
    assert trace == {1: ("portfolio", 12, 30, 12), 2: ("standard", 8, 30, 8)}


def test_index(spark, tmp_path):
    root = f"file://{tmp_path}"
    pdf_ = spark.createDataFrame([("a", "f.pdf", 1, 0), ("b", "f.pdf", 1, 1), ("a", "g.pdf", 1, 0), (" ", "g.pdf", 2, 0)], "text string, file string, page int, ordinal int").withColumn("source_type", F.lit("pdf"))
    web = spark.createDataFrame([("c", "t", "u")], "text string, file string, url string").withColumn("source_type", F.lit("web"))
    seen = []

    def embed(rows):
        seen.extend(r.text for r in rows.collect())
        return rows.select("key", F.array(F.lit(3.0), F.lit(4.0)).alias("vector"))

    first = index.build_index(pdf_, web, f"{root}/index", f"{root}/cache", embed, "m")
    assert first.stats.first().chunks == 4 and sorted(seen) == ["a", "b", "c"]
    rows = store.current(spark, f"{root}/index", index.INDEX_SCHEMA)
    assert rows.select("chunk_id").distinct().count() == 4 and [round(x, 6) for x in rows.first().embedding] == [0.6, 0.8]
    seen.clear()
    second = index.build_index(pdf_, web, f"{root}/index", f"{root}/cache", embed, "m")
    assert not seen and second.version != first.version
    assert {r.chunk_id for r in store.current(spark, f"{root}/index", index.INDEX_SCHEMA).collect()} == {r.chunk_id for r in rows.collect()}
    none = index.build_index(pdf_.where("false"), web.where("false"), f"{root}/none", f"{root}/cache", embed, "m")
    assert none.version is None and not store.exists(spark, f"{root}/none")
    offline = index.build_index(pdf_, web, f"{root}/offline", f"{root}/no-cache")
    assert offline.stats.first().chunks == 4 and not store.exists(spark, f"{root}/no-cache")
    weights = hashed.HashedVectors.load(spark, f"{root}/offline-weights")
    found = {r.chunk_id: r.embedding for r in store.current(spark, f"{root}/offline", index.INDEX_SCHEMA).collect()}
    assert found == {r.chunk_id: r.vector for r in weights.embed(rows.select("chunk_id", "text")).collect()}
    store.publish(rows.select(*(c.split()[0] for c in index.INDEX_SCHEMA.split(", "))), f"{root}/index")
    store.discard_versions(spark, f"{root}/index", 1)
    assert store.current(spark, f"{root}/index", index.INDEX_SCHEMA).count() == 4


def test_pdf_pages(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "note.txt"):
        (tmp_path / name).write_bytes(f"{name}|INTRODUCTION\nSome body text. More.".encode())
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "c.pdf").write_bytes(b"x")
    folder = f"file://{tmp_path}"
    assert [r.file for r in pdf.list_pdfs(spark, folder).orderBy("file").collect()] == ["a.pdf", "b.pdf"]

    def parse(content):
        name, _, text = content.decode().partition("|")
        return [(1, text, [[["h1", "h2"], ["1", "2"]]]), (2, None, [[["only", "row"]]]), (3, "", [])]

    pages = pdf.read_pages(spark, folder, parse)
    assert {(r.file, r.page) for r in pages.collect()} == {(f, p) for f in ("a.pdf", "b.pdf") for p in (1, 2, 3)}
    found = pdf.page_chunks(pages).where("file = 'a.pdf'").orderBy("page", "ordinal").collect()
    assert [(r.page, r.ordinal, r.text.split("\n")[0]) for r in found] == [(1, 1, "TABLEAU extrait de la page 1, tableau 1"), (1, 2, "TITRE DE SECTION: INTRODUCTION")]


def test_small_helpers(spark, asked):
    assert [parse_bool(x) for x in (None, " Oui", "on", "0", "")] == [False, True, True, False, False] and parse_bool(None, True)
    corpus = spark.createDataFrame([(1, "the black cat cat"), (2, None), (3, "dog")], "chunk_id long, text string")
    found = {(r.qid, r.chunk_id): r.overlap for r in lexical.overlaps(corpus, asked).collect()}
    assert found == {(1, 1): 1.0, (2, 1): 0.5, (2, 3): 0.5}
    deltas = spark.createDataFrame([("latency", 1.2, 1.8, 0.6, "+0.60")], "metric string, baseline double, current double, delta double, label string")
    assert evaluate.delta_lines(deltas).first().line == "latency          1.20s -> 1.80s  +0.60s"
    plain = plans.search_text(asked, profiles.GENERIC.rules(spark)).orderBy("qid").first().search_text
    assert plain == "The cat"


def test_pages_of_a_file_are_handed_on_while_it_is_parsed(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")

    def parse(content):
        for n in range(1, 1 << 30):
            if n > 100_000:
                raise MemoryError("all pages at once")
            yield n, "y" * 100, []

    assert len(pdf.read_pages(spark, f"file://{tmp_path}", parse).limit(5).collect()) == 5
