import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.config import RetrievalConfig
from quire.operators import context, corpus, evaluate, lexical, rank, vector
from quire.plans import search as plans
from quire.sources import store


@pytest.fixture(scope="module")
def results(spark):
    rows = [(1, i, f"text {i} tb 5 watt" if i % 2 else f"text {i}", f"f{i % 3}.pdf", i, 1.0 - i / 20, 0.5, 1.0 - i / 20, i + 1) for i in range(10)]
    return spark.createDataFrame(rows, "qid int, chunk_id long, text string, file string, page int, semantic double, lexical double, final double, rank int")


def ids(df):
    return [r.chunk_id for r in df.orderBy("qid", "rank").collect()]


def test_bm25(spark):
    texts = [(1, 1, "solar panel power power"), (1, 2, "solar wind"), (1, 3, "nothing here at all")]
    found = lexical.bm25_candidates(spark.createDataFrame(texts, "qid int, chunk_id long, text string"), spark.createDataFrame([(1, "solar power")], "qid int, query_text string")).orderBy("chunk_id").collect()
    assert [r.lexical for r in found][0] == 1.0 and 0 < found[1].lexical < 1 and found[2].lexical == 0
    empty = lexical.bm25_candidates(spark.createDataFrame(texts, "qid int, chunk_id long, text string"), spark.createDataFrame([(1, "a of")], "qid int, query_text string"))
    assert {r.lexical for r in empty.collect()} == {0.0}


def test_vector_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    v, q = rng.integers(-2, 3, (200, 4)), rng.integers(-2, 3, (3, 4))
    chunks = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, 0, [float(x) for x in r]) for i, r in enumerate(q)], "qid long, variant_pos int, embedding array<double>")
    found = vector.vector_topk(chunks, queries, 7).orderBy("qid", "hit_rank").collect()
    want = [(i, int(c), float(q[i] @ v[c])) for i in range(3) for c in sorted(range(200), key=lambda c: (-(q[i] @ v[c]), c))[:7]]
    assert [(r.qid, r.chunk_id, r.score) for r in found] == want


def test_fusion(spark):
    hits = [(1, 0, 10, 0.9, 1), (1, 0, 11, 0.8, 2), (1, 1, 11, 0.7, 1), (1, 1, 12, 0.6, 2), (1, 2, 11, 0.9, 1)]
    found = rank.fuse(spark.createDataFrame(hits, "qid int, variant_pos int, chunk_id long, score double, hit_rank int")).orderBy("fused_rank").collect()
    assert [(r.chunk_id, round(r.semantic, 2), r.matches) for r in found] == [(11, 0.96, 3), (10, 0.9, 1), (12, 0.6, 1)]


def test_filters(spark, results):
    where = rank.MetadataFilter.from_form(files=["f1.pdf"], page_min=2)
    assert where.active() and not rank.MetadataFilter.from_form().active()
    assert ids(results.where(where.column())) == [4, 7]
    rows = results.withColumn("question", F.lit("combien de watts"))
    assert ids(rank.technical_filter(rows, F.lit(True))) == [1, 3, 5, 7, 9]
    assert len(ids(rank.technical_filter(rows.where("chunk_id % 2 = 0"), F.lit(True)))) == 5
    focus = rows.withColumn("focus", F.array(F.lit("f0")))
    assert ids(rank.technical_filter(focus, F.lit(True), focus="focus")) == [3, 9]


def test_diversify(results):
    assert ids(rank.diversify(results, 7)) == [0, 1, 2, 3, 4, 5, 6]
    assert ids(rank.diversify(results, 5, 1)) == [0, 1, 2, 3, 4]
    assert ids(rank.diversify(results.where("chunk_id in (0, 3, 6, 1)"), 4)) == [0, 1, 3, 6]


def test_judge_and_cross(spark, results):
    orders = spark.createDataFrame([(1, [3, 3, 0, 99, 1])], "qid int, ranking array<int>")
    got = rank.apply_order(results, orders, 8).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 0, 1, 3, 4, 5, 6, 7, 8, 9] and round(got[0].final, 3) == 1.2
    assert ids(rank.apply_order(results, orders, 10)) == list(range(10))
    scores = spark.createDataFrame([(1, 9, 5.0), (1, 0, 0.0)], "qid int, chunk_id long, cross double")
    assert ids(rank.apply_cross_scores(results, scores, 3))[:2] == [9, 0] and len(ids(rank.apply_cross_scores(results, scores, 3))) == 10


def test_fallback_and_comparison(results):
    assert ids(rank.with_fallback(results.where("qid = 2"), results)) == list(range(10))
    assert rank.same_top(results, results).first().same


def test_adaptive(spark):
    asked = spark.createDataFrame([("toutes les capacités",), ("liste des watts",), ("synthese",), ("hello",)], "question string")
    found = plans.adaptive(asked, RetrievalConfig()).collect()
    assert [(r.branch, r.top_k, r.candidate_k, r.min_score) for r in found] == [("portfolio", 12, 160, 0.0), ("technical", 8, 120, 0.0), ("synthesis", 10, 120, 0.05), ("standard", 8, 80, 0.1)]


def test_search_adapts(spark):
    n = 200
    chunks = spark.createDataFrame([(i, f"{i} watt" if i % 4 else "plain", f"F{i % 3}.pdf", 1, i, "pdf", "", [1.0 - 2 * i / n, 0.0]) for i in range(n)], "chunk_id long, text string, file string, page int, ordinal int, source_type string, url string, embedding array<double>")
    asked = spark.createDataFrame([(1, "toutes les capacités", None), (2, "combien de watts", ["f1"]), (3, "une synthese", None), (4, "hello", None), (5, "dimensions", None)], "qid int, question string, terms array<string>")
    embed = lambda v: v.select("qid", "variant_pos", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    rules = spark.createDataFrame([], plans.RULE_SCHEMA)
    seen = {}

    def count(rows):
        seen.update({r.qid: r.n for r in rows.groupBy("qid").agg(F.count("*").alias("n")).collect()})
        return rank.apply_order(rows, spark.createDataFrame([(4, [9])], "qid int, ranking array<int>"), F.col("top_k"))

    out = plans.search(asked, chunks, embed, rules, rerankers=(count,), focus="terms")
    assert {r.qid: r.n for r in out.candidates.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {1: 160, 2: 120, 3: 120, 4: 80, 5: 120}
    rows = out.results.orderBy("qid", "rank").collect()
    assert {q: sum(r.qid == q for r in rows) for q in range(1, 6)} == {1: 12, 2: 8, 3: 10, 4: 8, 5: 8}
    assert {r.file for r in rows if r.qid == 2} == {"F1.pdf"} and {r.file for r in rows if r.qid == 5} > {"F1.pdf"}
    assert next(r.chunk_id for r in rows if r.qid == 4) == 8
    assert not {"top_k", "candidate_k", "min_score", "branch"} & set(out.results.columns)
    # Scores are 0.7 (1 - 2 i / n): 0.05 is reached up to 92, and 0 up to 100, where every fourth chunk has no value.
    assert seen[3] == 93 and seen[4] == 80 and seen[5] == 101 - 26
    fixed = plans.search(asked, chunks, embed, rules, adapt=False)
    assert {r.n for r in fixed.candidates.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {80}
    assert {r.n for r in fixed.results.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {8}
    only = plans.search(asked.where("qid >= 4"), chunks, embed, rules, where=rank.MetadataFilter(files=frozenset({"F0.pdf"})))
    assert {r.n for r in only.candidates.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {67}


def test_variants(spark):
    rules = spark.createDataFrame([("p", 0, "extra words", ["cat"], []), ("p", 1, "never", ["cat"], ["dog"]), ("p", 2, "no terms", [], [])], plans.RULE_SCHEMA)
    asked = spark.createDataFrame([(1, "The cat"), (2, "nothing")], "qid int, question string")
    found = plans.variants(asked, rules, rewrite=lambda q: F.upper(q)).orderBy("qid", "variant_pos").collect()
    assert [(r.qid, r.variant_pos) for r in found] == [(1, 0), (1, 2), (2, 0)]
    assert found[1].query_text.endswith(" : extra words")


def test_context_budget(spark):
    rows = [(1, "a", "x" * 200, 1), (1, "b", "y" * 2000, 2), (1, "a", "z" * 100, 3)]
    df = spark.createDataFrame(rows, "qid int, file string, text string, rank int").withColumns({c: F.lit(0.5) for c in ("final", "semantic", "lexical")} | {"page": F.lit(1), "ordinal": F.lit(2), "source_type": F.lit("pdf"), "url": F.lit(""), "fetched_on": F.lit(None).cast("date")})
    fitted = context.fit_budget(df, 200)
    assert [r["rank"] for r in fitted.orderBy("rank").collect()] == [1, 3]
    assert sum(r.cost for r in fitted.collect()) <= 200
    text = context.assemble(fitted).first().context
    assert text.startswith("## Document : a\n[Source 1 |") and "[Source 3 |" in text
    empty = context.prompts(spark.createDataFrame([(9, "why?")], "qid int, question string"), context.assemble(fitted)).first().prompt
    assert context.NO_CONTEXT in empty


def test_citations(spark, results):
    linked = results.withColumn("source_type", F.lit("pdf")).withColumn("url", F.lit(""))
    answers = spark.createDataFrame([(1, "as [1] says (f1.pdf, page 1)")], "qid int, answer string")
    out = context.with_links(answers, linked.where("rank <= 3")).first().linked
    assert "[[1]](/app/static/pdfs/f0.pdf#page=0)" in out and "](/app/static/pdfs/f1.pdf#page=1))" in out


def test_evaluation(spark, results):
    cases = spark.createDataFrame([(1, ["f0.pdf", "zz"], ["TEXT", "absent"]), (2, None, None)], "qid int, expected_docs array<string>, expected_keywords array<string>")
    metrics = evaluate.retrieval_metrics(cases, results)
    assert [(r.doc_recall, r.keyword_recall) for r in metrics.orderBy("qid").collect()] == [(0.5, 0.5), (1.0, 1.0)]
    assert tuple(evaluate.retrieval_summary(metrics).first()) == (2, 0.75, 0.75)
    assert evaluate.gate(metrics, 0.75, 0.75).first().passed and not evaluate.gate(metrics, 0.76).first().passed
    assert not evaluate.gate(metrics.withColumn("doc_recall", F.lit(0.0)), any_miss=True).first().passed
    assert tuple(evaluate.retrieval_summary(metrics.where("false")).first()) == (0, 0.0, 0.0)


def test_answers(spark):
    cases = spark.createDataFrame([("a", ["Alpha"], ["bad"], True, False), ("b", [], [], False, True), ("c", ["x", "y"], [], False, False)], "qid string, expected_facts array<string>, forbidden_terms array<string>, must_have_citation boolean, expected_unknown boolean")
    answers = spark.createDataFrame([("a", "alpha [1]"), ("b", "Je ne sais pas"), ("c", "seen x")], "qid string, answer string")
    metrics = evaluate.answer_metrics(cases, answers)
    assert [(r.ok, r.facts_recall) for r in metrics.orderBy("qid").collect()] == [(True, 1.0), (True, 1.0), (False, 0.5)]
    assert evaluate.answer_summary(metrics).first().success_rate == 0.667


def test_report_delta(spark):
    a, b = spark.createDataFrame([(0.5, 1.0)], "d double, k double"), spark.createDataFrame([(0.75,)], "d double")
    rows = {r.metric: (r.delta, r.label) for r in evaluate.report_delta(a, b, ("d", "k")).collect()}
    assert rows == {"d": (0.25, "+0.25"), "k": (-1.0, "-1.00")}


def test_corpus(spark, tmp_path):
    old = spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, text string")
    new = spark.createDataFrame([("u2", "c"), ("u3", "d")], "url string, text string")
    assert sorted(tuple(r) for r in corpus.upsert(old, new).collect()) == [("u1", "a"), ("u2", "c"), ("u3", "d")]
    assert corpus.delete(old, "u1").count() == 1
    root = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        store.current(spark, root, "url string, text string")
    store.publish(old, root)
    store.publish(new, root)
    assert {r.url for r in store.current(spark, root, "url string, text string").collect()} == {"u2", "u3"}
    assert store.read_or_empty(spark, f"{root}/none", store.CHUNK_SCHEMA).count() == 0


def test_cases_and_reports(spark, tmp_path):
    good = tmp_path / "q.json"
    good.write_text('[{"question": "why", "expected_docs": ["a"]}]')
    assert store.retrieval_cases(spark, str(good)).first().qid == "why"
    for bad in ('{"a": 1}', '[{"question": ""}]', "[3]"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            store.retrieval_cases(spark, str(tmp_path / "bad.json"))
    (tmp_path / "a.json").write_text('{"c1": "yes"}')
    assert tuple(store.prebuilt_answers(spark, str(tmp_path / "a.json")).first()) == ("c1", "yes")
    summary, rows = spark.createDataFrame([(1, 0.5)], "questions int, mean double"), spark.createDataFrame([("a", 0.5)], "qid string, doc_recall double")
    store.write_report(str(tmp_path / "report"), {"top_k": 8}, summary, rows)
    report = store.read_report(spark, str(tmp_path / "report"))
    assert report["summary"] == {"questions": 1, "mean": 0.5} and report["results"][0]["qid"] == "a" and report["configuration"] == {"top_k": 8}


def test_bm25_where_every_text_is_a_candidate(spark):
    texts = spark.createDataFrame([(k, " ".join(f"word{j % 7}" for j in range(k, 2 * k))) for k in range(12)] + [(90, None), (91, "other")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "word1 word5"), (2, "word0 absent"), (3, "absent")], "qid int, query_text string")
    pairs = asked.select("qid").crossJoin(texts.select("chunk_id"))
    score = lambda **more: {(r.qid, r.chunk_id): round(r.lexical, 9) for r in lexical.bm25_candidates(pairs, asked, texts=texts, **more).collect()}
    assert len(score(every=True)) == 3 * 14 and score(every=True) == score()
