import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = steps[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == names
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    first, second, third, fourth = (texts(steps[n]) for n in ("language_id", "near_dedup", "substring_dedup", "decontamination"))
    everything = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(first) >= {i for i, t in everything.items() if len(t) > 40}
    near = brute.near(sorted(first.items()))
    assert second == {i: first[i] for i in first if near[i][2]}
    for (i, t), (n, gone, _) in zip(second.items(), brute.repeats(second.values(), 35)):
        assert third[i] == t if not gone else len(third[i].split()) == n - gone
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute.leaks(third.items(), items)}
    assert fourth == {i: t for i, t in third.items() if i not in leaked}
    assert {r.doc_id for r in steps["packing"].collect()} == set(fourth)
    assert corpus_pipeline.run(spark, SF).count() == steps["packing"].count()


def test_empty_and_odd(spark):
    rows = [(None, "some null key text of a few words", "en", "s", 1), (1, None, None, None, None), (2, "dup text is here and there", "en", "s", 2), (2, "dup text is here and there", "en", "s", 2)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for some in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, some, SF).count()
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 1, 2]
