"""The table with a log of versions, and the caches of calls that are kept in it."""

import random
import threading
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.sources import caches, log, store

SCHEMA = "url string, text string"


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(table, version=None):
    return sorted((r.url, r.text) for r in table.read(table.snapshot(version)).collect())


def test_versions(spark, tmp_path):
    table = log.LogTable(spark, f"file://{tmp_path}/t", SCHEMA, "url", 8)
    assert content(table) == [] and table.snapshot().version == 0
    pages = [(f"u{k}", f"{k}") for k in range(40)]
    assert table.upsert(rows(spark, *pages)) == 1
    assert table.upsert(rows(spark, ("u1", "new"), ("u1", "second"), ("u99", None))) == 2
    want = sorted([p for p in pages if p[0] != "u1"] + [("u1", "new"), ("u1", "second"), ("u99", None)], key=repr)
    assert sorted(content(table), key=repr) == want and content(table, 1) == sorted(pages)
    assert table.delete(rows(spark, ("u1", ""), ("nowhere", "")).select("url")) == 3
    assert {u for u, _ in content(table)} == {f"u{k}" for k in range(40) if k != 1} | {"u99"}
    assert table.append(rows(spark, ("u2", "more"))) == 4 and len([x for x in content(table) if x[0] == "u2"]) == 2
    before = content(table)
    assert table.compact() == 5 and content(table) == before and len(table.snapshot().parts) == len(set(table.snapshot().parts.values()))
    assert table.upsert(rows(spark)) == 6 and content(table) == before
    assert table.overwrite(rows(spark, ("z", "z"))) == 7 and content(table) == [("z", "z")]
    with pytest.raises(FileNotFoundError):
        table.snapshot(99)


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    table = log.LogTable(spark, f"file://{tmp_path}/t", SCHEMA, "url", 64)
    table.overwrite(rows(spark, *((f"u{k}", "x" * 50) for k in range(2000))))
    before = table.snapshot()
    table.upsert(rows(spark, ("u7", "y"), ("u8", "y")))
    after = table.snapshot()
    assert len(before.parts.keys() - after.parts.keys()) <= 2 and len(after.parts.keys() - before.parts.keys()) <= 4
    size = lambda parts: sum(f.stat().st_size for p in parts for f in (tmp_path / "t" / p).iterdir())
    assert size(after.parts.keys() - before.parts.keys()) < 0.2 * size(before.parts)
    assert len(content(table)) == 2000


def test_many_versions_and_vacuum(spark, tmp_path):
    table = log.LogTable(spark, f"file://{tmp_path}/t", SCHEMA, "url", 2)
    for k in range(log.WHOLE + 3):
        table.upsert(rows(spark, ("u", str(k)), (f"v{k % 3}", str(k))))
    last = content(table)
    assert table.snapshot().version == log.WHOLE + 3 and ("u", str(log.WHOLE + 2)) in last and len(last) == 4
    assert table.vacuum(2) > 0 and content(table) == last and len(content(table, log.WHOLE + 2)) == 4
    assert min(table.versions()) >= 1 and table.vacuum(2) >= 0
    assert sum(1 for p in (tmp_path / "t" / "data").rglob("*.parquet")) <= 2 * len(table.snapshot().parts) + 4
    assert table.upsert(rows(spark, ("w", "w"))) == log.WHOLE + 4 and ("w", "w") in content(table)


def test_two_writers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    tables = [log.LogTable(spark, root, SCHEMA, "url", 1) for _ in range(3)]
    tables[0].overwrite(rows(spark, ("old", "old")))
    real, gate = log.create_if_absent, threading.Barrier(3, timeout=60)
    waited = threading.local()

    def together(*args):
        if not getattr(waited, "done", False):  # all three have read the same version
            waited.done = True
            gate.wait()
        return real(*args)

    log.create_if_absent = together
    try:
        work = [threading.Thread(target=t.upsert, args=(rows(spark, (f"w{k}", "x"), ("shared", str(k))),)) for k, t in enumerate(tables)]
        for t in work:
            t.start()
        for t in work:
            t.join()
    finally:
        log.create_if_absent = real
    found = content(tables[0])
    assert {u for u, _ in found} == {"old", "w0", "w1", "w2", "shared"} and len(found) == 5
    assert tables[0].versions() == [1, 2, 3, 4] and sum(t.retries for t in tables) >= 2


def test_apart_writers_do_not_begin_anew(spark, tmp_path, monkeypatch):
    table = log.LogTable(spark, f"file://{tmp_path}/t", SCHEMA, "url", 64)
    table.overwrite(rows(spark, *((f"u{k}", "x") for k in range(200))))
    real, other, first = log.create_if_absent, log.LogTable(spark, table.root, SCHEMA, "url", 64), []
    bucket = {r.url: r.b for r in rows(spark, ("u1", ""), ("u2", ""), ("u3", ""), ("u4", "")).select("url", table.bucket().alias("b")).collect()}
    away = next(u for u in bucket if bucket[u] != bucket["u1"])

    def late(*args):
        if not first:
            first.append(1)
            other.upsert(rows(spark, (away, "other")))
        return real(*args)

    monkeypatch.setattr(log, "create_if_absent", late)
    written = []
    monkeypatch.setattr(table, "_write", lambda df, f=table._write: written.append(1) or f(df))
    assert table.upsert(rows(spark, ("u1", "mine"))) == 3 and table.retries == 1 and len(written) == 2
    assert dict(content(table))["u1"] == "mine" and dict(content(table))[away] == "other" and len(content(table)) == 200


def test_a_stream_s_batch_counts_once(spark, tmp_path):
    table = log.LogTable(spark, f"file://{tmp_path}/t", SCHEMA, "url", 4)
    assert table.upsert(rows(spark, ("a", "1")), "s", 0) == 1 and table.upsert(rows(spark, ("a", "again")), "s", 0) == 1
    assert table.upsert(rows(spark, ("a", "2")), "s", 1) == 2 and table.upsert(rows(spark, ("b", "3")), "other", 0) == 3
    assert content(table) == [("a", "2"), ("b", "3")]


def test_published_versions_go_by_number(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    for k in range(3):
        assert store.publish(rows(spark, ("u", str(k))), root) == k + 1
    for f in (tmp_path / "p" / "_log").iterdir():
        import os

        os.utime(f, (1, 1))  # times say nothing
    assert [r.text for r in store.current(spark, root, SCHEMA).collect()] == ["2"]


def asked(spark, n=40):
    return spark.createDataFrame([(k, f"key{k % 30:02d}") for k in range(n)], "qid long, key string")


def counting(folder, fail=()):
    """A call whose replies are random, and which leaves a file for each call."""

    @F.udf(StringType())
    def call(key):
        Path(folder, f"{key}-{uuid.uuid4().hex}").touch()
        return None if key in fail else f"{key} {random.random()}"

    return lambda missing: missing.select("key", call.asNondeterministic()("key").alias("rewrite"))


def calls(folder):
    return sorted(p.name.split("-")[0] for p in Path(folder).iterdir())


def test_a_random_model_is_called_once_a_key(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    cache = caches.CallCache(spark, f"file://{tmp_path}/cache", caches.REWRITES, buckets=4, calls=10)
    out = cache.through(asked(spark), counting(tmp_path / "calls", {"key03"}))
    first, kept = {r.qid: r.rewrite for r in out.collect()}, {r.key: r.rewrite for r in cache.load().collect()}
    again = {r.qid: r.rewrite for r in out.collect()}
    assert first == again and {k: kept.get(f"key{k % 30:02d}") for k in range(40)} == first
    assert calls(tmp_path / "calls") == [f"key{k:02d}" for k in range(30)] and "key03" not in kept and len(kept) == 29
    assert {r.qid: r.rewrite for r in cache.through(asked(spark), counting(tmp_path / "calls")).collect()} | {3: None, 33: None} == first
    assert calls(tmp_path / "calls").count("key03") == 2 and len(calls(tmp_path / "calls")) == 31
    cache.table.compact()
    assert cache.load().count() == 30


def test_a_cache_goes_on_where_a_run_ended(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    cache = caches.CallCache(spark, f"file://{tmp_path}/cache", caches.REWRITES, buckets=8, calls=1)
    good, steps = counting(tmp_path / "calls"), []

    def breaks(missing):
        steps.append(1)
        if len(steps) == 4:
            raise RuntimeError("lost")
        return good(missing)

    with pytest.raises(RuntimeError):
        cache.through(asked(spark), breaks)
    done = cache.load().count()
    assert 0 < done < 30
    cache.through(asked(spark), good)
    assert calls(tmp_path / "calls") == [f"key{k:02d}" for k in range(30)] and cache.load().count() == 30


def test_two_callers_share_the_calls(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    found = {}

    def run(name):
        cache = caches.CallCache(spark, f"file://{tmp_path}/cache", caches.REWRITES, buckets=2, calls=1)
        found[name] = {r.key: r.rewrite for r in cache.through(asked(spark), counting(tmp_path / "calls")).collect()}

    work = [threading.Thread(target=run, args=(n,)) for n in "ab"]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert found["a"] == found["b"] and calls(tmp_path / "calls") == [f"key{k:02d}" for k in range(30)]


def test_claims_run_out(spark, tmp_path):
    cache = caches.CallCache(spark, f"file://{tmp_path}/cache", caches.REWRITES, buckets=1, patience=0.5)
    cache._claim(0)
    began = time.time()
    other = caches.CallCache(spark, f"file://{tmp_path}/cache", caches.REWRITES, buckets=1)
    other._claim(0)
    assert time.time() - began >= 0.4
    cache._release(0)  # not its own any more
    assert (tmp_path / "cache" / "_claims" / "0").exists()
    other._release(0)
    assert not (tmp_path / "cache" / "_claims" / "0").exists()
