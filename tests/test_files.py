"""A table in step with a folder: every run against a full rebuild."""

import os

from pyspark.sql import functions as F

from quire.sources import files

SCHEMA = "path string, line int, text string"


def test_three_runs_over_a_changing_folder(spark, tmp_path, monkeypatch):
    folder, root, read = tmp_path / "in", f"file://{tmp_path}/table", []
    (folder / "deeper").mkdir(parents=True)

    def parse(found):
        read.append(sorted(os.path.basename(r.path) for r in found.select("path").collect()))
        return found.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "text")).where("text <> ''")

    def write(name, body, at):
        (folder / name).write_text(body)
        os.utime(folder / name, (at, at))

    def run():
        read.clear()
        out = files.ingest(spark, f"file://{folder}", root, SCHEMA, parse, glob="*.txt", buckets=4)
        found = sorted((os.path.relpath(r.path.removeprefix("file:"), folder), r.line, r.text) for r in files.table(spark, root, SCHEMA, 4).read().collect())
        want = sorted((os.path.relpath(p, folder), k, x) for p in folder.rglob("*.txt") for k, x in enumerate(p.read_text().split("\n")) if x)
        assert found == want
        return (out.added, out.changed, out.removed), sorted(x for r in read for x in r)

    assert run() == ((0, 0, 0), [])
    for name, body in (("a.txt", "one\ntwo"), ("b.txt", "three"), ("deeper/c.txt", "four"), ("empty.txt", ""), ("note.md", "no")):
        write(name, body, 1_000_000)
    assert run() == ((3, 0, 0), ["a.txt", "b.txt", "c.txt"])
    assert run() == ((0, 0, 0), [])
    write("a.txt", "one\nTWO", 2_000_000)  # as long, later
    write("b.txt", "three!", 1_000_000)  # as old, longer
    write("d.txt", "five", 2_000_000)
    os.remove(folder / "deeper" / "c.txt")
    assert run() == ((1, 2, 1), ["a.txt", "b.txt", "d.txt"])
    monkeypatch.setattr(files, "PASS", 1)
    write("a.txt", "again", 3_000_000)
    write("e.txt", "six", 3_000_000)
    broken, files.LogTable.upsert = files.LogTable.upsert, None
    try:
        run()
    except TypeError:
        pass  # lost between reading and writing
    finally:
        files.LogTable.upsert = broken
    assert run()[1] == ["a.txt", "e.txt"]
    for p in folder.rglob("*.txt"):
        p.unlink()
    assert run()[0][2] == 4 and files.table(spark, root, SCHEMA, 4).read().count() == 0
    files.forget(spark, root)
    assert files.ingest(spark, f"file://{tmp_path}/nowhere", root, SCHEMA, parse).added == 0
