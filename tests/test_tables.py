"""Tables found from words' places."""

import random

from pyspark.sql import functions as F

from quire.operators import tables
from quire.sources import pdf

SCHEMA = "file string, page int, x0 double, x1 double, y double, word string"


def laid_out(page, top, rows, lefts, wide=5.0):
    """Words of rows of cells; None is no cell."""
    out = []
    for k, row in enumerate(rows):
        for left, cell in zip(lefts, row):
            x = float(left)
            for w in (cell or "").split():
                out.append(("f", page, x, x + wide * len(w), top + 15.0 * k + (k % 2), w))
                x += wide * (len(w) + 1)
    return out


def found(spark, words):
    df = spark.createDataFrame(words, SCHEMA).withColumn("_line", F.lit(1)).repartition(3)
    return {r.page: r.tables for r in tables.find_tables(df, ["file", "page"]).collect()}


def test_tables_of_a_page(spark):
    rng = random.Random(1)
    one = [["Model", "Raw TB", "Power draw"], ["X 10", "12", None], ["X 20", None, "700 watts"], ["Y 3", "5", "90 watts"]]
    two = [["a", "b"], ["c", "d"]]
    words = laid_out(1, 50, [["A line of prose above"]], [0]) + laid_out(1, 80, one, [0, 150, 300]) + laid_out(1, 300, two, [40, 200])
    words += laid_out(2, 10, [["only prose here"], ["and more of it"]], [0])
    words += laid_out(3, 10, [["one", "line"]], [0, 200])  # one line is no table
    words += laid_out(4, 10, [["k", "v"], ["a heading that runs over both columns of the table", None], ["m", "n"], ["o", "p"], ["q", "r"], ["s", "t"]], [0, 150])
    words += laid_out(5, 10, [[f"r{k}", str(k), f"c{k}"] for k in range(30)], [0, 60, 120])
    words += [("f", 6, None, 1.0, 2.0, "x"), ("f", 6, 0.0, 1.0, 2.0, None)]
    rng.shuffle(words)
    got = found(spark, words)
    clean = lambda rows: [[c or "" for c in r] for r in rows]
    assert got[1] == [clean(one), clean(two)] and set(got) == {1, 4, 5}
    assert got[4] == [[["m", "n"], ["o", "p"], ["q", "r"], ["s", "t"]]]
    assert got[5] == [[[f"r{k}", str(k), f"c{k}"] for k in range(30)]]
    assert found(spark, []) == {}


def test_a_cell_across_columns(spark):
    rows = [["left", "middle", "right"]] * 6 + [["spans two columns of this one", None, "end"]]
    got = found(spark, laid_out(1, 0, rows, [0, 90, 220]))
    assert got[1] == [[*[["left", "middle", "right"]] * 6, ["spans two columns of this one", "", "end"]]]


def test_pages_get_their_tables(spark):
    words = spark.createDataFrame(laid_out(1, 10, [["a", "b"], ["c", "d"]], [0, 100]), SCHEMA)
    pages = spark.createDataFrame([("f", 1, "text of the page"), ("f", 2, "no table")], "file string, page int, text string")
    out = {(r.page, r.ordinal): (r.title, r.text) for r in pdf.page_chunks(pdf.with_tables(pages, words)).collect()}
    assert out[1, 1] == ("Tableau", "TABLEAU extrait de la page 1, tableau 1\n\n| a | b |\n| --- | --- |\n| c | d |") and set(out) == {(1, 1), (1, 2), (2, 1)}
