"""Tables on a page, found from where its words stand.

Words near in height are a line, and a line's words without a wide gap between them a cell. Lines of several cells that follow
each other are a table; its columns lie between the gaps that a sweep over its cells' intervals finds, a gap being where
hardly a cell is. Everything is windows and aggregates by page, so pages are spread and nothing else is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE, CELL, BREAK, SPARE = 3.0, 12.0, 40.0, 0.2
"""Units of height between lines, of width between cells, of height between tables; share of a table's lines that may cross a column gap."""


def _lines(words: DataFrame, key: list[str], line: float) -> DataFrame:
    """words with _line, from 0 downwards. A page's words pass through one task, as many as a page holds."""
    order = Window.partitionBy(*key).orderBy("y", "x0", "x1", "word")
    step = F.col("y") - F.lag("y").over(order)
    return words.withColumn("_line", F.sum((F.coalesce(step, F.lit(0.0)) > line).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _cells(lines: DataFrame, key: list[str], gap: float) -> DataFrame:
    """key, _line, x0, x1, y, cell: the words of a line without a wide gap between them."""
    order = Window.partitionBy(*key, "_line").orderBy("x0", "x1", "word")
    before = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = lines.withColumn("_cell", F.sum((F.coalesce(F.col("x0") - before, F.lit(0.0)) > gap).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "word"))), lambda w: w["word"]), " ")
    return parted.groupBy(*key, "_line", "_cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y"), text.alias("cell"))


def _blocks(cells: DataFrame, key: list[str], apart: float) -> DataFrame:
    """The cells of lines with two or more of them, with the _table that follows from their order; at least two lines each."""
    lines = cells.groupBy(*key, "_line").agg(F.count("*").alias("_n"), F.min("y").alias("_y")).where("_n > 1")
    order = Window.partitionBy(*key).orderBy("_line")
    new = (F.col("_line") - F.lag("_line").over(order) > 1) | (F.col("_y") - F.lag("_y").over(order) > apart)
    lines = lines.withColumn("_block", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("_all", F.count("*").over(Window.partitionBy(*key, "_block"))).where("_all > 1")
    lines = lines.withColumn("_table", F.dense_rank().over(Window.partitionBy(*key).orderBy("_block")) - 1)
    return cells.join(lines.select(*key, "_line", "_table", "_all"), [*key, "_line"])


def _columns(cells: DataFrame, key: list[str], spare: float) -> DataFrame:
    """cells with _column: how many gaps of the table begin before the cell's middle.

    The sweep goes over the beginnings (+1) and ends (-1) of a table's cells; behind an end after which no more than `spare` of
    the lines have a cell, a gap reaches to the next beginning.
    """
    ends = cells.select(*key, "_table", "_all", F.explode_outer(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("step")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("step")))).alias("_e")).select(*key, "_table", "_all", "_e.*")
    order = Window.partitionBy(*key, "_table").orderBy("x", F.desc("step"))
    swept = ends.withColumn("_open", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("x").over(order)).withColumn("_then", F.lead("step").over(order))
    gaps = swept.where((F.col("step") == -1) & (F.col("_then") == 1) & (F.col("_next") > F.col("x")) & (F.col("_open") <= F.floor(spare * F.col("_all"))))
    gaps = gaps.groupBy(*key, "_table").agg(F.sort_array(F.collect_list((F.col("x") + F.col("_next")) / 2)).alias("_gaps"))
    middle = F.when(F.col("x1") - F.col("x0") > 0, (F.col("x0") + F.col("x1")) / 2).otherwise(F.col("x0"))
    start = F.least(middle, F.col("x0") + 1)  # a cell across columns belongs where it begins
    return cells.join(gaps, [*key, "_table"]).withColumn("_column", F.size(F.filter("_gaps", lambda g: g < start)))


def find_tables(words: DataFrame, key: list[str], line: float = LINE, gap: float = CELL, apart: float = BREAK, spare: float = SPARE) -> DataFrame:
    """key, tables: an array of tables, each an array of rows of cells, from the top of the page.

    words: key, x0, x1 (where a word begins and ends), y (its line's height, downwards), word. Words that are null or have no place are left out.
    Pages without a table have no row. Tables have two rows and two columns at least; a cell that is not there is ''.
    """
    sound = words.where("word is not null and x0 is not null and x1 is not null and y is not null").select(*key, *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y")), "word")
    cells = _columns(_blocks(_cells(_lines(sound, key, line), key, gap), key, apart), key, spare)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "cell"))), lambda c: c["cell"]), " ")
    one = cells.groupBy(*key, "_table", "_line", "_column").agg(F.first(F.size("_gaps")).alias("_last"), joined.alias("cell"))
    row = F.map_from_entries(F.collect_list(F.struct("_column", "cell")))
    rows = one.groupBy(*key, "_table", "_line").agg(F.first("_last").alias("_last"), row.alias("_row"))
    rows = rows.withColumn("_row", F.transform(F.sequence(F.lit(0), "_last"), lambda k: F.coalesce(F.try_element_at("_row", k), F.lit(""))))
    ordered = lambda by, value: F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda r: r[value])
    found = rows.where("_last > 0").groupBy(*key, "_table").agg(ordered("_line", "_row").alias("_rows"))
    return found.groupBy(*key).agg(ordered("_table", "_rows").alias("tables"))
