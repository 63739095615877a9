"""Tables of statements: named subtotals, and tables rebuilt from words on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved
from .chunking import anchored_rows

#: A subtotal may differ by so much, or by this share of itself; classes of tolerance, each ten times wider.
TOLERANCE, RELATIVE, CLASSES = 0.015, 1e-6, 12
#: What counts as an amount; blank space between columns, amounts of a column at least, share of amounts among a page's words.
AMOUNT, COLUMN_GAP, LEAST_AMOUNTS, LEAST_SHARE = r"^\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?$", 4.0, 2, 0.25


def named_subtotals(rows: DataFrame, table_col: str = "table_id", pos_col: str = "pos") -> DataFrame:
    """(table, pos, value, name) of the figures without a label.

    `rows` (table, pos, kind, label, value) are items (a value), headings (a label) and figures (a value to be named), pos in
    order and distinct in a table. A figure is named after the nearest heading before it from which on the items add up to it
    within tolerance; an earlier figure closes what lies before. No such heading: `Subtotal`. With running sums, the wanted
    heading is the one whose sum is the figure's sum less its value: an equi-join on bins as wide as the tolerance.
    """
    before = Window.partitionBy(table_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, -1)
    section = F.coalesce(F.sum(F.when(F.col("kind") == "figure", 1).otherwise(0)).over(before), F.lit(0))
    placed = rows.withColumn("section", section)
    upto = Window.partitionBy(table_col, "section").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    placed = saved(placed.withColumn("sum", F.coalesce(F.sum(F.when(F.col("kind") == "item", F.col("value"))).over(upto), F.lit(0.0))))
    room = F.greatest(F.lit(TOLERANCE), F.abs("value") * RELATIVE)
    size = F.least(F.lit(CLASSES), F.greatest(F.lit(0), F.ceil(F.log10(room / TOLERANCE)))).cast("int")
    width = lambda c: F.lit(2 * TOLERANCE) * F.pow(F.lit(10.0), c)
    figures = placed.where("kind = 'figure'").select(table_col, "section", F.col(pos_col).alias("at"), "value", "sum", room.alias("room"), size.alias("size"))
    want = F.col("sum") - F.col("value")
    bins = F.array_distinct(F.array(F.floor((want - F.col("room")) / width(F.col("size"))), F.floor((want + F.col("room")) / width(F.col("size")))))
    # beyond the widest class the tolerance outgrows a bin: then all bins between
    bins = F.when(F.col("room") * 2 > width(F.col("size")), F.sequence(F.element_at(bins, 1), F.element_at(bins, -1))).otherwise(bins)
    asked = figures.withColumn("bin", F.explode(bins))
    headings = placed.where("kind = 'heading'").select(table_col, "section", F.col(pos_col).alias("head"), "label", F.col("sum").alias("head_sum"))
    used = [r["size"] for r in figures.select("size").distinct().collect()]  # CLASSES at most
    listed = headings.withColumn("size", F.explode(F.array(*[F.lit(c) for c in used] or [F.lit(0)]))).withColumn("bin", F.floor(F.col("head_sum") / width(F.col("size"))))
    total = F.col("sum") - F.col("head_sum")
    met = asked.join(listed, [table_col, "section", "size", "bin"]).where((F.col("head") < F.col("at")) & (F.abs(total - F.col("value")) <= F.col("room")) & (F.abs(total) > 1e-9))
    nearest = met.groupBy(table_col, "at").agg(F.max_by("label", "head").alias("label"))
    named = figures.join(nearest, [table_col, "at"], "left")
    name = F.coalesce(F.concat("label", F.lit(" (subtotal)")), F.lit("Subtotal"))
    return named.select(table_col, F.col("at").alias(pos_col), "value", name.alias("name"))


def _is_amount(text: Column) -> Column:
    return text.rlike(AMOUNT)


def amount_columns(words: DataFrame, page_col: str = "page", gap: float = COLUMN_GAP, least: int = LEAST_AMOUNTS) -> DataFrame:
    """(page, col, left, right, n): columns of amounts, by a sweep from left to right: a column ends where the next amount begins
    more than `gap` beyond all that began before. Columns of fewer than `least` amounts are none."""
    amounts = words.where(_is_amount(F.col("text")))
    order = Window.partitionBy(page_col).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = amounts.withColumn("fresh", F.when(F.col("x0") > reach + gap, 1).otherwise(0))
    spans = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(page_col, "run").agg(
        F.min("x0").alias("left"), F.max("x1").alias("right"), F.count("*").alias("n")
    )
    kept = spans.where(F.col("n") >= least)
    return kept.withColumn("col", F.row_number().over(Window.partitionBy(page_col).orderBy("left"))).select(page_col, "col", "left", "right", "n")


def rebuilt_tables(words: DataFrame, page_col: str = "page", tolerance: float = 3.0, share: float = LEAST_SHARE) -> DataFrame:
    """(page, row, label, col, header, amount): the amounts of tables without rules, from words (page, x0, x1, y, text).

    Words within `tolerance` of a row's first height are a row. Amounts make columns (`amount_columns`); an amount belongs to
    the column it lies in. Words of the rows above the first amount are headers of the column that they overlap most (the
    leftmost on ties), top down; words left of all columns are a row's label. A page is prose, and no table, where amounts are
    fewer than `share` of its words. All works on pages, whose words are few.
    """
    placed = anchored_rows(words, page_col, "y", tolerance)
    rates = placed.groupBy(page_col).agg(F.avg(_is_amount(F.col("text")).cast("double")).alias("rate"))
    placed = saved(placed.join(rates.where(F.col("rate") >= share).select(page_col), page_col, "left_semi"))
    columns = saved(amount_columns(placed, page_col))
    edges = columns.groupBy(page_col).agg(F.min("left").alias("first_left"))
    inside = placed.where(_is_amount(F.col("text"))).join(columns, page_col).where((F.col("x0") >= F.col("left")) & (F.col("x1") <= F.col("right")))
    cells = inside.select(page_col, "row_no", "col", F.col("text").alias("amount"), "x0")
    cells = cells.groupBy(page_col, "row_no", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "amount"))), lambda c: c["amount"]), " ").alias("amount"))
    top = cells.groupBy(page_col).agg(F.min("row_no").alias("top"))
    others = placed.where(~_is_amount(F.col("text"))).join(top, page_col)
    overlap = F.least("x1", "right") - F.greatest("x0", "left")
    above = others.where(F.col("row_no") < F.col("top")).join(columns, page_col).withColumn("overlap", overlap).where("overlap > 0")
    best = above.groupBy(page_col, "row_no", "x0", "text").agg(F.max_by("col", F.struct("overlap", -F.col("col"))).alias("col"))
    heads = best.groupBy(page_col, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "x0", "text"))), lambda w: w["text"]), " ").alias("header"))
    left = others.where(F.col("row_no") >= F.col("top")).join(edges, page_col).where(F.col("x1") <= F.col("first_left"))
    labels = left.groupBy(page_col, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("label"))
    out = cells.join(labels, [page_col, "row_no"], "left").join(heads, [page_col, "col"], "left")
    return out.select(page_col, F.col("row_no").alias("row"), "label", "col", "header", "amount")
