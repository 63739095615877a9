"""Page geometry and tables: words in boxes, area of a union, cleaned tables, highlighted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_in_boxes(words: DataFrame, boxes: DataFrame, page_col: str) -> DataFrame:
    """Words (x, y) with the boxes (x0, y0, x1, y1) of their page that hold them."""
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return words.join(boxes, page_col).where(inside)


def union_area(boxes: DataFrame, page_col: str) -> DataFrame:
    """(page, area): area that a page's boxes cover together. The page is cut into strips at every box's x edges; in a
    strip, overlapping y intervals merge by a running maximum. Strips are as many as twice a page's boxes."""
    edges = boxes.select(page_col, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    strips = edges.withColumn("right", F.lead("left").over(Window.partitionBy(page_col).orderBy("left"))).where("right is not null")
    covered = strips.join(boxes, page_col).where("x0 <= left and x1 >= right and y1 > y0")
    order = Window.partitionBy(page_col, "left").orderBy("y0", "y1")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(reach, F.col("y0"))))
    parts = covered.withColumn("part", fresh * (F.col("right") - F.col("left")))
    return parts.groupBy(page_col).agg(F.sum("part").alias("area"))


def clean_table(rows: Column) -> Column:
    """A table padded to its widest row, without empty rows and columns."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.trim(F.coalesce(F.get(r, i), F.lit("")))))
    kept = F.filter(padded, lambda r: F.exists(r, lambda c: c != ""))
    full = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(kept, lambda r: F.get(r, i) != ""))
    return F.transform(kept, lambda r: F.transform(full, lambda i: F.get(r, i)))


def highlighted_rows(rows: DataFrame, page_col: str, words_col: str, cited: Column) -> DataFrame:
    """Rows of a page that share most words with the cited passage; all of equal best ones, none where none shares."""
    shared = rows.withColumn("shared", F.size(F.array_intersect(F.col(words_col), cited)))
    best = F.rank().over(Window.partitionBy(page_col).orderBy(F.desc("shared")))
    return shared.where("shared > 0").withColumn("place", best).where("place = 1").drop("place")


def expanded_query(query: Column, rules: dict[str, str]) -> Column:
    """A query with the expansions of the rules whose word it holds, each once, not those it holds already."""
    low = F.lower(query)
    found = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{word}\b") & ~F.contains(low, F.lit(more.lower())), more) for word, more in rules.items()]))
    return F.concat_ws(" ", query, F.array_join(F.array_distinct(found), " "))
