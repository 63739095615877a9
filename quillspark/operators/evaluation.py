"""Evaluation of routing and answers. Verdicts are three-valued: an unknown one leaves both sides of a ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

from .metrics import ratio

ROUTES = ("DOCUMENT", "GENERAL", "MIXED")


def share(verdict: Column) -> Column:
    """Share of true among the known verdicts."""
    return ratio(verdict, verdict.isNotNull())


def confusion(frame: DataFrame, true_col: str, pred_col: str, labels: tuple[str, ...] = ROUTES) -> DataFrame:
    """Counts by true label (rows) and predicted label (columns); zero cells stay, unknown labels go."""
    every = frame.sparkSession.createDataFrame([(x,) for x in labels], f"{true_col} string")
    known = frame.where(F.col(true_col).isin(*labels) & F.col(pred_col).isin(*labels))
    counts = known.groupBy(true_col).pivot(pred_col, list(labels)).count()
    return every.join(counts, true_col, "left").na.fill(0)


def agreement(frame: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two 0/1 columns; kappa is null on no rows or where chance agrees always."""
    both = frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.agg(
        F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"),
        F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"),
    )
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return n.select("n", "agreement", F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def best_threshold(frame: DataFrame, score_col: str, positive_col: str) -> DataFrame:
    """tau and accuracy of the best rule `score >= tau` over midpoints of neighbouring distinct scores (and below and
    above all); the smallest of equally good ones.

    Distinct scores are dealt by range; running counts stay inside a range, and only sums per range meet.
    """
    by_score = frame.groupBy(F.col(score_col).alias("score")).agg(
        F.count_if(F.col(positive_col)).alias("pos"), F.count_if(~F.col(positive_col)).alias("neg")
    )
    dealt = saved(by_score.repartitionByRange("score").withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("score").alias("top"))
    ranges = Window.orderBy("range")  # one row a range
    upto = ranges.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("neg_before"), F.coalesce(F.sum("p").over(upto), F.lit(0)).alias("pos_before"),
        F.lag("top").over(ranges).alias("top_before"), F.sum("p").over(Window.partitionBy()).alias("all_pos"), F.sum(F.col("p") + F.col("n")).over(Window.partitionBy()).alias("all"),
    )
    order = Window.partitionBy("range").orderBy("score")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = dealt.withColumns({"lower": F.lag("score").over(order), "n": F.coalesce(F.sum("neg").over(before), F.lit(0)), "p": F.coalesce(F.sum("pos").over(before), F.lit(0))})
    marked = marked.join(F.broadcast(bases), "range")  # as many rows as partitions
    lower = F.coalesce("lower", "top_before")
    right = F.col("neg_before") + F.col("n") + F.col("all_pos") - F.col("pos_before") - F.col("p")
    rules = marked.select(F.coalesce((F.col("score") + lower) / 2, F.col("score")).alias("tau"), (right / F.col("all")).alias("accuracy"))
    return rules.agg(F.max(F.struct("accuracy", (-F.col("tau")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("tau"), F.col("best.accuracy").alias("accuracy"))


def duplicates(frame: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key occurred earlier in the order."""
    return frame.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("nth > 1").drop("nth")


def last_per(frame: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return frame.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("nth = 1").drop("nth")
