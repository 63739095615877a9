"""Mergeable quantile sketches: kept per day, merged for any window of days, with a rank error that is measured, not hoped for.

Spark's KLL sketches hold a bounded sample of weighted values. A table of one sketch a key and day is small whatever the log's
size; a window's percentiles come from merging its days, without reading the log again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import value_ranks

#: Accuracy of a sketch: about 1 % of the ranks at 200, less the larger.
K = 400


def daily_sketches(frame: DataFrame, keys: list[str], ts_col: str, value_col: str, k: int = K) -> DataFrame:
    """(keys, day, n, sketch) of the values that are not null, by UTC day. Write it; new days are appended."""
    held = frame.where(F.col(value_col).isNotNull()).withColumn("day", F.to_date(ts_col))
    return held.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value_col).cast("double"), F.lit(k)).alias("sketch"))


def window_quantiles(days: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99), since: str | None = None, until: str | None = None) -> DataFrame:
    """(keys, n, p50, p95, ...) of the days from `since` to `until` (both included), by merging their sketches."""
    if since is not None:
        days = days.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.where(F.col("day") <= F.lit(until).cast("date"))
    merged = days.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"p{round(s * 100)}") for s in shares])


def rank_errors(frame: DataFrame, quantiles: DataFrame, keys: list[str], value_col: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(keys, share, error): how far, as a share of a group's rows, a quantile's true ranks lie from the wanted one; 0 where they
    hold it. Ranks are exact, found by ranges."""
    ranks = value_ranks(frame.withColumn(value_col, F.col(value_col).cast("double")), keys, value_col)
    long = quantiles.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"p{round(s * 100)}").alias(value_col)) for s in shares])).alias("q")).select(*keys, "q.*")
    met = long.join(ranks, [*keys, value_col], "left")
    low, high, at = F.col("before") / F.col("n"), (F.col("before") + F.col("c")) / F.col("n"), F.col("share")
    return met.select(*keys, "share", F.greatest(low - at, at - high, F.lit(0.0)).alias("error"))
