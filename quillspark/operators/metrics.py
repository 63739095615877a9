"""Request-log metrics: percentiles, ratios that are null on an empty pool, histograms, mixes and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

# Amber and red limits, and whether a lower value is worse.
THRESHOLDS = {
    "latency_p95_ms": (4000.0, 6000.0, False), "error_rate": (0.02, 0.05, False), "abstention_rate": (0.40, 0.70, False),
    "citation_invalid_rate": (0.05, 0.15, False), "number_fail_rate": (0.10, 0.25, False), "router_fallback_rate": (0.02, 0.10, False),
    "thumbs_down_rate": (0.20, 0.40, False), "top_score": (0.55, 0.45, True), "mix_shift": (0.20, 0.40, False),
}
#: Request statuses, least severe first. Sections that ask back rank between a refusal and a document not ready.
SEVERITY = ("answered", "abstained", "needs_company", "unclear", "not_ready", "error")
# US dollars per million tokens (in, out) by model.
PRICES = {"120b": (0.15, 0.60), "20b": (0.075, 0.30), "default": (0.15, 0.60)}


def value_ranks(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, c, before, n): each distinct value of a group, how often it occurs, how many rows of the group lie
    below it, and the group's rows. Nulls are left out.

    Values are dealt by range, so a group of any size is spread over tasks; only sums per range meet.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    dealt = saved(counts.repartitionByRange(*keys, value).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "range").agg(F.sum("c").alias("sum"))
    group = Window.partitionBy(*keys)
    bases = sums.select(
        *keys, "range", (F.sum("sum").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("base"), F.sum("sum").over(group).alias("n")
    )
    inside = F.sum("c").over(Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    return dealt.withColumn("inside", inside).join(bases, [*keys, "range"]).select(*keys, value, "c", (F.col("inside") + F.col("base")).alias("before"), "n")


def summary(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group n, p50, p95, p99 (linear interpolation, exact) and mean of the values that are not null."""
    ranks = value_ranks(frame, keys, value)
    out = [F.max("n").alias("n")]
    for p in (50, 95, 99):
        at = (F.col("n") - 1) * F.lit(p / 100)
        low, high = (F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("c")), F.col(value))) for r in (F.floor(at), F.ceil(at)))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"p{p}"))
    means = frame.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"))
    return ranks.groupBy(*keys).agg(*out).join(means, keys)


def nearest_rank(frame: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, value): the value at rank round-half-even(share * (n - 1)), from 0, of each group."""
    rank = F.bround((F.col("n") - 1) * F.lit(share))
    return value_ranks(frame, keys, value).where((F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))).select(*keys, value)


def ratio(hit: Column, pool: Column) -> Column:
    """Share of the pool that hits; null on an empty pool."""
    return F.try_divide(F.count_if(hit & pool).cast("double"), F.count_if(pool).cast("double"))


def severity(status: Column) -> Column:
    """A status's place in SEVERITY; an unknown status is as bad as an error."""
    place = F.lit(len(SEVERITY) - 1)
    for n, name in enumerate(SEVERITY):
        place = F.when(status == name, n).otherwise(place)
    return place


def worst_status(status: Column) -> Column:
    """Aggregate: the most severe status."""
    return F.get(F.array(*[F.lit(s) for s in SEVERITY]), F.max(severity(status)))


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a call's tokens; an unknown model has the default price."""
    price_in, price_out = F.lit(PRICES["default"][0]), F.lit(PRICES["default"][1])
    for name, (a, b) in PRICES.items():
        price_in, price_out = F.when(model == name, a).otherwise(price_in), F.when(model == name, b).otherwise(price_out)
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def histogram(frame: DataFrame, value_col: str, width: float, buckets: int) -> DataFrame:
    """Counts in `buckets` buckets of a fixed width and one for what is beyond; empty buckets are kept."""
    at = F.least(F.floor(F.col(value_col) / width), F.lit(buckets)).cast("int")
    counts = frame.where(F.col(value_col).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    every = frame.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").na.fill(0, ["n"])


def weekly_mix(frame: DataFrame, ts_col: str, part_col: str) -> DataFrame:
    """(week, part, n, share): shares of each part per week that starts on Monday (UTC)."""
    counts = frame.groupBy(F.date_trunc("week", ts_col).cast("date").alias("week"), F.col(part_col).alias("part")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("week")))


def mix_shift(mix: DataFrame) -> DataFrame:
    """(week, shift): total variation between each week's mix and that of the calendar week before; null after a gap."""
    before = mix.select(F.date_add("week", 7).alias("week"), "part", F.col("share").alias("earlier"))
    weeks, earlier = mix.select("week").distinct(), before.select("week").distinct()
    both = mix.select("week", "part", "share").join(before, ["week", "part"], "full").na.fill(0.0, ["share", "earlier"])
    moved = both.groupBy("week").agg((F.sum(F.abs(F.col("share") - F.col("earlier"))) / 2).alias("moved"))
    return (
        weeks.join(earlier.withColumn("known", F.lit(True)), "week", "left").join(moved, "week")
        .select("week", F.when(F.col("known"), F.col("moved")).alias("shift"))
    )


def indicator(name: str, value: Column, n: Column, least: int = 5) -> Column:
    """grey (too few or no value), green, amber or red; a limit itself is still good."""
    amber, red, lower_is_worse = THRESHOLDS[name]
    sign = -1 if lower_is_worse else 1
    return (
        F.when(value.isNull() | (n < least), "grey").when(value * sign > red * sign, "red").when(value * sign > amber * sign, "amber").otherwise("green")
    )


def rolling_budget(frame: DataFrame, group_col: str, ts_col: str, cost_col: str, seconds: int = 60, span: int = 3600) -> DataFrame:
    """Add `spent`: the group's cost over the `seconds` up to and with each row.

    Costs are summed by second first. A window covers a group's `span` of seconds and the `seconds` before it, so a group
    of any length is dealt to many tasks.
    """
    at = F.floor(F.col(ts_col).cast("timestamp").cast("double"))
    timed = frame.withColumn("at_second", at)
    sums = timed.groupBy(group_col, "at_second").agg(F.sum(cost_col).alias("cost"))
    own, later = F.floor(F.col("at_second") / span), F.floor((F.col("at_second") + seconds) / span)
    copied = sums.withColumn("part", F.explode(F.array_distinct(F.array(own, later)))).withColumn("own", own == F.col("part"))
    window = Window.partitionBy(group_col, "part").orderBy("at_second").rangeBetween(-seconds, 0)
    spent = copied.withColumn("spent", F.sum("cost").over(window)).where("own").select(group_col, "at_second", "spent")
    return timed.join(spent, [group_col, "at_second"], "left").select(*frame.columns, "spent")


def islands(frame: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """(keys, cluster, n, low, high): runs of a group's values in which each lies at most `gap` above the one before, numbered
    from 0. Nulls are left out.

    Values are dealt by range, as in `value_ranks`; one row a range carries the last value and the number of runs on.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    dealt = saved(counts.repartitionByRange(*keys, value).withColumn("range", F.spark_partition_id()))
    inside, across = Window.partitionBy(*keys, "range").orderBy(value), Window.partitionBy(*keys).orderBy("range")
    marked = dealt.withColumn("fresh", (F.col(value) - F.lag(value).over(inside) > gap).cast("long"))
    ends = dealt.groupBy(*keys, "range").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    begins = F.when(F.col("low") - F.lag("high").over(across) > gap, 1).otherwise(0)
    runs = marked.groupBy(*keys, "range").agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("runs"))
    steps = ends.withColumn("begins", begins).join(runs, [*keys, "range"])
    before = F.sum(F.col("begins") + F.col("runs")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs")
    base = steps.select(*keys, "range", before.alias("base"))
    placed = marked.withColumn("inside", F.sum(F.coalesce("fresh", F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(base, [*keys, "range"])
    clusters = placed.withColumn("cluster", (F.col("base") + F.col("inside")).cast("long")).groupBy(*keys, "cluster")
    return clusters.agg(F.sum("c").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
