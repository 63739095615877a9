"""Connected components of a link table by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component_id) for every node of `edges` (a, b), component_id being the smallest node reachable.

    Large-star and small-star alternate until the links no longer change. Each half-round is one partial
    aggregation and one join on the node, so a node with very many links is pre-aggregated and the join can be
    split when skewed. Null ends, loops and repeated links are ignored; an empty table gives an empty result.
    """
    current = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        both = _directed(current)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star on the result: every node's smaller neighbours and itself hang on the least of them
        large = saved(large)
        low = large.where("b < a").groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.where("b < a")
            .join(low, "a")
            .select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        current = saved(small)
        digest = current.agg(
            F.count("*").alias("n"),
            F.sum(F.pmod(F.xxhash64("a", "b"), F.lit((1 << 31) - 1))).alias("h"),
        ).first()
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return stars.union(stars.select(F.col("component_id").alias("node"), "component_id")).distinct()
