"""Keyed writes: what a table holds after an upsert, a delete or an insert, and idempotent partition writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` after an upsert of `new`: the columns of `new` replace those of `old`, columns it lacks stay as they are."""
    other = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("is_new"))
    both = old.join(fresh, keys, "full")
    return both.select(
        *keys, *[F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in other]
    )


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` after an insert of those rows of `new` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(old.columns))


def deleted(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """`old` without the keys in `gone`."""
    return old.join(gone.select(*keys), keys, "left_anti").select(old.columns)


def replace_partitions(frame: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions of `by` that `frame` holds: repeating the write changes nothing."""
    frame.repartition(F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
