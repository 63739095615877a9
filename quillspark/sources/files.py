"""Small text formats: JSON lines that writers append to, flat YAML maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BROKEN = "_broken_line"


def append_records(frame: DataFrame, path: str) -> None:
    """Append rows as JSON lines. A commit adds whole files, so a writer that is stopped leaves nothing half written."""
    frame.write.mode("append").json(path)


def whole_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON lines; lines that do not parse, as other writers leave them when stopped, and blank ones go."""
    lines = spark.read.text(path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    parsed = lines.select(F.from_json("value", f"{schema}, {_BROKEN} string", options).alias("r")).where("r is not null").select("r.*")
    return parsed.where(F.col(_BROKEN).isNull()).drop(_BROKEN)


def flat_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(key, filename) of a flat YAML map of names: one `key: value` a line, with or without quotes; comments go.

    The last entry of a key in a file wins in YAML; here a key is expected once, and repeated ones give a row each.
    """
    line = F.trim("value")
    entry = r"""^([^#:"'][^:]*?)\s*:\s+(?:"([^"]*)"|'([^']*)'|(.*?))(?:\s+#.*)?$"""
    part = lambda n: F.nullif(F.regexp_extract(line, entry, n), F.lit(""))
    pairs = spark.read.text(path).select(part(1).alias("key"), F.coalesce(part(2), part(3), part(4)).alias("filename"))
    return pairs.where("key is not null")
