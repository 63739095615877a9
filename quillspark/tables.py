"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each local application that names none, as in tests.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session, whose executors are this machine, may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="spark-")
    return named.rstrip("/")


def saved(frame: DataFrame) -> DataFrame:
    """Cut lineage: write `frame` to a new table in the shared folder and read that table."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
