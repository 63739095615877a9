"""Session defaults and typed table readers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that results depend on; cluster sizing stays with the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "12g", app: str = "quillspark") -> SparkSession:
    """A local session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; zone-less timestamps become timestamps once, here."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in frame.dtypes if kind == "timestamp_ntz"]
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else frame


#: Applications that have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the application's executors (once), for clusters where it is not installed."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, f"{root.name}/{file.relative_to(root)}")
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark
