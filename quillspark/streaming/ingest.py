"""Incremental ingest: documents arrive as files, chunks are replaced by document, progress is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_pages

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 20, buckets: int = 64) -> StreamingQuery:
    """Chunk every arriving document into `target`, a Parquet table partitioned by a bucket of the document id.

    A batch replaces its own folder, so a batch that runs again after a crash changes nothing; of documents that
    arrive again, `current_chunks` takes the latest batch. Stops when all files present are done.
    """
    reader = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = source.rstrip("/").rpartition("/")
    if spark.read.parquet(source).inputFiles()[0].endswith(f"/{name}"):  # a table of one file: watch its folder for it
        reader, source = reader.option("pathGlobFilter", name), folder
    stream = reader.parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk_pages(batch.where("text is not null"), "doc_id", "text")
        kept = chunks.withColumns({"bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), "ingest_version": F.lit(batch_id)})
        kept.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's latest batch."""
    from pyspark.sql import Window

    every = spark.read.parquet(target)
    latest = F.max("ingest_version").over(Window.partitionBy("doc_id"))
    return every.withColumn("latest", latest).where("ingest_version = latest").drop("latest", "batch")


def ingest_status(failed_pages, total_pages, chunks):
    """FAILED over half of failed pages or without chunks, else READY."""
    return F.when(failed_pages * 2 > total_pages, "FAILED").when(chunks == 0, "FAILED").otherwise("READY")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension, on streams or tables: counts and mean value per event-time window and type, late events dropped
    after the watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(
        F.col("window.start").alias("start"), "event_type", "n", "mean"
    )
