"""Requests and their later feedback as a stream-stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_feedback(requests: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests (trace_id, ts, ...) outer-joined with feedback (trace_id, feedback_ts, thumb) of up to `within` later.

    On streams, rows that come after the watermark (`late` behind the newest) are dropped, and a request without feedback
    goes on, with nulls, once none can follow. Feedback of before the request or of more than `within` later never counts.
    """
    if requests.isStreaming:
        requests, feedback = requests.withWatermark("ts", late), feedback.withWatermark("feedback_ts", late)
    said = feedback.select(F.col("trace_id").alias("said_trace_id"), "feedback_ts", "thumb")
    near = F.expr(f"trace_id = said_trace_id and feedback_ts >= ts and feedback_ts <= ts + interval {within}")
    return requests.join(said, near, "left_outer").drop("said_trace_id")


def follow_feedback(
    spark: SparkSession, requests: str, feedback: str, target: str, checkpoint: str, within: str = "1 hour", late: str = "10 minutes", files_per_batch: int = 1,
) -> StreamingQuery:
    """Join the request files and the feedback files that lie there, and add the joined rows to `target`, each batch once."""

    def stream(path: str) -> DataFrame:
        return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    joined = with_feedback(stream(requests), stream(feedback), within, late)
    writer = joined.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def request_rows(joined: DataFrame) -> DataFrame:
    """One row per trace_id of joined rows: the columns of its newest request row, and its newest feedback. A request row
    that comes again, or later, changes no feedback; feedback changes nothing else."""
    said = ("feedback_ts", "thumb")
    own = [c for c in joined.columns if c not in ("trace_id", *said)]
    newest = F.max_by(F.struct(*own), F.struct("ts", F.xxhash64(*own))).alias("row")
    last = F.max(F.when(F.col("feedback_ts").isNotNull(), F.struct(*said))).alias("said")
    return joined.groupBy("trace_id").agg(newest, last).select("trace_id", "row.*", "said.*")
