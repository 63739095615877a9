"""Quantile sketches with measured errors; the run-log data source in batches, streams and writes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sketches
from quillspark.sources import run_log


def test_sketches_merge_over_days(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"2024-01-0{rng.randint(1, 5)} 10:00:00", rng.choice((None, rng.lognormvariate(3, 1)))) for _ in range(6000)]
    frame = spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    days = sketches.daily_sketches(frame, ["k"], "ts", "v")
    assert days.count() == 10
    got = sketches.window_quantiles(days, ["k"], since="2024-01-02", until="2024-01-04")
    inside = frame.where("ts >= '2024-01-02' and ts < '2024-01-05'")
    assert {r["k"]: r["n"] for r in got.collect()} == {k: sum(1 for k2, t, v in rows if k2 == k and v is not None and "02" <= t[8:10] <= "04") for k in "ab"}
    errors = sketches.rank_errors(inside, got, ["k"], "v").collect()
    assert len(errors) == 6 and all(r["error"] is not None and r["error"] < 0.015 for r in errors)
    assert sketches.window_quantiles(days, ["k"], since="2030-01-01").count() == 0


def test_run_log_reads_slices_and_torn_lines(spark, tmp_path, monkeypatch):
    run_log.register(spark)
    lines = [json.dumps({"id": i, "note": "ü" * (i % 7)}) for i in range(50)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:30]) + '\n{"id": 99, "no\n[1]\n\n' + lines[30] + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[31:]), encoding="utf-8")
    rows = spark.read.format("run_log").load(str(tmp_path)).collect()
    assert sorted(r["value"] for r in rows if r["value"]) == sorted(lines)
    assert sorted(r["torn"] for r in rows if r["torn"]) == ["[1]", '{"id": 99, "no']
    # any cut of a file into slices gives every line once
    path, raw = str(tmp_path / "a.jsonl"), (tmp_path / "a.jsonl").read_bytes()
    for size in (1, 7, 64, 10_000):
        found = [row for low in range(0, len(raw), size) for row in run_log._lines(run_log.Span(path, low, min(low + size, len(raw))), False)]
        assert [r[1] for r in found] == sorted({r[1] for r in found}) and len(found) == 33
        assert all(raw[r[1] :].startswith((r[2] or r[3]).encode()) for r in found)


def test_run_log_stream_goes_on_from_its_byte(spark, tmp_path):
    run_log.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("run_log").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = stream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r["value"] or "torn" for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id": 3, "x"')
    assert run() == ['{"id": 1}', '{"id": 2}']
    with open(folder / "a.jsonl", "a") as file:
        file.write(': 4}\nnoise\n')
    (folder / "b.jsonl").write_text('{"id": 5}\n')
    assert run() == ["torn", '{"id": 1}', '{"id": 2}', '{"id": 3, "x": 4}', '{"id": 5}']


def test_run_log_commits_and_aborts(spark, tmp_path):
    run_log.register(spark)
    folder = str(tmp_path / "log")
    spark.range(10).withColumn("note", F.lit("é")).repartition(3).write.format("run_log").mode("append").save(folder)
    read = lambda: sorted(json.loads(r["value"])["id"] for r in spark.read.format("run_log").load(folder).collect())
    assert read() == list(range(10))
    with pytest.raises(Exception):
        spark.range(20).select(F.when(F.col("id") < 19, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("id")).repartition(4).write.format("run_log").mode("append").save(folder)
    assert read() == list(range(10)) and not [f for f in os.listdir(folder) if f.startswith(".part")]
    spark.range(3).write.format("run_log").mode("overwrite").save(folder)
    assert read() == [0, 1, 2]
