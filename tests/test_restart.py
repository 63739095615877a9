"""A stopped ingest that starts again writes nothing twice."""

import os

from quillspark.streaming import ingest


def test_ingest_restarts_where_it_stopped(spark, sf_dir, tmp_path):
    source, chunks, progress = f"{sf_dir}/documents.parquet", str(tmp_path / "chunks"), str(tmp_path / "progress")
    ingest.ingest(spark, source, chunks, progress).awaitTermination()
    columns = sorted(ingest.current_chunks(spark, chunks).columns)
    first = sorted(map(str, ingest.current_chunks(spark, chunks).select(columns).collect()))
    commits = sorted(n for n in os.listdir(tmp_path / "progress" / "commits") if n.isdigit())
    # as after a crash between a batch's write and its commit: the batch runs again
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if (tmp_path / "progress" / "commits" / name).exists():
            os.remove(tmp_path / "progress" / "commits" / name)
    ingest.ingest(spark, source, chunks, progress).awaitTermination()
    assert sorted(map(str, ingest.current_chunks(spark, chunks).select(columns).collect())) == first and first
    ingest.ingest(spark, source, chunks, progress).awaitTermination()
    assert ingest.current_chunks(spark, chunks).count() == len(first)
