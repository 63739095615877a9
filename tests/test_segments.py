"""WIN14: rows of a page that tie are in one segment, whatever their order in the file."""

from quillspark import catalogue


def test_equal_rows_share_a_segment(spark, tmp_path):
    rows = [(p, n, q) for p in range(200) for n, q in ((1, 1.0), (2, 30.0), (2, 30.0), (3, 31.0), (2, 49.0), (2, 49.0))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").repartition(7).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.QUERIES["WIN14_segments"](spark, str(tmp_path)).groupBy("row_no", "segment").count().collect()
    assert sorted(map(tuple, found)) == [(1, 0, 200), (2, 1, 400), (2, 2, 400), (3, 1, 200)]
