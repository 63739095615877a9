"""Inverted lists against a search of all vectors."""

import numpy as np
import pytest

from quillspark.operators import dense_index as D
from quillspark.operators import retrieval as R


def frames(spark, x, asking):
    vectors = spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    queries = vectors.where(f"vec_id % {asking} = 0").selectExpr("vec_id as query_id", "embedding as query_vec")
    return vectors, queries


def rows(frame):
    found = [(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in frame.collect()]
    assert len(found) == len(set(found))
    return set(found)


def clustered(n=900, d=16):
    rng = np.random.RandomState(4)
    centres = rng.standard_normal((24, d))
    return list(centres[rng.randint(24, size=n)] + 0.12 * rng.standard_normal((n, d)))


def test_equal_to_all_vectors_and_reads_less(spark):
    x = clustered()
    x[5], x[7], x[40] = np.zeros(16), None, x[60]
    vectors, queries = frames(spark, x, 20)
    index = D.build(vectors)
    hits, read = D.search(index, queries, 8, first_lists=2)
    assert rows(hits) == rows(R.dense_top(vectors, queries, 8))
    lists = [r["n_lists"] for r in read.collect()]
    assert len(lists) == 45 and sum(lists) < 0.6 * len(lists) * len(index.centres)


def test_noise_reads_all_and_stays_exact(spark):
    rng = np.random.RandomState(1)
    vectors, queries = frames(spark, list(rng.standard_normal((300, 24))), 30)
    assert rows(D.search(D.build(vectors, lists=9), queries, 5)[0]) == rows(R.dense_top(vectors, queries, 5))


def test_too_few_lists_are_an_error(spark):
    rng = np.random.RandomState(2)
    vectors, queries = frames(spark, list(rng.standard_normal((400, 24))), 10)
    index = D.build(vectors, lists=20)
    with pytest.raises(ValueError, match="recall"):
        D.search(index, queries, 8, first_lists=1, most_lists=1)
    vectors, queries = frames(spark, clustered(), 20)
    index = D.build(vectors)
    hits, _ = D.search(index, queries, 8, most_lists=12)
    assert D.recall(index, queries.withColumnRenamed("query_id", "q"), hits, 8, "query_id", "vec_id", 1000) >= 0.9


def test_empty(spark):
    vectors, queries = frames(spark, clustered(40), 20)
    assert D.search(D.build(vectors.limit(0)), queries, 3)[0].count() == 0
    assert D.search(D.build(vectors), queries.limit(0), 3)[0].count() == 0
    assert D.search(D.build(vectors), queries, 100)[0].count() == 2 * 40


def test_errors_bound_the_cosines(spark):
    x = clustered(200)
    index = D.build(frames(spark, x, 9)[0], lists=6)
    q = np.asarray(x[3]) / np.linalg.norm(x[3])
    for r in index.rows.collect():
        near = q @ index.centres[r["list"]] + q @ (np.frombuffer(r["code"], np.int8) * r["scale"])
        true = q @ (np.float32(x[r["id"]]).astype(float) / np.linalg.norm(np.float32(x[r["id"]]).astype(float)))
        assert abs(near - true) <= r["error"] + 1e-9 and true <= q @ index.centres[r["list"]] + index.radius[r["list"]]
