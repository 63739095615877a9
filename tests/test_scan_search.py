"""Search in one pass over the documents, against the index read whole."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark import catalogue
from quillspark.operators import scan_search
from quillspark.operators import search_index as S
from quillspark.operators.retrieval import bm25, ranked
from quillspark.plans import retrieval
from quillspark.session import table
from quillspark.tables import saved, shared_dir

QUERIES = [(1, "red fox 42nd street"), (2, "the of and"), (3, "blue blue 3.5 unknownword"), (4, None), (5, "fox")]


def _rows(hits, id_col="chunk_id"):
    return sorted((r["query_id"], r["rank"], r[id_col], round(r["score"], 7)) for r in hits.collect())


def _docs(spark):
    words = ["red", "fox", "blue", "42", "3.5", "street", "the", "lake"]
    texts = [" ".join(words[(i * j + j) % 8] for j in range(i % 17)) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, "red fox"), (7, "red"), (9, texts[9])]
    return spark.createDataFrame(rows, "chunk_id long, text string")


@pytest.mark.parametrize("step,pairs", [(1 << 21, 1_000_000), (1, 3)])
def test_same_hits_as_the_index(spark, tmp_path, monkeypatch, step, pairs):
    """Repeated, null and empty rows, equal texts beyond the k-th place, small steps and several blocks of queries."""
    monkeypatch.setattr(scan_search, "STEP", step)
    monkeypatch.setattr(scan_search, "BLOCK_PAIRS", pairs)
    docs, queries = saved(_docs(spark)), spark.createDataFrame(QUERIES, "query_id long, query string")
    wanted = S.without_bounds(S.build(docs, str(tmp_path / "index")), queries, 20)
    assert _rows(scan_search.scan(docs, queries, 20)) == _rows(wanted)
    assert _rows(scan_search.scan(docs, queries, 1)) == [r for r in _rows(wanted) if r[1] == 1]


def test_string_ids_and_no_documents(spark):
    docs = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), ("c", "lake")], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "red")], "query_id string, query string")
    assert [(r["chunk_id"], r["rank"]) for r in scan_search.scan(docs, queries, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert scan_search.scan(docs.limit(0), queries, 2).count() == 0
    assert scan_search.scan(docs, queries.limit(0), 2).count() == 0


def test_plain_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    plain = ranked(bm25(docs, items, "doc_id"), "query_id", "doc_id", 10)
    assert _rows(scan_search.scan(docs, items, 10, id_col="doc_id"), "doc_id") == _rows(plain, "doc_id")


def test_items_are_searched_once_and_without_an_index(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(retrieval, "_HITS", {})
    monkeypatch.setattr(S, "build", lambda *a: pytest.fail("built an index for one search"))
    monkeypatch.setattr(S, "_KEPT", {})
    first = retrieval.lexical(spark, sf_dir)
    monkeypatch.setattr(retrieval, "scan", lambda *a: pytest.fail("searched again"))
    assert retrieval.lexical(spark, sf_dir).collect() == first.collect()


def test_too_many_terms_ask_the_index(spark, sf_dir, monkeypatch):
    wanted = retrieval.lexical(spark, sf_dir).collect()
    monkeypatch.setattr(scan_search, "MOST_TERMS", 5)
    monkeypatch.setattr(retrieval, "_HITS", {})
    found = retrieval.lexical(spark, sf_dir).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in found) == sorted((r["item_id"], r["rank"], r["doc_id"]) for r in wanted)


def test_a_long_document_is_cut_in_proportion(spark):
    """Each term's frequency was divided by a sum that was made anew for every term of the document."""
    text = " ".join(f"w{i}" for i in range(24_000))
    docs = saved(spark.createDataFrame([(1, text), (1, text), (2, "red")], "chunk_id long, text string"))
    began = time.time()
    index = S.build(docs, f"{shared_dir(spark)}/long-index")
    took = time.time() - began
    assert index.forward.where("id = 1").select(F.size("terms"), F.array_max("terms.tf")).collect() == [(24_000, 1)]
    assert took < 30


def test_the_router_benchmark_builds_no_index(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(S, "build", lambda *a: pytest.fail("built an index for one search"))
    monkeypatch.setattr(S, "_KEPT", {})
    assert catalogue.QUERIES["AGG38_router_benchmark"](spark, sf_dir).count() == 3
