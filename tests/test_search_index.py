"""The kept index: same hits as a search of all postings, by bounds, after updates, from a later session's view."""

import math
import random
import re
from collections import Counter

import pytest

from quillspark.functions.text import STOP_WORDS
from quillspark.operators import retrieval as R
from quillspark.operators import search_index as S
from quillspark.tables import shared_dir


def terms(text):
    return [w for w in re.findall(r"[a-z0-9]+(?:[.,][0-9]+)*", re.sub(r"\b(\d+)(?:st|nd|rd|th)\b", r"\1", (text or "").lower())) if w not in STOP_WORDS]


def plain(docs, queries, k):
    cut = {i: Counter(terms(t)) for i, t in docs.items()}
    size = {i: sum(c.values()) for i, c in cut.items()}
    avg = sum(size.values()) / len(size)
    df = Counter(t for c in cut.values() for t in c)
    out = set()
    for q, text in queries.items():
        scores = {}
        for i, c in cut.items():
            for t in set(terms(text)) & c.keys():
                idf = math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5))
                scores[i] = scores.get(i, 0) + idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / avg))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out |= {(q, i, round(s, 6), rank) for rank, (i, s) in enumerate(best, 1)}
    return out


def got(frame):
    rows = [(r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame_of(spark, docs):
    return spark.createDataFrame(list(docs.items()), "chunk_id long, text string")


def made(rng, n):
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return {i: " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.8)) + 3)) for i in range(n)}


def path(spark):
    import uuid

    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def test_bounds_skip_cells_and_lose_nothing(spark):
    rng = random.Random(1)
    docs = made(rng, 1500)
    docs |= {5: None, 6: "", 7: "the of", 8: docs[9], 10: "t1 " * 5000}
    queries = {q: " ".join(rng.choices([w for t in docs.values() for w in (t or "").split()[:3]], k=rng.randint(1, 6))) for q in range(12)} | {90: "nowhere", 91: "", 92: None, 93: "t1 t2"}
    index = S.build(frame_of(spark, docs), path(spark))
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    hits, read = S.search(index, asked, 5)
    assert got(hits) == plain(docs, queries, 5) == got(S.without_bounds(index, asked, 5))
    rows = {r["query_id"]: r for r in read.collect()}
    assert set(rows) == {r[0] for r in got(hits)}
    assert sum(r["n_scored"] for r in rows.values()) < 0.7 * sum(r["n_cells"] for r in rows.values())
    assert sum(r["n_read"] for r in rows.values()) < sum(r["n_postings"] for r in rows.values())
    old = R.ranked(R.bm25(frame_of(spark, docs), asked), "query_id", "chunk_id", 5)
    assert got(old) == got(hits)


def test_skipped_cells_hold_no_better_hit(spark):
    rng = random.Random(2)
    docs = made(rng, 800)
    index = S.build(frame_of(spark, docs), path(spark))
    asked = spark.createDataFrame([(0, "t3 t9 t1"), (1, "t2")], "query_id long, query string")
    every = got(S.without_bounds(index, asked, 10_000))
    for k in (1, 3, 40):
        kept = got(S.search(index, asked, k, first_cells=2)[0])
        assert kept == {r for r in every if r[3] <= k}


def test_updates_equal_a_new_index(spark):
    rng = random.Random(3)
    docs = made(rng, 300)
    queries = {q: " ".join(rng.choices([w for t in docs.values() for w in t.split()[:3]], k=4)) for q in range(8)}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    index = first = S.build(frame_of(spark, docs), path(spark))
    before = plain(docs, queries, 7)
    for step in range(3):
        changed = {i: t for i, t in made(rng, 60).items() if rng.random() < 0.5} | {1000 + step: "t1 t2 t3 fresh", 20: docs.get(20, "t1")}
        removed = [i for i in rng.sample(range(300), 25) if i not in changed] + [7777]
        index = S.update(index, frame_of(spark, changed), spark.createDataFrame([(i,) for i in removed], "chunk_id long"))
        docs = {i: t for i, t in (docs | changed).items() if i not in removed}
        assert index.n_docs == len(docs)
        assert got(S.search(index, asked, 7)[0]) == plain(docs, queries, 7)
    with pytest.raises(ValueError):
        S.update(first, frame_of(spark, {1: "t1"}))
    small = S.compact(index)
    assert len(small.segments) == 1 and not small.any_dead
    assert got(S.search(small, asked, 7)[0]) == plain(docs, queries, 7) == got(S.search(S.open_index(spark, index.path), asked, 7)[0])
    assert got(S.search(first, asked, 7)[0]) == before


def test_half_written_updates_do_not_count(spark):
    docs = {1: "apple pie", 2: "apple tart"}
    index = S.build(frame_of(spark, docs), path(spark))
    S._write_segment(index.path, S._cut(frame_of(spark, {3: "apple apple"}), "chunk_id", "text"), None)  # stopped before its commit
    asked = spark.createDataFrame([(0, "apple")], "query_id long, query string")
    assert got(S.search(S.open_index(spark, index.path), asked, 9)[0]) == plain(docs, {0: "apple"}, 9)
    with pytest.raises(ValueError):
        S.build(frame_of(spark, docs), index.path)


def test_scope_and_repeats(spark):
    docs = {1: "fuel cost", 2: "fuel price", 3: "fuel tax"}
    twice = frame_of(spark, docs).unionAll(frame_of(spark, docs))
    index = S.build(twice, path(spark))
    asked = spark.createDataFrame([(0, "fuel fuel tax")], "query_id long, query string")
    assert got(S.search(index, asked, 5)[0]) == plain(docs, {0: "fuel tax"}, 5)
    scope = spark.createDataFrame([(2,), (9,)], "chunk_id long")
    assert [r[1] for r in got(S.search(index, asked, 5, scope=scope)[0])] == [2]
    assert S.search(index, asked, 5, scope=scope.limit(0))[0].count() == 0


def test_empty(spark):
    index = S.build(spark.createDataFrame([], "chunk_id long, text string"), path(spark))
    asked = spark.createDataFrame([(0, "anything")], "query_id long, query string")
    assert S.search(index, asked, 5)[0].count() == 0
    index = S.update(index, frame_of(spark, {1: "anything goes", 2: None}))
    assert got(S.search(index, asked, 5)[0]) == plain({1: "anything goes", 2: None}, {0: "anything"}, 5)


def test_kept_until_the_table_changes(spark, tmp_path):
    frame_of(spark, {1: "one two"}).write.parquet(f"{tmp_path}/t")
    one = S.kept_index(spark, f"{tmp_path}/t", "chunk_id")
    assert S.kept_index(spark, f"{tmp_path}/t", "chunk_id") is one
    frame_of(spark, {2: "one three"}).write.mode("append").parquet(f"{tmp_path}/t")
    assert S.kept_index(spark, f"{tmp_path}/t", "chunk_id").n_docs == 2
