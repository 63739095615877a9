"""Gold by a tree of words: the same documents as by joined hashes."""

import random

import pytest

from quillspark.operators import retrieval as R


def _frames(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, "", "  w1\tw2\n w3 ", "é é é é é é"]
    asked = [t for t in texts[:30]] + ["w1", "w1 w2", " w3 w4 w5 ", "w1 w1 w1 w1 w1 w1 w1", "", None, "é é é", "unseen words only of this item here", "w1 w2"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(f"i{n}", t) for n, t in enumerate(asked)], "item_id string, text string")


def _rows(frame):
    return sorted(map(tuple, frame.select("item_id", "doc_id", "found", "n").collect()))


def test_tree_and_hashes_agree(spark, monkeypatch):
    docs, items = _frames(spark)
    for share in (0.01, 0.5):
        by_tree = _rows(R.gold_documents(docs, items, share=share))
        with monkeypatch.context() as patch:
            patch.setattr(R, "MOST_WINDOWS", 0)
            assert by_tree == _rows(R.gold_documents(docs, items, share=share))
        assert len(by_tree) > 30


def test_texts_are_not_hashed_window_by_window(spark, monkeypatch):
    docs, items = _frames(spark)
    monkeypatch.setattr(R, "_windows", lambda *a: pytest.fail("hashed every window"))
    assert R.gold_documents(docs, items).count() > 30
    assert R.gold_documents(docs, items.limit(0)).count() == 0
