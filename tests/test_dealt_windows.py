"""Windows dealt by range, gold by whole items, broadcasts by bytes: against plain loops."""

import random

import pytest

from quillspark.operators import metrics as M
from quillspark.operators import retrieval as R


def test_rolling_budget_over_spans(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice((0, 1, 5, 59, 60, 61, 3599, 3600, 3601, 3660, 7200, 7259)) + rng.randrange(2) / 2, rng.randint(0, 9)) for i in range(200)]
    frame = spark.createDataFrame(rows, "i int, g string, t double, c int").selectExpr("i", "g", "timestamp_millis(cast(t * 1000 as bigint)) as ts", "c")
    got = {r["i"]: r["spent"] for r in M.rolling_budget(frame, "g", "ts", "c").collect()}
    assert got == {i: sum(c2 for _, g2, t2, c2 in rows if g2 == g and int(t) - 60 <= int(t2) <= int(t)) for i, g, t, _ in rows}


@pytest.mark.parametrize("tasks", ["1", "7"])
def test_islands(spark, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        rng = random.Random(2)
        rows = [(k, float(rng.choice((1, 2, 3, 40, 41, 90, 91, 99, 300)) + rng.randrange(60))) for k in "ab" for _ in range(40)] + [("c", 1.0), ("c", 1.0), ("a", None), ("d", None)]
        got = {(r["k"], r["cluster"], r["n"], r["low"], r["high"]) for r in M.islands(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 4).collect()}
        want = set()
        for key in "abc":
            runs = []
            for v in sorted(v for k, v in rows if k == key and v is not None):
                if not runs or v - runs[-1][-1] > 4:
                    runs.append([])
                runs[-1].append(v)
            want |= {(key, i, len(run), run[0], run[-1]) for i, run in enumerate(runs)}
        assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gold_is_of_the_whole_item(spark):
    item = " ".join(f"w{i}" for i in range(40))
    words = item.split()
    texts = {
        0: "x " + item + " y", 1: " ".join(["other"] * 5 + words[5:]), 2: " ".join(words[:12]) + " and nothing else", 3: None, 4: "tiny one here", 5: "",
        6: " ".join(w if i % 4 else "no" for i, w in enumerate(words)), 7: "\n".join(words),
    }
    items = spark.createDataFrame([(0, item), (1, "tiny one"), (2, None), (3, " ")], "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in R.gold_documents(docs, items).collect()}
    assert got == {(0, 0), (0, 1), (0, 7), (1, 4)}
    assert R.gold_documents(docs, items.limit(0)).count() == 0


def test_broadcasts_are_bounded_by_bytes(spark):
    def hinted(frame, **bounds):
        return "ResolvedHint" in R.small(frame, **bounds)._jdf.queryExecution().analyzed().toString()

    frame = spark.createDataFrame([(1, "x" * 1000, ["y" * 500] * 3)] * 5, "i int, t string, a array<string>")
    assert hinted(frame) and not hinted(frame, bound=4) and not hinted(frame, most_bytes=10_000) and hinted(frame, most_bytes=14_000)
