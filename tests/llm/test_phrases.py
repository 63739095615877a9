"""Collocations by the graph against plain counting."""

import random
import re
from collections import Counter

import pytest

from quillspark.llm import phrases as P


def plain_pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", text)]


def plain(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in plain_pieces(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at : at + size])] += 1
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, words), a in held.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                key = (lang, words[at : at + size])
                inside[key] = max(inside.get(key, 0), a)
    out = {}
    for (lang, words), a in held.items():
        if inside.get((lang, words), 0) >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((score, a, " ".join(words), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    rows = set()
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows |= {(lang, rank, p, a, l, r, n, s) for rank, (s, a, p, l, r, n) in enumerate(found[:top], 1)}
    return rows


def made(rng, n):
    words = [f"w{i}" for i in range(12)] + ["Über", "naïve", "x\xa0y", "don't", "THE"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice((4, 17))]) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n")) for _ in range(rng.randint(0, 60)))
        yield rng.choice(("en", "de", None)), text + (" | " + passage if rng.random() < 0.4 else "")


@pytest.mark.parametrize("least,top", [(1, 10_000), (5, 2000), (12, 7)])
def test_equal_to_plain_counts(spark, least, top):
    rng = random.Random(least)
    rows = [*made(rng, 160), ("en", None), ("en", ""), (None, "."), ("fr", "one"), ("en", "word " * 30_000), ("en", "w" * 100_000 + " z")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int")
    got = P.collocations(frame, least=least, top=top).collect()
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == plain(rows, least, top=top)
    assert len(got) == len({(r["lang"], r["rank"]) for r in got})


def test_blocks_and_full_bit_sets_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    rows = [*made(rng, 120)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    texts = P._texts(frame, "text", "lang")
    import numpy as np

    every = spark.sparkContext.broadcast(np.full(1 << 13, 255, np.uint8))
    runs = P.longest_runs(texts, every, every)
    counts = {(r["lang"], r["phrase"]): r["n"] for level in P.node_flows(runs) for r in level.collect()}
    f = Counter()
    for lang, text in rows:
        for words in plain_pieces(text):
            for size in range(2, 6):
                f.update((lang or "und", " ".join(words[at : at + size])) for at in range(len(words) - size + 1))
    assert counts == f


def test_paths(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [("en", f"a{i} {passage} b{i}") for i in range(6)] + [("en", "p3 p4 p5 p6 p7")] * 2 + [("en", "c d e f g h")] * 6
    found, _, _ = P.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), least=6)
    got = {r["phrase"]: r["path_words"] for r in P.unary_paths(found).collect()}
    # the passage's edges before p3..p7, that edge alone, and those behind it
    assert got["c d e f g"] == got["d e f g h"] == 6
    assert got["p0 p1 p2 p3 p4"] == got["p2 p3 p4 p5 p6"] == 7 and "p3 p4 p5 p6 p7" not in got
    assert got["p4 p5 p6 p7 p8"] == got["p35 p36 p37 p38 p39"] == 36
    assert len(got) == 2 + 3 + 32


def test_empty(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(frame).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).count() == 0


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1)], "lang string, word string, n long")
    totals = spark.createDataFrame([("en", 10**15 + 3)], "lang string, n long")
    row = P.scored_cuts(phrases, words, totals).first()
    assert row["score"] == 1000 * big * (10**15 + 3) // ((big + 7) * (big + 1))
