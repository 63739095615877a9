"""Spelling variants against brute force."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from quillspark.llm import variants


def plain_counts(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(word, letters):
    for p in range(len(word) + 1):
        yield from (word[:p] + c + word[p:] for c in letters)
        if p < len(word):
            yield word[:p] + word[p + 1 :]
            yield from (word[:p] + c + word[p + 1 :] for c in letters)


def plain_groups(counts):
    letters, near = sorted(set("".join(counts))), defaultdict(set)
    for word in counts:
        near[word] = {e for e in edits(word, letters) if e in counts and e != word}
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best and counts[best] >= 10 * n else None
    out = {}
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out[word] = (form[word], root, n, len(near[word]), counts[form[word]] if form[word] else None)
    return out


def rows_of(frame):
    rows = frame.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def made_words(rng, n):
    """Words of few letters, so that many are near, with edits of edits."""
    words = {"".join(rng.choice("abéz") for _ in range(rng.randint(7, 13))) for _ in range(n)}
    words |= {"".join(rng.choice(("tion", "ing", "re", "an", "é")) for _ in range(rng.randint(3, 6))) for _ in range(n)}
    for word in [*words]:
        words.add(rng.choice([*edits(word, "abet")]))
    return {w for w in words if len(w) >= 7}


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_groups_equal_brute_force(spark, frequent):
    rng = random.Random(frequent + 1)
    counts = {w: rng.choice((2, 2, 3, 25, 400, 9000)) for w in made_words(rng, 250)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(variants.group_variants(frame, frequent=frequent))
    assert got == plain_groups(counts)
    assert sum(x[0] is not None for x in got.values()) > 20 and any(x[1] != x[0] for x in got.values() if x[0])


def test_decomposition_keeps_a_gram_after_any_edit():
    """Whatever grams are pruned, an edit changes at most the bound, and an indexed gram is shared."""
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(7, 12)))
        other = rng.choice([e for e in edits(word, "abc") if e != word and len(e) >= 7])
        short, long_ = sorted((word, other), key=len)
        longest = min(variants.QMAX, len(short) - variants.QMIN)
        every = [w[p : p + q] for w in (word, other) for q in range(2, 8) for p in range(len(w) - q + 1)]
        pruned = {}
        for gram in sorted(every, key=len):
            if len(gram) == 2 or gram[:-1] in pruned:
                if rng.random() < 0.7:
                    pruned[gram] = rng.randint(1, 9)
        one, two = (list(enumerate(g for _, g, _ in variants.decompose(w, pruned, longest))) for w in (short, long_))
        reads = [(p, last) for p, (_, _, last) in enumerate(variants.decompose(short, pruned, longest))]
        bound = max(sum(p <= at <= last for p, last in reads) for at in range(len(short) + 1))
        shifts = (0,) if len(short) == len(long_) else (0, 1)
        kept = [(p, g) for p, g in one if any((p + s, g) in two for s in shifts)]
        assert len(one) - len(kept) <= bound < len(one)
        _, asked = variants.lists_and_asks(short, pruned, len(short))
        listed, _ = variants.lists_and_asks(long_, pruned, len(short))
        assert len(asked) == 2 and any((p + s, g) in listed for p, g in asked for s in shifts)


def test_long_words_meet_by_halves(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (63, 64, 65, 66, 200)]
    counts = {w: 2 for w in base} | {e: 40 for w in base for e in rng.sample([*edits(w, "abcd")], 6)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants.group_variants(frame)) == plain_groups(counts)


def test_whole_documents(spark):
    rng = random.Random(4)
    words = [*made_words(rng, 60), "Señora", "ÀÉÎÕÜßÿ", "naïveté×÷", "WORDWORD"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(("", ".", "1", "_")) for _ in range(80))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "nullidword nullidword"), (7, rows[7][1]), (102, "y" * 200_000 + " " + "y" * 200_000), (103, "repeated " * 40_000)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int")
    counts = plain_counts(rows)
    assert {r["word"]: r["n"] for r in variants.word_counts(frame).collect()} == counts
    short = {w: n for w, n in counts.items() if len(w) < 1000}
    got = rows_of(variants.spelling_variants(frame))
    assert {w: x for w, x in got.items() if w in short} == plain_groups(short) and set(got) == set(counts)


def test_empty_and_lone(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(frame).count() == 0
    frame = spark.createDataFrame([(1, "lonesome lonesome short short")], "doc_id long, text string")
    assert rows_of(variants.spelling_variants(frame)) in ({"lonesome": (None, "lonesome", 2, 0, None)}, plain_groups(plain_counts([(1, "lonesome lonesome short short")])))


def test_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w37"} and len(got) == 37
    with pytest.raises(ValueError):
        variants.roots(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "word string, form string"))
