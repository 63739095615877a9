"""Fragment scores: the plain formula, and norms that are worked out once a pattern of equal letters."""

import random

import numpy as np

from quillspark.llm import toxicity


def words(n, letters="abcdefghijklmnopqrstuvwxyz0134é中𝒜", most=25):
    rng = random.Random(n)
    return ["".join(rng.choices(letters[: rng.choice((2, 6, len(letters)))], k=rng.randint(0, most))).encode() for _ in range(n)]


def plain_score(word, table, bias):
    """The largest value over a word's windows, triple by triple."""
    codes, values = toxicity.letters(word.decode("utf-8", "replace")), []
    for window in toxicity._windows(codes):
        n, found = len(window), {}
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + toxicity.SPAN)):
                    key = (window[i] * toxicity.LETTERS + window[j]) * toxicity.LETTERS + window[k]
                    found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        norm = sum(v * v for v in found.values()) ** 0.5
        values.append(sum(table[key] * v for key, v in found.items()) / norm + bias if found else bias)
    return max(values)


def test_scores_equal_the_formula():
    table = np.random.RandomState(4).randn(toxicity.LETTERS**3).astype(np.float32)
    some = [*words(300), b"", b"a", b"\xff\xe4\xb8", b"ab" * 700]
    got = toxicity.word_scores(some, table, 0.25)
    assert np.allclose(got, [plain_score(w, table, 0.25) for w in some], atol=1e-4)
    assert len(toxicity.word_scores([], table, 0.25)) == 0


def test_norms_are_found_once_a_pattern(monkeypatch):
    """Thousands of words of six different letters share one norm."""
    rng, rows, features = random.Random(8), [], toxicity._features
    many = list({"".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)).encode() for _ in range(6_000)})

    def counted(codes):
        rows.append(len(codes))
        return features(codes)

    monkeypatch.setattr(toxicity, "_features", counted)
    table = np.zeros(toxicity.LETTERS**3, np.float32)
    assert (toxicity.word_scores(many, table, 0.5) == 0.5).all()
    assert sum(rows) <= 1
