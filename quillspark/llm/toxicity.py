"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The unit is a fragment: a word with the punctuation inside it removed, or a run of single letters put together. The
kernel of two fragments sums, over the letter triples that both contain in order, decay ** span of each occurrence
(span up to 8, so gaps and inserted characters only lower a match), normalised to 1 for a fragment with itself.

Labels are per document, so sentences of a toxic document are weakly labelled: fragments that are significantly more
frequent in toxic documents, or begin with letters that are, are the witnesses (positive instances), frequent and
random fragments of clean documents the negative ones. A linear SVM on the Nystroem map of landmark fragments separates them. Map and weights fold into
one weight per letter triple, so scoring a fragment is a table lookup per triple. A document's score is a logistic
function of its two highest fragments, their number and its length, fitted on the sample.

The training sample is bounded (SAMPLE documents, WITNESSES, STEMS, NEGATIVES and LANDMARKS fragments); every document is
scored whole. Scoring needs no shuffle; a worker remembers the scores of a bounded number of fragments.
"""


import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, text_of, tidy
from .minhash import shingles

SAMPLE, WITNESSES, STEMS, NEGATIVES, LANDMARKS = 10_000, 600, 60, 6_000, 256
STEM_LETTERS = (4, 5, 6)
#: The SVM's value from which a fragment counts as seen.
SEEN = 0.3
#: Share of toxic documents among those of a witness, at least.
PURE = 0.6
DECAY, SPAN, LONGEST, STRIDE = 0.6, 8, 10, 2
LETTERS = 64
#: Fragments whose scores a worker remembers (twice as many at most).
REMEMBERED = 50_000

_PUNCTUATION = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or b in b" \t\n\r\x0b\x0c"))
_RUNS = re.compile(rb"(?<![^\s])[a-z0-9](?:\s[a-z0-9]){3,}(?![^\s])")
# Digits that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


def fragments(text: str | None) -> list[bytes]:
    """The fragments of a text, as UTF-8."""
    plain = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION)
    return plain.split() + [b"".join(run.split()) for run in _RUNS.findall(plain)]


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k with k - i < SPAN of n letters, and their weights."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = np.array(found, np.int64).reshape(-1, 3).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    """A letter's code by code point below 0x3000."""
    table = (27 + np.arange(0x3000) % (LETTERS - 28)).astype(np.uint8)
    for c in "abcdefghijklmnopqrstuvwxyz":
        table[ord(c)] = ord(c) - 96
    for digit, letter in _LEET.items():
        table[ord(digit)] = ord(letter) - 96
    return table


def letters(word: str) -> np.ndarray:
    """Codes of a fragment's letters between a start and an end mark."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate(([0], _code_table()[points % 0x3000], [LETTERS - 1])).astype(np.int64)


def _windows(codes: np.ndarray) -> list[np.ndarray]:
    """The codes, or overlapping windows over all of them when there are more than LONGEST."""
    if len(codes) <= LONGEST:
        return [codes]
    starts = [*range(0, len(codes) - LONGEST, STRIDE), len(codes) - LONGEST]
    return [codes[s : s + LONGEST] for s in starts]


def _features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For equally long code rows: triple codes (sorted per row), their weights, and each row's kernel norm."""
    i, j, k, w = _triples(rows.shape[1])
    codes = (rows[:, i] * LETTERS + rows[:, j]) * LETTERS + rows[:, k]
    order = np.argsort(codes, axis=1)
    codes, weights = np.take_along_axis(codes, order, 1), w[order]
    # occurrences of one triple add up before squaring
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    sums = np.add.reduceat(weights.ravel(), np.flatnonzero(new.ravel()))
    owner = np.repeat(np.arange(len(rows)), new.sum(axis=1))
    return codes, weights, np.sqrt(np.bincount(owner, sums.astype(float) ** 2, len(rows)))


def by_length(words: list[bytes]):
    """(indexes of words, code rows) of equal length, at most 2000 rows at a time; a long word has several rows."""
    plain = [w.decode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    starts = np.cumsum(sizes) - sizes
    # all words between their marks, one after the other
    marked, inner = np.zeros(sizes.sum(), np.uint8), np.ones(sizes.sum(), bool)
    inner[starts] = inner[starts + sizes - 1] = False
    marked[starts + sizes - 1] = LETTERS - 1
    marked[inner] = _code_table()[np.frombuffer("".join(plain).encode("utf-32-le"), "<u4") % 0x3000]
    # the windows that _windows gives
    widths = np.minimum(sizes, LONGEST)
    shares = -((widths - sizes) // STRIDE) + 1
    owners = np.repeat(np.arange(len(words)), shares)
    nth = np.arange(len(owners)) - np.repeat(np.cumsum(shares) - shares, shares)
    at = starts[owners] + np.minimum(nth * STRIDE, (sizes - widths)[owners])
    for width in np.unique(widths):
        rows = np.flatnonzero(widths[owners] == width)
        for low in range(0, len(rows), 2000):
            some = rows[low : low + 2000]
            yield owners[some], marked[at[some][:, None] + np.arange(width)].astype(np.int64)


@lru_cache(maxsize=1 << 14)
def _norm(width: int, pattern: int) -> float:
    """The kernel norm of the rows with this pattern: four bits a letter, the first place of an equal one."""
    return float(_features(np.array([[pattern >> 4 * at & 15 for at in range(width)]]))[2][0])


def _norms(columns: np.ndarray) -> np.ndarray:
    """Each row's kernel norm, rows as columns. It depends on which letters of a row are equal, so it is found once a pattern."""
    patterns = np.zeros(columns.shape[1], np.int64)
    for at, letter in enumerate(columns):
        first = np.full(len(letter), at, np.int64)
        for before in range(at - 1, -1, -1):
            first[columns[before] == letter] = before
        patterns |= first << 4 * at
    found, rows = np.unique(patterns, return_inverse=True)
    return np.array([_norm(len(columns), p) for p in found.tolist()])[rows]


def word_scores(words: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """The SVM's value for each fragment: the largest over its windows."""
    out = np.full(len(words), -np.inf)
    for owners, rows in by_length(words):
        if rows.shape[1] < 3:
            values = np.full(len(rows), bias)
        else:
            i, j, k, w = _triples(rows.shape[1])
            columns = np.ascontiguousarray(rows.T, np.int32)
            codes = (columns[i] * LETTERS + columns[j]) * LETTERS + columns[k]
            values = (table[codes] * w[:, None]).sum(axis=0) / _norms(columns) + bias
        np.maximum.at(out, owners, values)
    return out


def _sparse(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A window's triples and their normalised values."""
    triples, weights, norms = _features(codes[None, :])
    ids, first = np.unique(triples[0], return_index=True)
    return ids, np.add.reduceat(weights[0], first) / norms[0]


def kernel(rows: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Normalised kernel of windows with landmarks."""
    marked = [_sparse(m) for m in marks]
    ids = np.unique(np.concatenate([i for i, _ in marked]))
    dense = np.zeros((len(ids), len(marks)), np.float32)
    for column, (i, v) in enumerate(marked):
        dense[np.searchsorted(ids, i), column] = v
    place = np.full(LETTERS**3, -1, np.int64)
    place[ids] = np.arange(len(ids))
    out = np.zeros((len(rows), len(marks)), np.float32)
    for at, codes in enumerate(rows):
        i, v = _sparse(codes)
        hit = place[i] >= 0
        if hit.any():
            out[at] = v[hit] @ dense[place[i][hit]]
    return out


def _folded(marks: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """One weight per triple: the sum of the landmarks' feature vectors, weighted."""
    table = np.zeros(LETTERS**3)
    for mark, weight in zip(marks, weights):
        ids, values = _sparse(mark)
        table[ids] += weight * values
    return table.astype(np.float32)


def fit_svm(positive: list[bytes], negative: list[bytes], seed: int = 5) -> tuple[np.ndarray, float]:
    """Folded triple weights and bias of the squared-hinge SVM on the Nystroem map.

    A long fragment has several windows. All windows of a negative fragment are negative; a positive one is a bag of
    which at least one is positive: it is seen through the window that the model so far scores highest, in a few rounds
    until the choice stays (the first round takes the mean of the bag).
    """

    def windows(words):
        cut = (_windows(letters(w.decode("utf-8", "replace"))) for w in words if len(w) >= 2)
        return [kept for some in cut if (kept := [x for x in some if len(x) >= 4])]

    bags = list({tuple(map(tuple, bag)): bag for bag in windows(positive)}.values())
    ones = [x for bag in bags for x in bag]
    owner = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    own = {tuple(x) for x in ones}
    others = list({tuple(x): x for some in windows(negative) for x in some if tuple(x) not in own}.values())
    rng = np.random.RandomState(seed)
    half = LANDMARKS // 2
    marks = [ones[i] for i in sorted(rng.permutation(len(ones))[:half])]
    order = np.argsort(-kernel(others, marks).max(axis=1), kind="stable")
    picked = dict.fromkeys([*order[: half // 2].tolist(), *rng.permutation(len(others))[: half // 2].tolist()])
    marks += [others[i] for i in picked]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    inside, outside = kernel(ones, marks).astype(float) @ whiten, kernel(others, marks).astype(float) @ whiten
    share = np.bincount(owner)
    seen = np.stack([np.bincount(owner, inside[:, c] / share[owner], len(bags)) for c in range(inside.shape[1])], axis=1)
    chosen = None
    for _ in range(4):
        v, bias = _squared_hinge(seen, outside)
        value = inside @ v
        best = np.lexsort((-value, owner))[np.cumsum(share) - share]
        if chosen is not None and (best == chosen).all():
            break
        chosen, seen = best, inside[best]
    return _folded(marks, whiten @ v), float(bias)


def _squared_hinge(ones: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent, both classes weighing the same."""
    x = np.concatenate([ones, others])
    y = np.concatenate([np.ones(len(ones)), -np.ones(len(others))])
    cost = np.where(y > 0, 0.5 / len(ones), 0.5 / len(others))
    v, bias, mv, mb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 1.0 / max(1e-9, np.linalg.eigvalsh(x.T @ (x * (2 * cost)[:, None])).max() + 2.0)
    for step in range(600):
        gap = np.maximum(0, 1 - y * (x @ v + bias)) * cost * y * 2
        nv, nb = v + rate * (x.T @ gap - 1e-5 * v), bias + rate * gap.sum()
        pull = step / (step + 3)
        v, bias, mv, mb = nv + pull * (nv - mv), nb + pull * (nb - mb), nv, nb
    return v, bias


class Scorer:
    """Document features from the SVM: the two highest fragments, the logarithm of one and the distinct fragments,
    and that of one and those above SEEN."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.known: dict[bytes, float] = {}
        self.older: dict[bytes, float] = {}

    def __call__(self, texts) -> np.ndarray:
        cut = [set(fragments(t)) for t in texts]
        fresh = []
        for word in set().union(*cut) if cut else ():
            if word not in self.known:
                value = self.older.get(word)
                if value is None:
                    fresh.append(word)
                else:
                    self.known[word] = value
        if fresh:
            self.known.update(zip(fresh, word_scores(fresh, self.table, self.bias).tolist()))
        out = np.empty((len(cut), 4))
        for row, words in enumerate(cut):
            first = second = -3.0
            seen = 0
            for value in map(self.known.__getitem__, words):
                seen += value > SEEN
                if value > second:
                    if value > first:
                        first, second = value, first
                    else:
                        second = value
            out[row] = first, second, np.log1p(len(words)), np.log1p(seen)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) by Newton's method with a light L2."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model from labelled documents (null labels are left out); about SAMPLE of them at most.

    Near copies count once: of documents whose smallest shingle is the same, that with the smallest id is taken. Without both labels, or
    without any significant fragment, the model gives every document the share of toxic ones in the sample.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    chosen = bounded_sample(marked, id_col, SAMPLE).select(F.col(id_col).alias("id"), F.col("y").cast("int").alias("y"))
    sample = documents.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(chosen, "id")

    @F.pandas_udf(T.LongType())
    def least(texts: pd.Series) -> pd.Series:
        return pd.Series([int(h[0].astype(np.int64)) if len(h := shingles(t)) else 0 for t in texts], dtype="int64")

    once = sample.withColumn("least", least("text")).groupBy("least").agg(F.min(F.struct("id", "text", "y")).alias("first"))
    sample = once.select("first.text", "first.y").cache()

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def distinct_fragments(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(fragments(t))) for t in texts])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def distinct_stems(texts: pd.Series) -> pd.Series:
        words = ({w.decode("utf-8", "replace") for w in fragments(t)} for t in texts)
        return pd.Series([sorted({w[:k] for w in some for k in STEM_LETTERS if len(w) > k}) for some in words])

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positive, total = n.get(1, 0), n.get(0, 0) + n.get(1, 0)
    rate = positive / total if total else 0.0
    plain = {"table": None, "bias": 0.0, "weights": None, "rate": rate}
    if not positive or positive == total:
        sample.unpersist()
        return plain
    counts = (
        sample.select(F.explode(distinct_fragments("text")).alias("word"), "y")
        .groupBy("word").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    )
    share = F.col("p") / F.col("n")
    rest = F.when(F.col("p") < F.col("n"), (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    surprise = F.col("n") * (share * F.log(share / rate) + rest)
    counts = counts.where(F.octet_length("word") >= 2).cache()
    bar = max(4.0, float(np.log(max(2, total))) + 3.0)  # so that chance hardly makes a witness of a clean word
    telling = (share > max(PURE, min(0.9, 3 * rate))) & (surprise >= bar)
    found = counts.where(telling).select("word").orderBy(F.desc(surprise), "word").limit(WITNESSES).collect()
    # beginnings: the same test for what the rarer words of a stem have in common
    spelled = counts.withColumn("letters", F.decode("word", "UTF-8"))
    stems = (
        sample.select(F.explode(distinct_stems("text")).alias("stem"), "y")
        .groupBy("stem").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
        .where(telling).select("stem").orderBy(F.desc(surprise), "stem").limit(STEMS).collect()
    )
    known = [r["stem"] for r in stems]
    # the same beginnings in toxic documents mostly (more witnesses) and in clean ones (the hardest negatives)
    kin, foes = [], []
    if known:
        begins = F.array(*[F.left("letters", F.lit(k)) for k in STEM_LETTERS])
        akin = spelled.where(F.arrays_overlap(begins, F.array(*[F.lit(x) for x in known])))
        kin = akin.where(share > max(PURE, min(0.9, 3 * rate))).select("word").orderBy(F.desc("p"), "word").limit(WITNESSES).collect()
        foes = akin.where(share <= 0.5).select("word").orderBy(F.desc("n"), "word").limit(NEGATIVES // 4).collect()
    clean = counts.where(share <= min(0.9, 2 * rate))
    common = clean.orderBy(F.desc("n"), "word").limit(NEGATIVES // 2).select("word").collect()
    other = clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES // 2).select("word").collect()
    counts.unpersist()
    if not (found or kin) or not common:
        sample.unpersist()
        return plain
    witnesses = list(dict.fromkeys([bytes(r["word"]) for r in found + kin]))
    negatives = list(dict.fromkeys(bytes(r["word"]) for r in foes + common + other))
    table, bias = fit_svm(witnesses, negatives)
    scored = sample.select(_features_udf(table, bias)("text").alias("x"), "y").collect()
    sample.unpersist()
    x, y = np.array([r["x"] for r in scored]), np.array([r["y"] for r in scored], float)
    return {"table": table, "bias": bias, "weights": _logistic(x, y), "rate": rate}


def _features_udf(table: np.ndarray, bias: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    @tidy("toxicity")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(table, bias)
        for texts in batches:
            yield pd.Series([row for low in range(0, len(texts), 256) for row in scorer(texts.iloc[low : low + 256]).tolist()])

    return features


def score(frame: DataFrame, model: dict, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """`frame` with the column `out_col` (0 to 1; higher: likelier toxic). Null and empty texts score as a text
    without fragments. All rows and columns stay, repeated rows too; `out_col` replaces a column of that name. Texts are
    scored whole, in time proportional to their length. An empty table gives no rows."""
    if model["table"] is None:
        return frame.withColumn(out_col, F.lit(float(model["rate"])))
    table, bias, weights = model["table"], model["bias"], model["weights"]

    @F.pandas_udf(T.DoubleType())
    @tidy("toxicity")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(table, bias)
        for texts in batches:
            x = np.concatenate([scorer(texts.iloc[low : low + 256]) for low in range(0, len(texts), 256)] or [np.empty((0, 4))])
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    return frame.withColumn(out_col, toxicity(text_of(text_col)))
