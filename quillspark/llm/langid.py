"""Language of code-switched text by a linear-chain conditional random field.

Every line is a chain of words. A word's emission is the sum of learned weights of its hashed character n-grams
between a start and an end mark (so prefixes and suffixes are features of their own) and of its lexicon features
(how often each language's training documents hold the word); transitions between languages are learned with them.
Forward-backward gives every word a distribution over languages; a document's language has the largest sum.

Training labels are per document. A first pass labels each word of the sample by its document, smooths over
neighbours with an emission-only model, and relabels clear runs of another language; then the CRF is fitted to those
labels, on lines of the sample and on pairs of lines from documents of different languages (switches).
The sample is bounded (SAMPLE documents, LINES lines, LEXICON words); every document is labelled whole. Prediction is
a narrow map over (id, text); a worker remembers the emissions of a bounded number of words.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, text_of, tidy

SAMPLE, LINES, LEXICON = 3_000, 4_000, 20_000
BUCKETS, SIZES, LONGEST_TRAINED = 1 << 15, (1, 2, 3, 4), 60
#: Neighbouring words whose transitions are added up at a time.
PAIRS = 10_000
#: Words whose emissions a worker remembers (twice as many at most).
REMEMBERED = 30_000

_PUNCTUATION = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or b in b" \t\n\r\x0b\x0c"))
_LETTER = re.compile(r"[^\W\d_]")


def lines_of(text: str | None) -> list[list[bytes]]:
    """A text's lines that hold words, as lists of words (UTF-8, lower case, without ASCII punctuation)."""
    plain = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION)
    return [words for line in plain.split(b"\n") if (words := line.split())]


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram buckets (positions x sizes, -1 where one would leave its word) and each word's first position."""
    raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.int64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(raw))  # bytes from here to the word's end
    out = np.full((len(raw), len(SIZES)), -1, np.int64)
    h = np.zeros(len(raw), np.int64)
    for n in range(1, max(SIZES) + 1):
        h = h * 257
        h[: len(raw) - n + 1] += raw[n - 1 :]
        if n in SIZES:
            column = SIZES.index(n)
            out[:, column] = np.where(left >= n, (h * 2654435761 + n * 97) >> 7 & (BUCKETS - 1), -1)
    return out, starts


class Emissions:
    """Emission rows of words under a model."""

    def __init__(self, model: dict):
        self.weights = np.vstack([model["ngrams"], np.zeros((1, len(model["langs"])))]).astype(np.float32)
        self.lexicon, self.scale, self.bias = model["lexicon"], model["scale"], model["bias"].astype(np.float32)
        self.none = np.zeros(len(model["langs"]), np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        buckets, starts = ngrams(words)
        per_place = self.weights[buckets[:, 0]]
        for column in range(1, len(SIZES)):
            per_place = per_place + self.weights[buckets[:, column]]
        known = np.array([self.lexicon.get(w, self.none) for w in words], np.float32)
        return np.add.reduceat(per_place, starts, axis=0) + self.scale * known + self.bias


def marginals(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward-backward over chains laid end to end, vectorised over chains of falling length.

    emit: words x languages. Returns the distributions, forward scale factors, forward and backward vectors, scores.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    scores = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    step = np.exp(move)
    forward, scale = np.empty_like(scores), np.empty(len(scores))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # chains with more than t words
    for t in range(longest):
        at = first[: alive[t]] + t
        now = scores[at] if t == 0 else (forward[at - 1] @ step) * scores[at]
        scale[at] = total = now.sum(axis=1)
        forward[at] = now / total[:, None]
    backward = np.ones_like(scores)
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        after = (scores[at + 1] * backward[at + 1]) @ step.T
        backward[at] = after / after.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    return both, scale, forward, backward, scores


def _sums(wide: np.ndarray, columns: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """The summed n-gram weights of each word."""
    per_place = wide[columns[0]]
    for b in columns[1:]:
        per_place += wide[b]
    return np.add.reduceat(per_place, starts, axis=0)


def _moved(forward: np.ndarray, backward: np.ndarray, scores: np.ndarray, move: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Expected transitions to the words at `place` from those before, added up PAIRS at a time in the order of words."""
    step, total = np.exp(move)[None], np.zeros((1, *move.shape))
    for low in range(0, len(place), PAIRS):
        at = place[low : low + PAIRS]
        pair = forward[at - 1][:, :, None] * step * (scores[at] * backward[at])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        total = np.concatenate([total, pair]).sum(axis=0, keepdims=True)
    return total[0]


def _fit(chains: list[list[int]], labels: list[np.ndarray], words: list[bytes], known: np.ndarray, n_langs: int, chain: bool, rounds: int):
    """Adam on the conditional likelihood. Without `chain`, transitions stay zero (each word by itself)."""
    buckets, starts = ngrams(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(buckets))))
    flat = [(buckets[:, c], buckets[:, c] >= 0) for c in range(len(SIZES))]
    ids = np.concatenate([np.array(c) for c in chains])
    lengths = np.array([len(c) for c in chains])
    gold = np.concatenate(labels)
    one = np.eye(n_langs)[gold]
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - lengths] = False  # words with one before them
    place = np.flatnonzero(inner)
    w, scale, bias, move = np.zeros((BUCKETS, n_langs)), 1.0, np.zeros(n_langs), np.zeros((n_langs, n_langs))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, bias, move, np.zeros(1))]
    gold_moves = np.zeros_like(move)
    np.add.at(gold_moves, (gold[place - 1], gold[place]), 1)
    for step in range(1, rounds + 1):
        wide = np.vstack([w, np.zeros((1, n_langs))])
        emission = _sums(wide, [b for b, _ in flat], starts) + scale * known + bias
        gap, _, forward, backward, scores = marginals(emission[ids], lengths, move)
        gm = _moved(forward, backward, scores, move, place) - gold_moves if chain and len(place) else np.zeros_like(move)
        del forward, backward, scores
        gap -= one
        per_word = np.column_stack([np.bincount(ids, gap[:, k], len(words)) for k in range(n_langs)])
        gw = np.zeros_like(w)
        for k in range(n_langs):
            at_place = per_word[owner, k]
            for b, ok in flat:
                gw[:, k] += np.bincount(b[ok], at_place[ok], BUCKETS)
        grads = (gw / len(ids) + 1e-6 * w, gap.mean(axis=0), gm / len(ids), np.array([(gap * known[ids]).sum() / len(ids)]))
        moves = []
        for (m, v), g in zip(state, grads):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            moves.append(0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8))
        w -= moves[0]
        bias -= moves[1]
        move -= moves[2] if chain else 0
        scale -= float(moves[3][0])
    return w, scale, bias, move


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """A model from documents with a language and a text; `langs` is empty where there is none.

    Copies of a text count once, with the language of the smallest id. With one language alone, every word has it. Rows
    that repeat an id count by their texts.
    """
    usable = documents.where(F.col(lang_col).isNotNull() & (F.length(text_of(text_col)) > 0))
    chosen = bounded_sample(usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "id", SAMPLE)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.BinaryType())))
    def chains_of(texts: pd.Series) -> pd.Series:
        cut = lambda words: [words[i : i + LONGEST_TRAINED] for i in range(0, len(words), LONGEST_TRAINED)]
        return pd.Series([[part for line in lines_of(t) for part in cut(line)] for t in texts])

    sample = chosen.groupBy("text").agg(F.min_by("lang", "id").alias("lang")).select("lang", chains_of("text").alias("chains")).cache()
    langs = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        sample.unpersist()
        return {"langs": []}
    held = sample.select("lang", F.explode(F.flatten("chains")).alias("word")).groupBy("word", "lang").count()
    top = held.groupBy("word").agg(F.sum("count").alias("n")).where("n >= 3").orderBy(F.desc("n"), "word").limit(LEXICON)
    counts: dict[bytes, np.ndarray] = {}
    for r in held.join(top, "word").collect():
        counts.setdefault(bytes(r["word"]), np.zeros(len(langs)))[langs.index(r["lang"])] = r["count"]
    total = np.maximum(1, sum(counts.values())) if counts else np.ones(len(langs))
    lexicon = {}
    for word, n in counts.items():
        share = np.log(n / total * total.mean() + 0.5)
        lexicon[word] = (share - share.mean()).astype(np.float32)
    rows = sample.select("lang", F.explode("chains").alias("chain"))
    # each language has its share of the lines, so that a rare one is learnt too
    rows = rows.selectExpr("*", "row_number() over (partition by lang order by xxhash64(chain), chain) as r")
    rows = rows.where(F.col("r") <= max(1, LINES // len(langs))).orderBy(F.xxhash64("chain"), "lang").collect()
    sample.unpersist()
    index: dict[bytes, int] = {}
    chains = [[index.setdefault(bytes(w), len(index)) for w in r["chain"]] for r in rows]
    spoken = [langs.index(r["lang"]) for r in rows]
    del rows
    labels = [np.full(len(c), lang) for c, lang in zip(chains, spoken)]
    words = list(index)
    none = np.zeros(len(langs), np.float32)
    known = np.array([lexicon.get(w, none) for w in words], float)
    n = len(langs)
    if n > 1:
        # relabel runs that the words themselves place clearly in another language
        w, scale, bias, _ = _fit(chains, labels, words, known, n, chain=False, rounds=25)
        loose = {"langs": langs, "ngrams": w, "lexicon": lexicon, "scale": scale, "bias": bias}
        sticky = np.log(np.full((n, n), 0.02 / max(1, n - 1)) + np.eye(n) * 0.98)
        emission = Emissions(loose)(words)
        lengths = np.array([len(c) for c in chains])
        post = marginals(emission[np.concatenate([np.array(c) for c in chains])], lengths, sticky)[0]
        flat = np.concatenate(labels)
        labels = np.split(np.where(post.max(axis=1) > 0.9, post.argmax(axis=1), flat), np.cumsum(lengths)[:-1])
        # switches: lines of different languages in one chain
        for i in range(0, len(spoken) - 1, 4):
            if spoken[i] != spoken[i + 1]:
                chains.append(chains[i][:20] + chains[i + 1][:20])
                labels.append(np.concatenate([labels[i][:20], labels[i + 1][:20]]))
    w, scale, bias, move = _fit(chains, labels, words, known, n, chain=True, rounds=40)
    return {"langs": langs, "ngrams": w.astype(np.float32), "lexicon": lexicon, "scale": scale, "bias": bias, "move": move}


class Tagger:
    """Sums of word distributions per text, with remembered emissions."""

    def __init__(self, model: dict):
        self.emit, self.move, self.n = Emissions(model), model["move"], len(model["langs"])
        self.known: dict[bytes, int] = {}
        self.table = np.empty((0, self.n), np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Languages' sums (texts x languages), words per text, and the sums of each word's likeliest language."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        known, cut = self.known, [lines_of(t) for t in texts]
        fresh = []
        for lines in cut:
            for line in lines:
                for word in line:
                    if word not in known:
                        known[word] = len(known)
                        fresh.append(word)
        if fresh:
            self.table = np.vstack([self.table, self.emit(fresh)])
        chains = [line for lines in cut for line in lines]
        owner = np.repeat(np.arange(len(cut)), [sum(map(len, lines)) for lines in cut])
        if not chains:
            return np.zeros((len(cut), self.n)), np.zeros(len(cut)), np.zeros(len(cut))
        ids = np.fromiter((known[w] for line in chains for w in line), np.int64, len(owner))
        post = marginals(self.table[ids], np.array([len(c) for c in chains]), self.move)[0]
        sums = np.column_stack([np.bincount(owner, post[:, k], len(cut)) for k in range(self.n)])
        return sums, np.bincount(owner, minlength=len(cut)), np.bincount(owner, post.max(axis=1), len(cut))


def predict(
    frame: DataFrame, model: dict, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score", sure_out: str | None = None
) -> DataFrame:
    """`frame` with lang_pred (a learned language; `und` for null texts and texts without a letter) and lang_score
    (share of the words' probability that it holds, 0 for `und`), under the names given, and where `sure_out` is named,
    the mean probability of each word's own likeliest language (high for clear words of several languages).

    All rows and other columns stay, repeated rows too; columns of the names given are replaced. Texts are tagged whole,
    in time proportional to their length. Of equally likely languages, the first by name counts. An empty table gives
    no rows."""
    langs = model["langs"]
    if not langs:
        return frame.withColumns({lang_out: F.lit("und"), score_out: F.lit(0.0)} | ({sure_out: F.lit(0.0)} if sure_out else {}))
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sure", T.DoubleType())])

    @F.pandas_udf(kind)
    @tidy("langid")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for texts in batches:
            names, scores, sure = [], [], []
            for low in range(0, len(texts), 512):
                part = list(texts.iloc[low : low + 512])
                sums, n, clear = tagger(part)
                best = sums.argmax(axis=1)
                for row, text in enumerate(part):
                    fits = n[row] > 0 and _LETTER.search(text) is not None
                    names.append(langs[best[row]] if fits else "und")
                    scores.append(float(sums[row, best[row]] / n[row]) if fits else 0.0)
                    sure.append(float(clear[row] / n[row]) if fits else 0.0)
            yield pd.DataFrame({"lang": names, "score": scores, "sure": sure})

    # one call gives all: the struct stays in the score's column until it is taken apart
    tagged = frame.withColumn(score_out, tag(text_of(text_col)))
    named = {lang_out: F.col(score_out)["lang"], score_out: F.col(score_out)["score"]}
    return tagged.withColumns(named | ({sure_out: F.col(score_out)["sure"]} if sure_out else {}))
