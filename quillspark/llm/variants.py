"""Spelling variants by an index of variable-length grams.

1. Words: every text is cut into runs of letters, counted in the task and summed by shuffle.
2. Gram dictionary: grams of at least QMIN letters, fitted on a bounded sample of the words. A gram that more than
   `frequent` words hold is pruned in favour of its extensions by one letter, up to a longest length.
3. Decomposition: at each place of a word the shortest unpruned gram begins (else the one that ends the word or has the
   longest length). Finding it reads certain letters and no others, so an edit changes just the grams that read its
   place. The most of some grams of a word that any single edit can change is the bound of these grams.
4. Lists: words within one edit share every gram that the edit leaves, moved by one place at most. A word lists all its
   grams, with their places and its length, and asks for the rarest ones whose bound is below their number: two grams that
   read no letter in common, so that any edit leaves one of them. Lists meet by an equi-join.
5. Verify: candidates are kept if their edit distance is 1. An edit changes for two letters at most whether they occur
   an odd or even number of times, which one number per word tells before any letters are compared.

The longest length is at most the shorter word's length - QMIN. So there are more grams than any edit can change, hence two
that read no letter in common: nothing is missed, however the dictionary was fitted. It depends on the shorter word's length, so a word is
decomposed for words as long as itself, and for those shorter by one. Very long words have just two grams, their halves.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import saved
from .common import bounded_sample, text_of

#: Letters of a word, at least; occurrences, at least; every SLIPS-th (document, run) loses a letter.
LEAST, OCCURRENCES, SLIPS = 7, 2, 31
#: A form occurs so many times as often as its variant, at least.
RATIO = 10
#: Shortest gram, longest gram, words that may hold a gram before it is pruned, words and grams of the fitted dictionary at most.
QMIN, QMAX, FREQUENT, SAMPLE, GRAMS = 2, 8, 24, 200_000, 300_000
#: Words longer than this have their two halves for grams: one of them outlives any edit.
LONG = 64
#: Distinct words that a task holds before it hands on their counts.
HELD = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUNS = "[a-zÀ-ÿ]"


def word_counts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES, slips: int = SLIPS,
) -> DataFrame:
    """(word, n): distinct words of at least `least` letters and `occurrences` occurrences in whole texts.

    Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where `slips` divides the crc32 of `<id>:<run>`, the letter at
    crc32 modulo length is left out. A null text has no runs; a null id is written as an empty one.
    """
    run = re.compile(_RUNS + "{%d,}" % least)

    def counted(batches):
        found: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                here = Counter(run.findall(text.as_py().encode("utf-8").translate(_LOWER).decode("utf-8")))
                start = crc32(f"{'' if key is None else key}:".encode())
                for word, n in here.items():
                    slip = crc32(word.encode("utf-8"), start)
                    if slip % slips == 0:
                        at = slip % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    found[word] += n
                if len(found) > HELD:
                    yield _counts(found)
                    found = Counter()
        yield _counts(found)

    picked = documents.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    counts = picked.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= occurrences)


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def fit_grams(words: DataFrame, frequent: int = FREQUENT, sample: int = SAMPLE, grams: int = GRAMS) -> dict[str, int]:
    """The pruned grams (those held by more than `frequent` words, as estimated) with their frequencies in the sample.

    At most `grams`, the most frequent ones: their prefixes are at least as frequent, and are pruned too.
    """
    total = words.count()
    share = min(1.0, sample / total) if total else 1.0

    def counted(batches):
        found: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                found.update({word[p : p + q] for q in range(QMIN, QMAX) for p in range(len(word) - q + 1)})
                if len(found) > HELD:
                    yield _counts(found)
                    found = Counter()
        yield _counts(found)

    chosen = bounded_sample(words.select("word"), "word", sample)
    counts = chosen.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > max(1.0, frequent * share)).orderBy(F.desc("n")).limit(grams + 1).collect()  # bounded by `grams`
    least = top[grams]["n"] if len(top) > grams else 0
    return {r["word"]: r["n"] for r in top if r["n"] > least}


def decompose(word: str, pruned: dict[str, int], longest: int) -> list[tuple[int, str, int]]:
    """The word's gram at each place: its frequency (0 where not pruned), itself, and the last place that finding it reads."""
    n, found = len(word), []
    for p in range(n - QMIN + 1):
        q = QMIN
        while q < longest and p + q < n and word[p : p + q] in pruned:
            q += 1
        gram = word[p : p + q]
        frequency = pruned.get(gram, 0)
        # the word's end was read, too, where only it stopped the gram from growing
        found.append((frequency, gram, p + q if p + q == n and q < longest and frequency else p + q - 1))
    return found


def lists_and_asks(word: str, pruned: dict[str, int], shorter: int) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(place, gram) of what a word lists and of what it asks for, in pairs whose shorter word has `shorter` letters."""
    if shorter > LONG:
        half = shorter // 2
        both = [(0, word[:half]), (2, word[-half:])]
        return both, both
    found = decompose(word, pruned, min(QMAX, shorter - QMIN))
    best = None
    for p, (frequency, _, last) in enumerate(found):
        for other in range(last + 1, len(found)):
            cost = frequency + found[other][0]
            if best is None or cost < best[0]:
                best = (cost, p, other)
    return [(p, gram) for p, (_, gram, _) in enumerate(found)], [(p, found[p][1]) for p in best[1:]]


def _key(gram: str, place: int, length: int, longer: int) -> int:
    """A list's number. Lists that happen to share one only give candidates that verification drops."""
    return crc32(f"{gram} {place} {length} {longer}".encode()) - (1 << 31)


def _odd_letters(word: str) -> int:
    """Bits of the letters (modulo 31) that occur an odd number of times."""
    bits = 0
    for letter in word:
        bits ^= 1 << ord(letter) % 31
    return bits


def near_words(words: DataFrame, pruned: dict[str, int], least: int = LEAST) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of `words` (word, n; distinct, of at least `least` letters) that one edit tells apart,
    each pair once."""
    if least < 2 * QMIN:
        raise ValueError(f"words need {2 * QMIN} letters")
    held = words.sparkSession.sparkContext.broadcast(pruned)

    def lists(batches):
        grams = held.value
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                keys, asks, owners = [], [], []
                some = part.column(0).to_pylist()
                odd = pa.array(map(_odd_letters, some), pa.int32())
                for owner, word in enumerate(some):
                    n = len(word)
                    own, asked = lists_and_asks(word, grams, n)
                    keys += [_key(gram, p, n, 0) for p, gram in own]
                    for p, gram in asked:  # for words as long as itself, and those longer by one
                        keys += (_key(gram, p, n, 0), _key(gram, p, n, 1), _key(gram, p + 1, n, 1))
                    asks += [False] * len(own) + [True] * (3 * len(asked))
                    owners += [owner] * (len(own) + 3 * len(asked))
                    if n > least:  # is found by words shorter by one
                        if not QMAX + QMIN < n <= LONG:  # else the grams are the same
                            own, _ = lists_and_asks(word, grams, n - 1)
                        keys += [_key(gram, p, n - 1, 1) for p, gram in own]
                        asks += [False] * len(own)
                        owners += [owner] * len(own)
                owners = pa.array(owners, pa.int64())
                rows = part.take(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int32()), pa.array(asks, pa.bool_()), odd.take(owners), rows.column(0), rows.column(1)],
                    names=["key", "asks", "odd", "word", "n"],
                )

    rows = saved(words.select("word", "n").mapInArrow(lists, "key int, asks boolean, odd int, word string, n long"))
    asking = rows.where("asks").select("key", F.col("odd").alias("odd_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    listed = rows.where("not asks").select("key", F.col("odd").alias("odd_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    alike = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2
    met = asking.join(listed, "key").where(alike & ((F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) in which every word occurs once and forms lead to no cycle: the last form.

    Chains double in length each round. A form is more frequent than its word, so they end.
    """
    reached = saved(forms.select("word", F.col("form").alias("root")))
    for _ in range(64):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = saved(reached.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        reached = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return reached
    raise ValueError("forms lead in a circle")


def group_variants(words: DataFrame, ratio: int = RATIO, least: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """One row per word of `words` (word, n): word, form, root, n, n_near, form_n.

    Near words are one edit apart. The form is the most frequent near word (the smallest in code point order on ties), if it
    occurs at least `ratio` times as often; root follows forms to the last. Words without a form are their own root.
    An empty table gives no rows.
    """
    words = saved(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = saved(near_words(words, fit_grams(words, frequent), least))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    close = words.join(best, "word", "left").select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    is_form = F.col("near_n") >= ratio * F.col("n")
    judged = saved(close.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    ))
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of whole texts: `word_counts`, then `group_variants`. Other columns are not read;
    repeated rows count again."""
    return group_variants(word_counts(documents, id_col, text_col))
