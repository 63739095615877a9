"""Phrase collocation mining by a weighted de Bruijn graph.

Nodes are runs of (longest - 1) words, edges the runs of `longest` words that join two overlapping nodes, weighted by their
occurrences within pieces. Every place of a piece gives one run only: the longest that begins there. It is an edge, or,
where the piece ends, a shorter run. So how often a phrase occurs is what flows through its node: the weights of the runs
that extend it by a word, plus those that end with it. Level by level the counts of shorter phrases follow, and no shorter
run is ever cut from a text.

Only frequent phrases are asked for, and every part of one is frequent. So words, then pairs of words, that are not frequent
end a piece as well. Two bit sets of at most 2 ** MOST_BITS bits, built by Spark, hold what may be frequent: a wrong
bit costs rows, never a result.

Unary paths (edges whose joining node passes its whole weight on) are compacted by doubling: they are passages that
repeat as a whole.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved
from .common import text_of

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits a key of a bit set, and the logarithm of the most bits (64 MB).
BITS_A_KEY, MOST_BITS = 16, 29
#: Words handled at a time, and distinct words that a task holds.
WORDS, HELD = 1_000_000, 250_000
#: Rows of a counted side that may be broadcast.
SMALL_ROWS = 500_000
#: Shards of the first cut of each language's ranking.
SHARDS = 64

#: A-Z to a-z, tabs to blanks, and the characters that end a piece to `A`, which no lower-cased text holds.
_MARKED = bytes(65 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _cut(text: str) -> list[bytes]:
    """The words of a text, with `A` between pieces."""
    return text.encode("utf-8").translate(_MARKED).replace(b"A", b" A ").split()


def word_totals(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n): occurrences of every word in whole texts; a null language is `und`, a null text empty."""

    def counted(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, Counter()).update(_cut(text.as_py()))
            if sum(map(len, found.values())) > HELD:
                yield _rows(found)
                found = {}
        yield _rows(found)

    return _texts(documents, text_col, lang_col).mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _rows(found: dict[str, Counter]) -> pa.RecordBatch:
    for words in found.values():
        words.pop(b"A", None)
    langs = [lang for lang, words in found.items() for _ in words]
    words = [w.decode("utf-8") for words in found.values() for w in words]
    counts = [n for words in found.values() for n in words.values()]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])


def _texts(documents: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))


def bit_set(keys: DataFrame, key: str) -> np.ndarray:
    """Bytes of a bit set in which the bit (key modulo its size) of every key (a long of 0 or more) is set.

    Spark gathers the bits into blocks; only these, 64 MB at most, come to the driver, whatever the number of keys.
    """
    size = min(1 << MOST_BITS, max(1 << 16, 1 << (max(1, keys.count()) * BITS_A_KEY - 1).bit_length()))
    place = F.col(key) % size + 1  # Spark's blocks count from one
    blocks = keys.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    held = np.zeros(size // 8, np.uint8)
    for row in blocks.collect():
        some = np.frombuffer(bytes(row["bits"]), np.uint8)
        held[(row["block"] - 1) * 4096 : row["block"] * 4096] = some[: len(held)]
    return held


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys % (len(bits) * 8)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


class _Coder:
    """Words of many texts as numbers: 0 for the end of a piece and for words that cannot be frequent."""

    def __init__(self, words: np.ndarray):
        self.words, self.size = words, len(words) * 8
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}
        self.names, self.langs, self.hashes, self.seen = [b""], [""], [0], 0

    def __call__(self, lang: str, text: str) -> np.ndarray:
        found, known = _cut(text), self.known.setdefault(lang, {b"A": 0})
        for word in [w for w in set(found) if w not in known]:
            bit = crc32(word, crc32(lang.encode() + b"\n")) % self.size
            self.seen += 1
            if self.words[bit >> 3] >> (bit & 7) & 1:
                known[word] = len(self.names)
                self.names.append(word)
                self.langs.append(lang)
                self.hashes.append(crc32(word, crc32(lang.encode())) << 31 ^ crc32(word))
            else:
                known[word] = 0
        return np.fromiter(map(known.__getitem__, found), np.int32, len(found))

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all neighbouring words (0 or more), and whether both are there."""
        hashes = np.array(self.hashes, np.uint64)[ids]
        mixed = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1:] ^ (hashes[1:] >> np.uint64(17))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)).astype(np.int64), (ids[:-1] > 0) & (ids[1:] > 0)


def _blocks(batches, coder: _Coder):
    """Numbers of many texts in one array, with 0 between texts."""
    parts, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts += [coder(lang, text.as_py()), np.zeros(1, np.int32)]
            size += len(parts[-2]) + 1
            if size > WORDS:
                yield np.concatenate(parts)
                parts, size = [], 0
                if coder.seen > HELD:
                    coder.reset()
    if parts:
        yield np.concatenate(parts)


def _pair_totals(texts: DataFrame, words) -> DataFrame:
    """(pair, n): occurrences of neighbouring words by a number of theirs; pairs that share one are counted together."""

    def counted(batches):
        coder = _Coder(words.value)
        for ids in _blocks(batches, coder):
            keys, both = coder.pairs(ids)
            pair, n = np.unique(keys[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return texts.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def longest_runs(texts: DataFrame, words, pairs, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, n): from every place the longest run of words of 2 to `longest` that may be frequent, within
    its piece, with its occurrences. Runs of `longest` are the graph's edges, the others end pieces."""

    def counted(batches):
        coder = _Coder(words.value)
        for ids in _blocks(batches, coder):
            keys, both = coder.pairs(ids)
            good = np.append(both & _has(pairs.value, keys), False)
            size = np.where(ids > 0, 1, 0)
            going = ids > 0
            for step in range(1, longest):
                going = going & np.append(good, np.zeros(step, bool))[step - 1 : step - 1 + len(ids)]
                size += going
            codes = ids.astype(np.int64)  # of the run of `length` words from each place, among those that are so long
            langs, phrases, sizes, counts = [], [], [], []
            for length in range(2, longest + 1):
                at = np.flatnonzero(size >= length)
                fresh = codes[at] << 32 | ids[at + length - 1]
                _, first, codes_at = np.unique(fresh, return_index=True, return_inverse=True)
                codes = np.zeros(len(ids), np.int64)
                codes[at] = codes_at
                ends = size[at] == length
                n = np.bincount(codes_at[ends], minlength=len(first))
                for k in np.flatnonzero(n):
                    run = ids[at[first[k]] : at[first[k]] + length].tolist()
                    langs.append(coder.langs[run[0]])
                    phrases.append(b" ".join([coder.names[i] for i in run]).decode("utf-8"))
                    counts.append(int(n[k]))
                sizes += [length] * (len(phrases) - len(sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())],
                names=["lang", "phrase", "size", "n"],
            )

    runs = texts.mapInArrow(counted, "lang string, phrase string, size int, n long")
    return runs.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _head(words: int) -> Column:
    return F.substring_index("phrase", " ", words)


def node_flows(runs: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """(lang, phrase, size, n) of all phrases of `longest`, `longest` - 1, ..., 2 words: a node's flow is the sum over its
    extensions by a word, plus the runs that end with it."""
    levels = [runs.where(F.col("size") == longest)]
    for size in range(longest - 1, 1, -1):
        through = levels[-1].select("lang", _head(size).alias("phrase"), "n")
        ending = runs.where(F.col("size") == size).select("lang", "phrase", "n")
        flow = through.unionAll(ending).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        levels.append(flow.select("lang", "phrase", F.lit(size).alias("size"), "n"))
    return levels


def frequent_phrases(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 to `longest` words that occur at least `least` times: (lang, phrase, size, n); such words: (lang, word,
    n); all words of each language: (lang, n)."""
    texts, spark = _texts(documents, text_col, lang_col), documents.sparkSession
    words = saved(word_totals(documents, text_col, lang_col))
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("n")))
    often = saved(words.where(F.col("n") >= least))
    marks = often.select(F.crc32(F.concat_ws("\n", "lang", "word").cast("binary")).alias("mark"))
    word_bits = spark.sparkContext.broadcast(bit_set(marks, "mark"))
    pairs = saved(_pair_totals(texts, word_bits).where(F.col("n") >= least).select("pair"))
    pair_bits = spark.sparkContext.broadcast(bit_set(pairs, "pair"))
    runs = saved(longest_runs(texts, word_bits, pair_bits, longest))
    phrases = None
    for level in node_flows(runs, longest):
        kept = level.where(F.col("n") >= least)
        phrases = kept if phrases is None else phrases.unionAll(kept)
    return saved(phrases), often, totals


def unary_paths(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, path_words): the edges (phrases of `longest` words) that lie on a compacted path of several, with the
    path's length in words.

    Edges join where the node between passes its whole weight from the one to the other, so each has one successor and one
    predecessor at most, and a path has a beginning: a text has one. Jumps double in length each round.
    """
    edges = phrases.where(F.col("size") == longest)
    tail = F.expr(f"substring_index(phrase, ' ', {1 - longest})")
    nodes = phrases.where(F.col("size") == longest - 1).select("lang", F.col("phrase").alias("node"), "n")
    into = edges.select("lang", F.col("phrase").alias("edge"), tail.alias("node"), "n")
    out = edges.select("lang", F.col("phrase").alias("next"), _head(longest - 1).alias("node"), "n")
    step = saved(into.join(nodes, ["lang", "node", "n"]).join(out, ["lang", "node", "n"]).select("lang", "edge", "next"))
    # every edge of a path: its last edge, how far that lies
    ends = step.select("lang", F.col("next").alias("edge")).join(step.select("lang", "edge"), ["lang", "edge"], "left_anti")
    far = step.select("lang", "edge", F.col("next").alias("jump"), F.lit(1).cast("long").alias("far"))
    far = saved(far.unionAll(ends.select("lang", "edge", F.lit(None).cast("string").alias("jump"), F.lit(0).cast("long").alias("far"))))
    rounds = 0
    while rounds < 60:
        rounds += 1
        onward = far.select("lang", F.col("edge").alias("jump"), F.col("jump").alias("beyond"), F.col("far").alias("further"))
        moved = saved(far.join(onward, ["lang", "jump"], "left").select(
            "lang", "edge", F.coalesce("beyond", "jump").alias("jump"), (F.col("far") + F.coalesce("further", F.lit(0))).alias("far"), F.col("beyond").isNotNull().alias("moved"),
        ))
        far = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    reach = far.select("lang", "edge", F.coalesce("jump", "edge").alias("last"), "far")
    length = reach.groupBy("lang", "last").agg((F.max("far") + longest).alias("path_words"))
    return reach.join(length, ["lang", "last"]).select("lang", F.col("edge").alias("phrase"), "path_words")


def _small(frame: DataFrame) -> DataFrame:
    """A broadcast hint where the counted rows are few; phrases and words are short but for odd ones, whose bytes are counted, too."""
    size = frame.agg(F.count("*").alias("n"), F.sum(F.octet_length(frame.columns[1]) if len(frame.columns) > 2 else F.octet_length(frame.columns[0])).alias("bytes")).first()
    return F.broadcast(frame) if size["n"] <= SMALL_ROWS and (size["bytes"] or 0) <= 64 * SMALL_ROWS else frame


def scored_cuts(phrases: DataFrame, words: DataFrame, totals: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, a, n, l, r, score): of all cuts of a phrase in two that with the lowest floor(1000 a n / (l r)),
    the shortest first part on ties. Products are decimals of 38 digits."""
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")).unionAll(words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    counts = _small(saved(counts))
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), k)
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(_small(totals), "lang")
    exact = F.expr("cast((1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as bigint)")
    lowest = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "size", "a", "n", "cut.l", "cut.r", "cut.score")


def without_parts(phrases: DataFrame, scored: DataFrame) -> DataFrame:
    """`scored` without phrases that only occur within one longer phrase of `phrases`. If any longer phrase is as frequent,
    one that is longer by a single word is, since it lies between the two."""
    longer = phrases.where("size > 2")
    parts = F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase")
    around = longer.select("lang", parts, "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    return scored.join(around, ["lang", "phrase"], "left").where("around is null or around < a").drop("around")


def ranked_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first `top` with their rank: by score and frequency descending, then the phrase.

    A first cut keeps the best `top` of each of SHARDS parts, so no task ranks a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top).drop("shard", "place")


def collocations(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words (words of the compacted path that a longest phrase lies on; else
    the phrase's own).

    Everything is counted over whole texts and per language (`und` for null). Null and empty texts count nothing, repeated
    rows count again, an empty table gives no rows. Other columns are not read.
    """
    phrases, words, totals = frequent_phrases(documents, text_col, lang_col, longest, least)
    best = saved(ranked_phrases(without_parts(phrases, scored_cuts(phrases, words, totals, longest)), top))
    shown = best.join(unary_paths(phrases, longest), ["lang", "phrase"], "left")
    return shown.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.coalesce("path_words", F.col("size").cast("long")).alias("path_words"))
