"""BPE encoding and decoding by a minimal acyclic transducer lexicon.

1. Fit: the words of all documents are counted; the most frequent ones are compiled, with the ids that the
   merges give them, into the smallest acyclic automaton that accepts just these words: equal endings share their
   states. Every transition carries a number, and the numbers on a word's path add up to the word's place in the
   table of id outputs.
2. Publish: the automaton is one flat file in the shared folder. Spark hands it to the executors' machines, where the
   workers map it into memory, so they share its pages.
3. Encode: a text is cut into words as the tokenizer file says. A word's ids come from the automaton, or, for a word that
   it does not hold, from merging its bytes by rank. Decoding looks up every id's token.

The counts only decide which words are looked up rather than merged: ids are the same with any lexicon.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import saved, shared_dir
from .common import text_of
from .wordparts import LATIN_PARTS, NOT_LATIN, added_tokens, byte_letters, cuts_words, spec_of

#: Words that the lexicon holds, at most, and words that a task counts before it hands their counts on.
WORDS, COUNTED = 100_000, 200_000
#: Words whose ids a worker remembers (twice as many at most), documents and characters handled at a time.
REMEMBERED, ROWS, CHARACTERS = 250_000, 256, 4_000_000
#: Bits of an id within a number that holds two, the mask of the second, and a number above all pairs' ranks.
BITS, MADE, NEVER = 24, (1 << 24) - 1, 1 << 62
#: The automaton file: a mark, five counts, then the arrays in this order.
MARK = 0x4C455831
LAYOUT = (("keys", "<i8", 0), ("values", "<i8", 2), ("targets", "<i4", 0), ("numbers", "<i4", 0), ("offsets", "<i4", 2), ("final", "u1", 1))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of the minimal acyclic automaton of `entries` (words with their ids).

    Words join in byte order. What of the last word's path the next word does not share cannot change any more, so
    its states are looked up, longest endings first, among those already kept, and only new ones are added.
    """
    kept: dict[tuple, int] = {}
    order: list[tuple] = []

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in kept:
            kept[key] = len(order)
            order.append(key)
        return kept[key]

    path, last, words = [[False, []]], b"", sorted(entries)
    for word in [*words, None]:
        shared = 0
        if word is not None:
            limit = min(len(word), len(last))
            while shared < limit and word[shared] == last[shared]:
                shared += 1
        while len(path) - 1 > shared:
            target = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], target))
        if word is not None:
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            last = word
    root = settle(path[0])
    below = []  # words that end at or after a state
    keys, targets, numbers = [], [], []
    for at, (final, steps) in enumerate(order):
        passed = int(final)
        for letter, target in steps:
            keys.append(at * 256 + letter)
            targets.append(target)
            numbers.append(passed)
            passed += below[target]
        below.append(passed)
    ids = [entries[w] for w in words]
    arrays = {
        "keys": keys, "targets": targets, "numbers": numbers, "final": [f for f, _ in order],
        "values": [i for some in ids for i in some], "offsets": np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype="i8"))),
    }
    head = np.array([MARK, root, len(keys), len(order), len(arrays["values"]), len(words) + 1], "<i8").tobytes()
    return head + b"".join(np.asarray(arrays[name], kind).tobytes() for name, kind, _ in LAYOUT)


class Lexicon:
    """An automaton file, mapped into memory."""

    def __init__(self, file: str):
        raw = np.memmap(file, np.uint8, "r")
        mark, self.root, n_keys, n_states, n_values, n_offsets = raw[:48].view("<i8").tolist()
        if mark != MARK:
            raise ValueError(f"{file} is no lexicon")
        sizes = {"keys": n_keys, "targets": n_keys, "numbers": n_keys, "values": n_values, "offsets": n_offsets, "final": n_states}
        at = 48
        for name, kind, _ in LAYOUT:
            width = np.dtype(kind).itemsize * sizes[name]
            setattr(self, name, raw[at : at + width].view(kind))
            at += width

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table of outputs, -1 for words that the automaton does not hold; all words walk in step."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return found
        sizes = np.array([len(w) for w in words], np.int64)
        text, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        walking = np.flatnonzero(sizes > 0)
        state, total = np.full(len(walking), self.root, np.int64), np.zeros(len(walking), np.int64)
        step = 0
        while len(walking):
            key = state * 256 + text[starts[walking] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            walking, at, total = walking[there], at[there], total[there]
            state, total = self.targets[at].astype(np.int64), total + self.numbers[at]
            step += 1
            over = sizes[walking] == step
            ends = over & (self.final[state] == 1)
            found[walking[ends]] = total[ends]
            walking, state, total = walking[~over], state[~over], total[~over]
        return found

    def outputs(self, place: int) -> list[int]:
        return self.values[self.offsets[place] : self.offsets[place + 1]].tolist()

    def coded(self, places: np.ndarray) -> list[bytes]:
        """The outputs at all these places, each as little-endian 32-bit ids."""
        low = self.offsets[places].astype(np.int64)
        sizes = self.offsets[places + 1] - low
        ends = np.cumsum(sizes)
        flat = self.values[np.repeat(low - ends + sizes, sizes) + np.arange(sizes.sum())].astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist())]


class Merges:
    """A tokenizer file's vocabulary and merges: a word's bytes to ids, ids to tokens."""

    def __init__(self, path: str):
        spec = spec_of(path)
        model = spec["model"]
        if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE files are supported")
        vocab, self.letters, end = model["vocab"], byte_letters(), model.get("end_of_word_suffix") or ""
        # a pair's ids as one number: its rank and the id that it makes as one number
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[left] << BITS | vocab[right], rank << BITS | vocab[left + right])
        self.first = [vocab[x] for x in self.letters]
        self.last = [vocab[x + end] for x in self.letters]
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in added_tokens(spec).items()}

    def __call__(self, word: bytes) -> list[int]:
        """The ids of one word: of all neighbours the pair of lowest rank merges, the leftmost of equals, until none is left."""
        if not word:
            return []
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        find = self.ranks.get
        pairs = [find(a << BITS | b, NEVER) for a, b in zip(ids, ids[1:])]
        while pairs and (low := min(pairs)) != NEVER:
            at, made = pairs.index(low), low & MADE
            ids[at] = made
            del ids[at + 1], pairs[at]
            if at:
                pairs[at - 1] = find(ids[at - 1] << BITS | made, NEVER)
            if at < len(pairs):
                pairs[at] = find(made << BITS | ids[at + 1], NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs and a linked list, for words of any length."""
        n, find = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(pair, at) for at, (a, b) in enumerate(zip(ids, ids[1:])) if (pair := find(a << BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            pair, at = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right < 0 or find(ids[at] << BITS | ids[right]) != pair:
                continue
            ids[at], ids[right], after[at] = pair & MADE, -1, after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0 and (pair := find(ids[left] << BITS | ids[after[left]])) is not None:
                    heapq.heappush(heap, (pair, left))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


class Cutter:
    """Cuts texts into words, as plain strings, and added tokens, as ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = spec_of(path)
        self.added = added_tokens(spec)
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens must match raw text as it is")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.plain, whole = cuts_words(spec), Tokenizer.from_file(path)
        self.normalizer, self.cut = whole.normalizer, whole.pre_tokenizer
        self.bytes = {letter: b for b, letter in enumerate(byte_letters())}

    def _words(self, text: str) -> list[str]:
        if self.plain and not NOT_LATIN.search(text):
            return LATIN_PARTS.findall(text.lower())
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        parts = self.cut.pre_tokenize_str(text) if text else []
        return [bytes(self.bytes[x] for x in part).decode("utf-8") for part, _ in parts]

    def __call__(self, text: str) -> list[str | int]:
        if not any(map(text.__contains__, self.added)):
            return self._words(text)
        out: list[str | int] = []
        for piece in self.split.split(text):
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                out += self._words(piece)
        return out


@lru_cache(maxsize=2)
def cutter_of(path: str) -> Cutter:
    return Cutter(path)


class Encoder:
    """Ids of texts: words by the lexicon, else by merging; a bounded number of words is remembered."""

    def __init__(self, path: str, lexicon: Lexicon | None):
        self.cut, self.merges, self.lexicon = cutter_of(path), merges_of(path), lexicon
        self.known: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}

    def _learn(self, words: list[str | int]) -> None:
        fresh = []
        for word in words:
            ids = self.older.get(word)
            if ids is not None:
                self.known[word] = ids
            elif isinstance(word, int):
                self.known[word] = np.array([word], "<i4").tobytes()
            else:
                fresh.append(word)
        raw = [w.encode("utf-8") for w in fresh]
        places = self.lexicon.places(raw) if self.lexicon else np.full(len(raw), -1)
        held = np.flatnonzero(places >= 0)
        if len(held):
            self.known.update(zip(map(fresh.__getitem__, held.tolist()), self.lexicon.coded(places[held])))
        for at in np.flatnonzero(places < 0).tolist():
            self.known[fresh[at]] = np.array(self.merges(raw[at]), "<i4").tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        unseen = list(set().union(*cut).difference(self.known))
        if unseen:
            self._learn(unseen)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4") for words in cut]


class Decoder:
    """Texts of ids, special tokens kept."""

    def __init__(self, path: str):
        self.tokens, self.decoder = merges_of(path).tokens, None
        if spec_of(path).get("decoder"):
            from tokenizers import Tokenizer

            self.decoder = Tokenizer.from_file(path).decoder

    def __call__(self, ids: np.ndarray) -> str:
        ids = ids.tolist()
        try:
            tokens = list(map(self.tokens.__getitem__, ids))
        except KeyError:
            tokens = [self.tokens[i] for i in ids if i in self.tokens]
        return " ".join(tokens) if self.decoder is None else self.decoder.decode(tokens)


def fit_lexicon(documents: DataFrame, tokenizer: str, text_col: str = "text", words: int = WORDS) -> bytes:
    """The automaton file of the `words` most frequent words (ties by byte order) of all documents."""

    def counts_of(found: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in found.items() if isinstance(w, str)]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def counted(batches):
        cut, found = cutter_of(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(cut(text.as_py()))
                if len(found) > COUNTED:
                    yield counts_of(found)
                    found = Counter()
        yield counts_of(found)

    texts = documents.select(text_of(text_col).alias("text"))
    counts = saved(texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # how many words have each count: those above `least` all fit, of those that have it only the first
    least, room = 0, words
    for r in counts.groupBy("n").agg(F.count("*").alias("held")).orderBy(F.desc("n")).collect():
        if r["held"] > room:
            least = r["n"]
            break
        room -= r["held"]
    top = counts.where(F.col("n") > least).select("word").collect()  # `words` at most
    if least and room:
        top += counts.where(F.col("n") == least).select("word").orderBy("word").limit(room).collect()
    merge = merges_of(tokenizer)
    return compile_lexicon({(raw := r["word"].encode("utf-8")): merge(raw) for r in top})


def publish(spark: SparkSession, content: bytes) -> str:
    """Write the file to the shared folder and hand it to all executors; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(
    documents: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False,
) -> DataFrame:
    """One row per row: id, n_tokens, ids array<int>[, decoded: the text of these ids].

    `lexicon` is the name that `publish` gave; without it every word is merged. A null or empty text has no ids and
    decodes to an empty text; repeated rows give repeated rows, an empty table none. Texts are read whole, and words of
    any length merge in n log n. Other columns are not read.
    """
    kind = dict(documents.dtypes)[id_col]
    names = ["id", "n_tokens", "ids"] + ["decoded"] * decoded

    def coded(batches):
        encoder = Encoder(tokenizer, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
        decoder = Decoder(tokenizer) if decoded else None
        for batch in batches:
            low, texts = 0, batch.column(1)
            while low < len(batch):
                some, size = [], 0
                while low + len(some) < len(batch) and len(some) < ROWS and size < CHARACTERS:
                    some.append(texts[low + len(some)].as_py())
                    size += len(some[-1])
                ids = encoder(some)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype="i8")))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                arrays = [batch.column(0).slice(low, len(some)), pa.array(np.diff(ends), pa.int64()), lists]
                if decoded:
                    arrays.append(pa.array([decoder(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                low += len(some)

    picked = documents.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {kind}, n_tokens long, ids array<int>" + ", decoded string" * decoded
    return picked.mapInArrow(coded, schema).withColumnRenamed("id", id_col)


def decode(frame: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`frame` with the text of its ids, special tokens kept, as `out_col`; null ids give null, ids out of the vocabulary nothing."""

    @F.pandas_udf("string")
    def text(column):
        decoder = Decoder(tokenizer)
        return column.map(lambda ids: None if ids is None else decoder(np.asarray(ids)))

    return frame.withColumn(out_col, text(F.col(ids_col)))
