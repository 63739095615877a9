"""Packing by minimum bin slack.

1. Tokenise: one pass over the texts gives, per document, pieces of at most `window` ids. Full pieces are sequences
   of their own; at most one shorter remainder per document is left.
2. Pack: remainders are dealt by a hash into groups of about `group_rows` rows (their number follows the input, no
   group grows with it). In a group, the longest remaining length opens a window and a bitset subset-sum over the
   remaining length multiset finds the fill closest to capacity; backtracking gives how many of each length to take.

Only (document, start, length) of remainders is shuffled, never ids or texts.
"""

from __future__ import annotations

from array import array
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, saved, text_of, tidy
from .wordparts import LATIN_PARTS, NOT_LATIN, added_tokens, byte_letters, cuts_words, read_spec

WINDOW = 4096
END_ID = 2
#: Distinct words and marks whose ids a worker remembers (twice as many at most).
REMEMBERED = 250_000


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordIds:
    """Ids of whole texts for a lower-casing tokenizer that drops white space and never merges across words.

    Such a tokenizer's ids of a text are the ids of the parts that its pattern cuts, in order, so each distinct part
    goes to the tokenizer's model once and is remembered (a bounded number per worker, the older half forgotten
    first). A text with other letters than those of LATIN_PARTS, or with an added token, is encoded whole by the
    tokenizer.
    """

    def __init__(self, path: str, added: dict[str, int]):
        self.tokenizer = _tokenizer(path)
        self.letters = dict(enumerate(byte_letters()))
        self.added = added
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _fresh(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            raw = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = array("I", [x.id for x in self.tokenizer.model.tokenize(raw)]).tobytes()
        self.known[part] = ids
        return ids

    def _ids(self, text: str) -> np.ndarray:
        if NOT_LATIN.search(text) or any(map(text.__contains__, self.added)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        parts = LATIN_PARTS.findall(text.lower())
        ids = list(map(self.known.get, parts))
        if None in ids:
            ids = [self._fresh(p) if i is None else i for p, i in zip(parts, ids)]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        return np.frombuffer(b"".join(ids), "<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self._ids(t) for t in texts]


class TextIds:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def encoder(path: str):
    """WordIds where the tokenizer file drops white space before merging, else TextIds; a worker keeps it between tasks."""

    def make():
        spec = read_spec(path)  # its vocabulary is not kept beside the tokenizer's
        return WordIds(path, added_tokens(spec)) if cuts_words(spec) else TextIds(path)

    return kept("packing", path, make)


def pieces(
    frame: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of every row's ids (with `end_id` at the end): id, start, length, ids_crc32, doc_tokens[, ids].

    A null or empty text has the one id `end_id`. Repeated rows give repeated pieces.
    """
    kind = dict(frame.dtypes)[id_col]
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    @tidy("packing")
    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                for key, ids in zip(part["id"], encode(list(part["text"]))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        some = ids[start : start + window]
                        row = (key, start, len(some), crc32(some.tobytes()), len(ids))
                        rows.append((*row, some.astype("int32")) if keep_ids else row)
            yield pd.DataFrame(rows, columns=columns).astype({"id": batch["id"].dtype})

    picked = frame.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return picked.mapInPandas(cut, schema).withColumnRenamed("id", id_col)


def minimum_slack(counts: Counter, capacity: int) -> list[int]:
    """Lengths of the multiset whose sum is the largest not above `capacity`; `counts` holds what there is.

    reach is a bitset of the sums that the lengths so far can make; each length joins by doubling shifts (as many
    as its count needs). The reach before each shift is kept, and walking back through them gives the counts.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for size in sorted(counts, reverse=True):
        left = min(counts[size], capacity // size) if size <= capacity else 0
        lump = 1
        while left > 0:
            lump = min(lump, left)
            steps.append((reach, size, lump))
            reach |= (reach << (size * lump)) & mask
            left -= lump
            lump *= 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, []
    for before, size, lump in reversed(steps):
        if not before >> total & 1:
            taken += [size] * lump
            total -= size * lump
    return taken


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of indexes into `lengths` (each of 1 to `window`)."""
    held: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        held.setdefault(n, []).append(i)
    counts, windows = Counter({n: len(x) for n, x in held.items()}), []
    while counts:
        longest = max(counts)
        taken = Counter([longest])
        counts[longest] -= 1
        taken.update(minimum_slack(+counts, window - longest))
        for n, k in taken.items():
            if n != longest:
                counts[n] -= k
            else:
                counts[n] -= k - 1
        counts = +counts
        windows.append([held[n].pop() for n, k in taken.items() for _ in range(k)])
    return windows


def pack(
    frame: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    end_id: int = END_ID, group_rows: int = 2500,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Offsets are gapless from 0 in each sequence, and no sequence is longer than `window`. Sequence ids are unique
    longs (the group's number in the upper part). An empty table gives no rows. Ties between equal lengths are
    settled by (id, start), repeated rows keep a piece each. `frame` may have any other columns; they are not read.
    """
    cut = saved(pieces(frame, tokenizer, id_col, text_col, window, end_id))
    groups = max(1, -(-cut.where(F.col("length") < window).count() // group_rows))
    width = (1 << 31) - 1

    def fill(key, batch):
        batch = batch.sort_values(["id", "start", "ids_crc32"]).reset_index(drop=True)
        sequence, offset = np.zeros(len(batch), "int64"), np.zeros(len(batch), "int64")
        for number, members in enumerate(pack_lengths(batch["length"].tolist(), window)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (int(key[0]) << 32) + number, at
                at += int(batch["length"][i])
        return batch.assign(sequence_id=sequence, offset=offset)[columns]

    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = dict(frame.dtypes)[id_col]
    dealt = cut.withColumnRenamed(id_col, "id").withColumn("pack_group", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(groups)))
    packed = (
        dealt.where(F.col("length") < window)
        .groupBy("pack_group")
        .applyInPandas(
            fill, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        )
    )
    # a full piece is a sequence by itself; negative ids keep clear of the packed ones
    full = dealt.where(F.col("length") == window).select(
        *columns[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    assert groups < width
    return packed.unionByName(full).withColumnRenamed("id", id_col)
