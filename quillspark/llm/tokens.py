"""Token counts by offset-mapped attribution.

Each document is encoded once, whole. The tokens' character spans then meet the sections' spans in an interval join
inside the row (both are sorted; no shuffle), and a token that crosses a boundary goes, whole, to the section that
holds most of its characters, the earlier one on a tie. A token that touches no section counts for section -1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str):
    """The byte-level encoding of a ranks file, and every token's length in bytes."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, rank in ranks.items():
        sizes[rank] = len(word)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def offsets(encoding, sizes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of a text's tokens. A token that holds part of a character spans that whole character."""
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    stops = np.cumsum(sizes[ids])
    starts = stops - sizes[ids]
    if text.isascii():
        return starts, stops
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))  # the character that each byte is part of
    return char[starts], char[np.maximum(stops - 1, 0)] + 1


def touched(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last section that each span shares characters with; first > last where none."""
    first = np.searchsorted(highs, starts, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(lows, np.maximum(ends, starts + 1), side="left") - 1  # the last that begins before its end
    return first, last


def attribute(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Section of each token span [start, end): the one with most of its characters, earlier on ties, else -1.

    Sections [low, high) are sorted and do not overlap. A token of no characters goes to the section that holds
    its position.
    """
    if not len(lows):
        return np.full(len(starts), -1)
    first, last = touched(starts, ends, lows, highs)
    ends = np.maximum(ends, starts + 1)
    best = np.full(len(starts), -1)
    most = np.zeros(len(starts), np.int64)
    for step in range(int(max(0, (last - first).max())) + 1 if len(first) else 0):
        at = first + step
        valid = at <= last
        if not valid.any():
            break
        safe = np.minimum(at, len(lows) - 1)
        shared = np.where(valid, np.minimum(ends, highs[safe]) - np.maximum(starts, lows[safe]), 0)
        better = shared > most
        best, most = np.where(better, at, best), np.where(better, shared, most)
    return best


def lines_of(text: str, width: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line that is not empty; a longer line is cut into fields of `width` characters."""
    lows, highs, at = [], [], 0
    for line in text.split("\n"):
        for low in range(0, len(line), width):
            lows.append(at + low)
            highs.append(at + min(low + width, len(line)))
        at += len(line) + 1
    return np.array(lows, np.int64), np.array(highs, np.int64)


def section_tokens(
    frame: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None
) -> DataFrame:
    """One row per input row: id, n_tokens, n_chars, crossing (tokens that touch two sections), outside (tokens
    that touch none), section_tokens array<long> in the order of the sections.

    `sections_col` names an array<struct<start:long,end:long>> (sorted, apart); without it, sections are the lines
    that are not empty, in fields of at most 1000 characters. Null and empty texts have no tokens and no sections. The parts always add up to n_tokens.
    Repeated rows give repeated results; an empty table gives no rows. Only the columns named are read.
    """
    kind = dict(frame.dtypes)[id_col]

    def count(batches):
        encoding, sizes = _encoding(ranks_path, pattern)
        for batch in batches:
            rows = []
            given = batch["sections"] if "sections" in batch else [None] * len(batch)
            for key, text, sections in zip(batch["id"], batch["text"], given):
                if sections is None:
                    lows, highs = lines_of(text)
                else:
                    lows = np.array([s["start"] for s in sections], np.int64)
                    highs = np.array([s["end"] for s in sections], np.int64)
                starts, stops = offsets(encoding, sizes, text)
                tallies = np.bincount(attribute(starts, stops, lows, highs) + 1, minlength=len(lows) + 1)
                crossing = 0
                if len(lows):
                    first, last = touched(starts, stops, lows, highs)
                    crossing = int((last > first).sum())
                rows.append((key, len(starts), len(text), crossing, int(tallies[0]), tallies[1:]))
            out = pd.DataFrame(rows, columns=["id", "n_tokens", "n_chars", "crossing", "outside", "section_tokens"])
            yield out.astype({"id": batch["id"].dtype})

    picked = [F.col(id_col).alias("id"), text_of(text_col).alias("text")]
    picked += [F.col(sections_col).alias("sections")] if sections_col else []
    schema = f"id {kind}, n_tokens long, n_chars long, crossing long, outside long, section_tokens array<long>"
    return frame.select(*picked).mapInPandas(count, schema).withColumnRenamed("id", id_col)
