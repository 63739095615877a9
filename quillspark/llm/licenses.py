"""License scans: exact base phrases and fuzzy short notices (pigeonhole seeds, then bounded-error regexes).

A notice of n characters may carry k = n // 10 edits (1 to 6). Cut into k + 1 pieces, at least one piece survives k
edits unharmed, so an exact multi-pattern search for the pieces finds every possible place; only there does the
`regex` library look for the whole notice with at most k insertions, deletions and substitutions, best match first.
Everything happens within a row: no shuffle, and memory for one batch of texts.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, text_of

# Phrases of the contract with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices, by the label they give.
NOTICES = {
    "apache": ["licensed under the apache license version 2 0", "apache license version 2 0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "neither the name of the copyright holder nor the names of its contributors",
    ],
    "cc-by": ["creative commons attribution", "licensed under cc by"],
    "cc0": ["creative commons zero public domain dedication", "cc0 1 0 universal"],
    "gpl": [
        "gnu general public license",
        "under the terms of the gnu general public license as published by the free software foundation",
    ],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy", "released under the mit license"],
    "mpl": ["subject to the terms of the mozilla public license"],
    "public-domain": ["released into the public domain", "dedicated to the public domain"],
    "reserved": ["all rights reserved", "unauthorized copying of this file is strictly prohibited"],
    "spdx": ["spdx license identifier"],
    "no-commercial": ["not for commercial use without permission"],
}

SCAN_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "spans array<struct<label:string,start:long,end:long,errors:int,score:double>>"
)


def allowed_errors(notice: str) -> int:
    """Edits that a notice may carry."""
    return max(1, min(6, len(notice) // 10))


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into allowed_errors + 1 pieces: (offset, piece)."""
    n = allowed_errors(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def _machine():
    import ahocorasick
    import regex

    automaton, wanted, patterns = ahocorasick.Automaton(), {}, []
    for label, notices in NOTICES.items():
        for notice in notices:
            k = allowed_errors(notice)
            patterns.append((label, notice, k, regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])")))
            for offset, piece in pieces(notice):
                wanted.setdefault(piece, []).append((len(patterns) - 1, offset))
    for piece, places in wanted.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, patterns


def normal_form(text: str | None) -> str:
    """The text's words, A-Z lower-cased, with one blank between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()).decode("utf-8", "replace")


def _at_word_ends(norm: str, start: int, end: int) -> bool:
    """Whether a span begins and ends where words do."""
    return (start == 0 or norm[start - 1] == " ") and (end == len(norm) or norm[end] == " ")


def fuzzy_spans(norm: str) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, errors, score) of notices in a normal form; start and end are its character positions.

    Every seed has a window of its own, the notice's length and its edits on both sides; the same window is looked at
    once. Of a notice's spans that overlap, the one with fewest errors stays, then the longest, then the first. A span
    begins and ends with a word.
    """
    automaton, patterns = _machine()
    windows: dict[int, set[int]] = {}
    for end, (size, places) in automaton.iter(norm):
        for which, offset in places:
            windows.setdefault(which, set()).add(end + 1 - size - offset)
    found = []
    for which, starts in windows.items():
        label, notice, k, pattern = patterns[which]
        spans, looked, last = {}, -1, None
        for start in sorted(starts):
            low = max(0, start - k)
            # the words that a window touches are looked at whole
            low, high = norm.rfind(" ", 0, low + 1) + 1 if low else 0, min(len(norm), start + len(notice) + k)
            high = len(norm) if (stop := norm.find(" ", high)) < 0 or stop > high + 2 * k else stop
            high = min(high, start + len(notice) + 4 * k)
            if (low, high) == last:
                continue
            last = low, high
            window = norm[low:high]
            if m := pattern.search(window):
                errors, at, to = sum(m.fuzzy_counts), low + m.start(), low + m.end()
                if _at_word_ends(norm, at, to):
                    spans[at, to] = min(errors, spans.get((at, to), errors))
        taken: list[tuple[int, int]] = []
        for (at, to), errors in sorted(spans.items(), key=lambda x: (x[0][0], x[0][1])):
            # spans come by start, so only the last one kept can overlap
            while taken and at < taken[-1][1]:
                if (spans[taken[-1]], taken[-1][0] - taken[-1][1]) <= (errors, at - to):
                    break
                taken.pop()
            else:
                taken.append((at, to))
        found += [(label, at, to, spans[at, to], 1 - spans[at, to] / len(notice)) for at, to in taken]
    return sorted(found)


@lru_cache(maxsize=1)
def _base_pattern():
    import regex

    phrases = "|".join(regex.escape(p, literal_spaces=True) for p in sorted(BASE, key=len, reverse=True))
    return regex.compile(f"(?<![^ ])(?:{phrases})(?![^ ])")


def base_hits(norm: str) -> tuple[int, int | None, int | None, list[str]]:
    """Places, first and last word index, and labels of the base phrases. Words are counted on from place to place."""
    n, first, last, labels, at, word = 0, None, None, set(), 0, 0
    for m in _base_pattern().finditer(norm, overlapped=True):
        word += norm.count(" ", at, m.start())
        at, n = m.start(), n + 1
        labels.add(BASE[m[0]])
        first, last = word if first is None else first, word
    return n, first, last, sorted(labels)


def scan_licenses(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, spans of fuzzy notices.

    Spans are character positions in the normal form (words with one blank between). Null and empty texts have no
    words, hits or spans; repeated rows give repeated results; an empty table gives no rows; texts are searched whole, in
    time proportional to their length. Equal spans of several labels are all reported. Other columns are not read.
    """
    kind = dict(frame.dtypes)[id_col]

    def scan(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                norm = normal_form(text)
                n, first, last, labels = base_hits(norm)
                spans = [dict(zip(("label", "start", "end", "errors", "score"), s)) for s in fuzzy_spans(norm)]
                rows.append((key, norm.count(" ") + 1 if norm else 0, n, first, last, labels, spans))
            out = pd.DataFrame(rows, columns=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"])
            yield out.astype({"id": batch["id"].dtype, "first_word": "Int64", "last_word": "Int64"})

    picked = frame.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return picked.mapInPandas(scan, f"id {kind}, {SCAN_SCHEMA}").withColumnRenamed("id", id_col)
