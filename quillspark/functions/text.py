"""Text functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that keyword search leaves out.
STOP_WORDS = (
    "the of and in to a for was what is were per on by as at an or its it this that with from basis"
).split()


def search_terms(text: Column) -> Column:
    """Lower-cased word and number terms; ordinals fold to their number, stop words go. Null gives null."""
    folded = F.regexp_replace(F.lower(text), r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    found = F.regexp_extract_all(folded, F.lit(r"[a-z0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    return F.filter(found, lambda term: ~term.isin(STOP_WORDS))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: a mark or a word of up to 6 letters counts 1, a longer word one for each 5 letters begun."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    return F.aggregate(
        runs, F.lit(0), lambda total, run: total + F.when(F.length(run) <= 6, 1).otherwise(F.ceil(F.length(run) / 5)).cast("int")
    )


def collapsed(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Words of amounts before which a backtick stands for a rupee sign.
RUPEE_UNITS = ("million", "crore", "lakh", "billion", "thousand")
#: A backtick before a single digit (of `3,124`, too), an opened amount, a word of amounts or "in", or between "in" and ")".
_RUPEE = "(?iU)" + "|".join([
    rf"`(?=\s?(?:\d(?!\w)|\((?=\w)|(?:{'|'.join(RUPEE_UNITS)})(?!\w)))",
    r"`(?=\sin(?!\w))",
    r"(?<=\bin\s)`(?=\))",
])


def rupee_signs(text: Column) -> Column:
    """Backticks that a font has put for a rupee sign as that sign; others stay."""
    return F.regexp_replace(text, _RUPEE, "₹")


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def clean_lines(text: Column) -> Column:
    """A text's lines without empty ones: compatibility forms folded (NFKC, which Spark has no function for; Arrow batches), white
    space collapsed, rupee signs restored. Null gives null."""
    lines = F.transform(F.split(_compatible(text), "\n"), lambda line: rupee_signs(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), "^ | $", "")))
    return F.filter(lines, lambda line: line != "")


def line_key(line: Column) -> Column:
    """What repeated page edges share: lower case, digits as '#', single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"\s+", " "))


def snippet(text: Column, width: int) -> Column:
    """The collapsed text, cut to `width` characters with an ellipsis as the last."""
    flat = collapsed(text)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(width - 1))), F.lit("…")))


def table_key(text: Column) -> Column:
    """Title and header row of a table piece, empty where the text is no table."""
    return F.when(F.instr(text, "| --- |") > 0, F.trim(F.substring_index(text, "| --- |", 1))).otherwise("")


def escaped(text: Column) -> Column:
    """HTML-escaped text."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def markdown_row(cells: Column) -> Column:
    """Cells as a Markdown table row, with '|' escaped."""
    safe = F.transform(cells, lambda cell: F.replace(cell, F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def file_title(name: Column) -> Column:
    """A file name's stem with underscores and blanks as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[_\s]+", " "))


def acronym(name: Column, suffixes: tuple[str, ...] = ("limited", "ltd", "plc", "inc", "corporation", "corp", "company", "co")) -> Column:
    """First letters of a company name's words, legal suffixes left out."""
    words = F.filter(F.split(F.lower(name), r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*suffixes))
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
