"""Recursive splitting: paragraphs, sentences, words, halves of words; only what is too long is split further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..tables import saved

#: Stands for a cut; texts that hold it are cut there, too.
_CUT = "\x01"


def _parts(level: int, text: Column) -> Column:
    """The parts of a text at a level: 0 paragraphs, 1 sentences, 2 words, then halves."""
    if level == 0:
        cut = F.split(text, r"\n\s*\n")
    elif level == 1:
        cut = F.split(F.regexp_replace(text, r"([.!?])\s+", f"$1{_CUT}"), _CUT)
    elif level == 2:
        cut = F.split(text, r"\s+")
    else:
        half = F.floor(F.length(text) / 2).cast("int")
        return F.array(F.left(text, half), F.substring(text, half + 1, F.length(text)))
    return F.filter(F.transform(cut, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def split_recursively(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, text, tokens): each document in pieces of at most `size` estimated tokens (a single character may have more),
    in order from 0. A part that fits is not split; of the others each round splits only those still too long, so a round has
    fewer rows than the one before reads, and word halves take as many rounds as the longest word needs. Null and blank texts
    give no piece; ids tell documents apart.
    """
    fits = F.col("tokens") <= size
    waiting = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("path"), F.col(text_col).alias("text"))
    done, level = [], 0
    while True:
        parts = waiting.select("id", "path", F.posexplode(_parts(level, F.col("text"))).alias("at", "text"))
        parts = saved(parts.select("id", F.array_append("path", F.col("at")).alias("path"), "text", token_estimate(F.col("text")).alias("tokens")))
        last = F.length("text") < 2
        done.append(parts.where(fits | last))
        waiting = parts.where(~fits & ~last).select("id", "path", "text")
        level += 1
        if not waiting.limit(1).count():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    place = F.row_number().over(Window.partitionBy("id").orderBy("path")) - 1
    return every.select(F.col("id").alias(id_col), place.cast("long").alias("piece"), "text", F.col("tokens").cast("long").alias("tokens"))
