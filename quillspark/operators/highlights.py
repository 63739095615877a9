"""Which figures of an answer to mark in the texts it cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import figures as N

#: Terms of a citation at most, letters of a term at most, digits of a bare whole number at least.
MOST_TERMS, LONGEST_TERM, LEAST_DIGITS = 12, 32, 3


def answer_values(answers: DataFrame, id_col: str, text_col: str, how_col: str | None = None) -> DataFrame:
    """(id, turn, value): an answer's claimed figures in its order, each value once, then the operands of its derivations.

    `how_col` is an array of derivations such as `482.06 = 1,097.36 − 615.30`; operands stand right of the first `=`, and
    a closing `× 100` is none.
    """
    said = N.quantities(answers, id_col, text_col, True, placed=True)
    turns = said.select(id_col, F.struct(F.lit(0).alias("kind"), "at", "n").alias("turn"), F.col("mantissa").alias("value"))
    if how_col is not None:
        hows = answers.select(id_col, F.posexplode(how_col).alias("at", "how")).where(F.instr("how", "=") > 0)
        right = F.replace(F.expr("substring(how, instr(how, '=') + 1)"), F.lit("× 100"), F.lit(""))
        operands = hows.select(id_col, "at", F.posexplode(N.figures(right)).alias("n", "token"))
        turns = turns.union(operands.select(id_col, F.struct(F.lit(1).alias("kind"), "at", "n"), N.parsed(F.col("token")))).where("value is not null")
    return turns.groupBy(id_col, "value").agg(F.min("turn").alias("turn"))


def highlight_terms(answers: DataFrame, cited: DataFrame, id_col: str, text_col: str, chunk_col: str, chunk_text: str, how_col: str | None = None) -> DataFrame:
    """(id, chunk, terms): for each cited chunk of an answer, the answer's figures as that chunk prints them first.

    A figure that is derived, not printed, gives its operands. Bare whole numbers of fewer than LEAST_DIGITS digits are
    none; at most MOST_TERMS terms, in the answer's order. A chunk without any, or with a null text, has an empty array; an answer that is
    null claims nothing. Chunks are told apart by id and chunk. Figures meet by an equi-join on id and value, so
    neither an answer of many citations nor a chunk of many figures is compared pair by pair.
    """
    printed = cited.select(id_col, chunk_col, F.posexplode(N.figures(F.col(chunk_text))).alias("place", "term")).withColumn("value", N.parsed(F.col("term")))
    fits = (F.length("term") <= LONGEST_TERM) & ~(F.col("term").rlike(r"^\d+$") & (F.length("term") < LEAST_DIGITS))
    forms = printed.where("value is not null").groupBy(id_col, chunk_col, "value").agg(F.min_by("term", "place").alias("term")).where(fits)
    met = forms.join(answer_values(answers, id_col, text_col, how_col), [id_col, "value"])
    held = met.groupBy(id_col, chunk_col).agg(F.sort_array(F.collect_list(F.struct("turn", "term"))).alias("held"))
    terms = F.coalesce(F.slice(F.col("held.term"), 1, MOST_TERMS), F.array().cast("array<string>"))
    return cited.select(id_col, chunk_col).distinct().join(held, [id_col, chunk_col], "left").select(id_col, chunk_col, terms.alias("terms"))
