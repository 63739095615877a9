"""Queries that clean lines and mark an answer's figures in what it cites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.answers import primary_citation
from ..operators.highlights import highlight_terms
from ..session import table
from .registry import query

# An answer about each order: its number, its dearest line and what lies between; the least price is only an operand. A chunk
# is what an order's lines of one number say.
_TERMS_SQL = r"""
lines AS (SELECT l_orderkey AS k, l_linenumber AS line, min(CAST(l_extendedprice AS DECIMAL(18, 2))) AS a, max(CAST(l_extendedprice AS DECIMAL(18, 2))) AS b FROM lineitem GROUP BY ALL),
ends AS (SELECT k, min(a) AS lo, max(b) AS hi FROM lines GROUP BY k),
said AS (SELECT k, line, a, b, [CASE WHEN k < 10 OR k BETWEEN 1900 AND 2100 THEN NULL ELSE CAST(k AS DECIMAL(18, 2)) END, hi, hi - lo, lo] AS vs FROM lines JOIN ends USING (k)),
forms AS (SELECT k, line, list_transform(vs, lambda v: CASE WHEN v = k THEN CASE WHEN k >= 100 THEN CAST(k AS VARCHAR) END
  WHEN v = a THEN format('{:,.2f}', CAST(a AS DOUBLE)) WHEN v = b THEN format('{:,.2f}', CAST(b AS DOUBLE)) END) AS fs FROM said),
terms AS (SELECT k, line, list_filter(fs, lambda f, i: f IS NOT NULL AND list_position(fs, f) = i) AS terms FROM forms)
"""


def _highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(price).alias("a"), F.max(price).alias("b"), F.count("*").alias("n"))
    shown = lambda c: F.format_number(c, 2)
    chunk = F.concat(
        F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(", line "), F.col("l_linenumber").cast("string"), F.lit(": "), F.col("n").cast("string"),
        F.lit(" prices between "), shown("a"), F.lit(" and "), shown("b"), F.lit("."),
    )
    cited = lines.select("l_orderkey", "l_linenumber", chunk.alias("chunk"))
    ends = lines.groupBy("l_orderkey").agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    between = shown(F.col("hi") - F.col("lo"))
    answer = F.concat(F.lit("By 31 March 2025 order "), F.col("l_orderkey").cast("string"), F.lit(" cost up to "), shown("hi"), F.lit(", "), between, F.lit(" above its least [S1]."))
    how = F.array(F.concat(between, F.lit(" = "), shown("hi"), F.lit(" − "), shown("lo")))
    return highlight_terms(ends.select("l_orderkey", answer.alias("answer"), how.alias("how")), cited, "l_orderkey", "answer", "l_linenumber", "chunk", "how")


@query("STR14_answer_highlights", f"WITH {_TERMS_SQL} SELECT k AS l_orderkey, line AS l_linenumber, array_to_string(terms, ' | ') AS terms FROM terms")
def answer_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR14: the figures of an answer about each order, as each cited chunk prints them."""
    return _highlighted(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join("terms", " | ").alias("terms"))


@query(
    "WIN16_cited_primary",
    f"WITH {_TERMS_SQL} SELECT k AS l_orderkey, CAST(arg_min(line, (-len(terms), line)) AS INTEGER) AS primary_line, CAST(max(len(terms)) AS INTEGER) AS n_terms FROM terms GROUP BY k HAVING max(len(terms)) > 0",
)
def cited_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN16: the citation with most highlight terms, the first on ties; an answer without any has none."""
    best = primary_citation(_highlighted(spark, sf_dir), "l_orderkey", "terms", "l_linenumber").where("n_terms > 0")
    return best.select("l_orderkey", F.col("primary").alias("primary_line"), "n_terms")


@query("STR4_folded_lines")
def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: every document's lines, folded and cleaned: how many there are, their letters, and a hash of all of them.

    DuckDB has no NFKC; a test compares all documents with a plain version.
    """
    lines = X.clean_lines(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    joined = F.array_join("lines", "\n")
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.length(joined).alias("n_letters"), F.sha2(joined, 256).alias("lines_sha256"))
