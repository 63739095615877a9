"""Answering contracts: gates, citations and an offline extractive stand-in for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def valid_citations(cited: Column, known: Column) -> Column:
    """Cited ids that are known, normalised, each once, in order."""
    plain = F.transform(cited, lambda c: F.upper(F.regexp_replace(c, r"[\[\]\s]", "")))
    return F.array_distinct(F.filter(plain, lambda c: F.array_contains(known, c)))


def abstain_reason(no_documents: Column, top_score: Column, reply_ok: Column, insufficient: Column, citations: Column, theta: float = 0.25) -> Column:
    """The first gate that stops an answer; null for none."""
    return (
        F.when(no_documents, "no_documents").when(F.coalesce(top_score, F.lit(0.0)) < theta, "low_score").when(~reply_ok, "bad_reply")
        .when(insufficient, "insufficient").when(F.size(citations) == 0, "no_valid_citations")
    )


def extractive_answer(question_terms: Column, text: Column) -> Column:
    """Offline stand-in for a model, not one: the sentence that shares most terms with the question, first on ties."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    scored = F.transform(
        sentences,
        lambda s, i: F.struct(F.size(F.array_intersect(question_terms, F.split(F.lower(s), r"[^a-z0-9]+"))).alias("shared"), (-i).alias("first"), s.alias("sentence")),
    )
    return F.array_max(scored)["sentence"]


def primary_citation(cited: DataFrame, query_col: str, terms_col: str, pos_col: str) -> DataFrame:
    """The citation with most highlight terms, the first on ties."""
    return cited.groupBy(query_col).agg(F.max(F.struct(F.size(terms_col).alias("n"), (-F.col(pos_col)).alias("first"))).alias("best")).select(
        query_col, (-F.col("best.first")).alias("primary"), F.col("best.n").alias("n_terms")
    )


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that holds, null where none does; a gate that is null does not hold."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in gates])


def reply_object(reply: Column) -> Column:
    """The text of a reply from its first `{` to its last `}`: fences and prose around an object go; null without one."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def checked_route(reply: Column, routes: tuple[str, ...] = ("DOCUMENT", "GENERAL", "MIXED")) -> Column:
    """Struct of route, confidence (held between 0 and 1) and problem (bad_json, unknown_route, else null) of a router's reply."""
    parsed = F.from_json(reply_object(reply), "route string, confidence string")
    route = F.upper(F.trim(parsed["route"]))
    known = F.coalesce(route.isin(*routes), F.lit(False))
    sure = F.least(F.greatest(F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    problem = F.when(route.isNull(), "bad_json").when(~known, "unknown_route")
    return F.struct(F.when(known, route).alias("route"), F.when(known, sure).alias("confidence"), problem.alias("problem"))


def accepted_rewrite(question: Column, rewrite: Column) -> Column:
    """Whether a rewrite may stand for a question: not empty, at most 500 characters and three times as long and 120, no new number."""
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    fits = (F.length(F.trim(rewrite)) > 0) & (F.length(rewrite) <= F.least(F.lit(500), 3 * F.length(question) + 120))
    return F.coalesce(fits & (F.size(F.array_except(digits(rewrite), digits(question))) == 0), F.lit(False))


def rewritten(question: Column, reply: Column) -> Column:
    """Struct of outcome and question after a rewriter's reply (null: the call failed): error, bad_json, unclear and rejected keep the original."""
    parsed = F.from_json(reply_object(reply), "clear boolean, question string")
    outcome = (
        F.when(reply.isNull(), "error").when(F.coalesce(parsed["clear"].isNull() | parsed["question"].isNull(), F.lit(True)), "bad_json")
        .when(~parsed["clear"], "unclear")
        .when(~accepted_rewrite(question, parsed["question"]), "rejected").otherwise("rewritten")
    )
    return F.struct(outcome.alias("outcome"), F.when(outcome == "rewritten", parsed["question"]).otherwise(question).alias("question"))
