"""A keyword router: which questions, or parts of one, are about documents.

A question becomes tokens (words and the marks ? ; ,). Parts begin where a mark ends a question, or where a conjunction is
followed by a question word, or after a comma by a subject and an auxiliary. Every run of up to MOST tokens of a part is looked
up in one vocabulary of kinds; each kind that is there adds its weight once, and a positive sum is about a document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tells that a document is meant, what reports write about, openings that ask for a meaning, words that begin a
# question, auxiliaries, and words of file names that tell nothing. A star stands for any ending.
VOCABULARY = {
    "document": (
        "according to, annual report, as per, in the document, in the filing, in the pdf, in the report, per the, the company, the document, the pdf, "
        "the report, this document, this report, uploaded"
    ).split(", "),
    "topic": (
        "assets, auditor, auditors, board, borrowing, borrowings, capacity, capex, cash flow, committee, depreciation, director, directors, dividend, ebit, "
        "ebitda, employee, employees, eps, equity, expense, expenses, headcount, income, liabilit*, loss, margin, plant, plants, profit, revenue, sales, "
        "segment, share, shareholder, shareholders, shares, subsidiar*, tax, turnover"
    ).split(", "),
    "meaning": (
        "define, explain, meaning of, what are, what do, what does, what is, what's, when did, when was, where is, who discovered, who invented, who is, "
        "who was, who wrote"
    ).split(", "),
}
ASKING = "how what when where which who why".split()
AUXILIARIES = "are did do does had has have is was were".split()
UNTELLING = "and annual ar copy doc document final for of pdf report the".split()
#: A kind's weight, where a meaning counts at a part's beginning only; a period or a name of a document counts as `document`.
WEIGHTS = {"document": 4, "topic": 1, "meaning": -2}
#: Tokens of the longest entry.
MOST = 3


def tokens(question: Column) -> Column:
    """Words, lower-cased (possessives without their ending), and the marks that may part questions."""
    found = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"what's\b|'s\b|[a-z0-9]+(?:'(?!s\b)[a-z]+)?|[?;,]"), F.lit(0))
    return F.filter(found, lambda t: t != "'s")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: an expression inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts(question: Column) -> Column:
    """The parts of a question, as arrays of words without marks."""

    def begins(held: Column, i: Column) -> Column:
        here, last, after = F.get(held, i), F.get(held, i - 1), F.get(held, i + 1)
        joined = (here == "and") & (after.isin(ASKING) | ((last == ",") & F.get(held, i + 2).isin(AUXILIARIES)))
        return (i == 0) | last.isin("?", ";") | F.coalesce(joined, F.lit(False))

    def cut(held: Column, starts: Column) -> Column:
        some = F.transform(starts, lambda s, k: F.slice(held, s + 1, F.coalesce(F.get(starts, k + 1), F.size(held)) - s))
        words = F.transform(some, lambda part: F.filter(part, lambda t, i: ~t.isin("?", ";", ",") & ~((i == 0) & (t == "and"))))
        return F.filter(words, lambda part: F.size(part) > 0)

    def starts(held: Column) -> Column:
        every = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: begins(held, i))

    return _let(tokens(question), lambda held: _let(starts(held), lambda at: cut(held, at)))


def _runs(words: Column, most: int = MOST) -> Column:
    """All runs of 1 to `most` words, joined by blanks."""

    def of(size: int) -> Column:
        return F.transform(words, lambda w, i: F.when(i + size <= F.size(words), F.array_join(F.slice(words, i + 1, size), " ")).otherwise(""))

    return F.concat(*[of(size) for size in range(1, most + 1)])


def _holds(runs: Column, entries: list[str]) -> Column:
    whole = F.arrays_overlap(runs, F.array(*[F.lit(e) for e in entries if e[-1] != "*"]))
    stems = "|".join(e[:-1] for e in entries if e[-1] == "*")
    return whole | F.exists(runs, lambda r: r.rlike(f"^(?:{stems})")) if stems else whole


def weight(words: Column, names: Column) -> Column:
    """The sum of the kinds that the words of a part hold; `names` are words of file names."""

    def total(runs: Column) -> Column:
        period = F.exists(runs, lambda r: r.rlike(r"^(fy ?\d{2,4}|(19|20)\d\d|page \d+)$"))
        first = F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (1, 2)])
        works = (F.get(words, F.lit(0)) == "how") & F.get(words, F.lit(1)).isin("do", "does") & F.array_contains(words, "work")
        kinds = {
            "document": _holds(runs, VOCABULARY["document"]) | period | F.arrays_overlap(words, names), "topic": _holds(runs, VOCABULARY["topic"]),
            "meaning": _holds(first, VOCABULARY["meaning"]) | F.coalesce(works, F.lit(False)),
        }
        return sum((F.when(F.coalesce(holds, F.lit(False)), WEIGHTS[kind]).otherwise(0) for kind, holds in kinds.items()), F.lit(0))

    return _let(_runs(words), total)


def name_words(names: Column) -> Column:
    """Words of file names (an array) that tell documents apart: three letters at least, no number, period or common word."""
    words = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(F.lower(n), F.lit("[a-z0-9]+"), F.lit(0))))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^(fy)?\d*$") & ~w.isin(UNTELLING)))


def keyword_route(question: Column, names: Column | None = None) -> Column:
    """MIXED where some parts of a question are about a document and some are not, DOCUMENT where the whole is about one, else
    GENERAL. `names` is an array of file names; a null question is GENERAL."""
    words = name_words(names) if names is not None else F.array().cast("array<string>")

    def decide(known: Column) -> Column:
        about = F.transform(parts(question), lambda part: weight(part, known) > 0)
        whole = _let(F.filter(tokens(question), lambda t: ~t.isin("?", ";", ",")), lambda held: weight(held, known)) > 0
        mixed = _let(about, lambda a: F.array_contains(a, True) & F.array_contains(a, False))
        return F.when(mixed, "MIXED").when(whole, "DOCUMENT").otherwise("GENERAL")

    return _let(words, decide)


def score_route(score: Column, threshold: float) -> Column:
    """DOCUMENT where the best hit of a question scores at least `threshold`; no hit is GENERAL. It cannot tell parts."""
    return F.when(F.coalesce(score, F.lit(0.0)) >= threshold, "DOCUMENT").otherwise("GENERAL")
