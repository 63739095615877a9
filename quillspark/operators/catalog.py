"""The document catalog: names, periods, coverage and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = r"(?i)\b(?:([QH])\s?([1-4])\s*)?FY\s?(?:20)?(\d{2})(?:\s*[-/]\s*(?:20)?(\d{2}))?\b"


def period(text: Column) -> Column:
    """The first fiscal period of a text as FY26, Q1 FY26 or H1 FY26; null without one. A range counts by its end."""
    part = F.upper(F.concat(F.regexp_extract(text, PERIOD, 1), F.regexp_extract(text, PERIOD, 2)))
    end = F.regexp_extract(text, PERIOD, 4)
    year = F.when(end != "", end).otherwise(F.regexp_extract(text, PERIOD, 3))
    return F.when(year != "", F.trim(F.concat(part, F.lit(" FY"), year)))


# Spelt quarters.
QUARTERS = {"first": "Q1", "second": "Q2", "third": "Q3", "fourth": "Q4"}


def periods(text: Column) -> Column:
    """All fiscal periods of a text, in order, each once: Q1 FY26, H1 FY26, FY26. Spelt quarters count as written ones."""
    for word, quarter in QUARTERS.items():
        text = F.regexp_replace(text, rf"(?i)\b{word}\s+quarter(\s+of)?\b", quarter)
    whole, part, number, start, end = (F.regexp_extract_all(text, F.lit(PERIOD), F.lit(g)) for g in range(5))
    found = F.arrays_zip(whole.alias("w"), part.alias("p"), number.alias("n"), start.alias("s"), end.alias("e"))
    named = F.transform(found, lambda x: F.trim(F.concat(F.upper(x["p"]), x["n"], F.lit(" FY"), F.when(x["e"] != "", x["e"]).otherwise(x["s"]))))
    return F.array_distinct(named)


def fiscal_year(name: Column) -> Column:
    """The FY part of a period, null without one."""
    return F.nullif(F.regexp_extract(name, r"FY\d{2}", 0), F.lit(""))


def period_key(name: Column) -> Column:
    """Sort key: year, then quarter; halves sort with the quarter of their number, the full year last."""
    part = F.regexp_extract(name, r"^[QH](\d)", 1)
    return F.struct(F.regexp_extract(name, r"FY(\d{2})", 1).try_cast("int").alias("year"), F.when(part != "", part.try_cast("int")).otherwise(9).alias("part"), name.alias("name"))


def spellings(name: Column) -> Column:
    """How a fiscal year is also written: FY2026, FY 2025-26."""
    year = F.regexp_extract(name, r"FY(\d{2})", 1)
    before = F.lpad(F.pmod(year.try_cast("int") - 1, F.lit(100)).cast("string"), 2, "0")
    return F.when(year != "", F.array(F.concat(F.lit("FY20"), year), F.concat(F.lit("FY 20"), before, F.lit("-"), year)))


def companies(docs: DataFrame, company: Column, doc: Column, status: Column) -> DataFrame:
    """One row per company key (lower case, single blanks): its name, distinct spellings and documents; failed
    documents are left out."""
    key = F.lower(F.trim(F.regexp_replace(company, r"\s+", " ")))
    good = docs.where(status != "FAILED").select(key.alias("company_key"), company.alias("name"), doc.alias("doc"))
    return good.groupBy("company_key").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("name")).alias("terms"), F.count("doc").alias("n_docs"))


def coverage(docs: DataFrame, by: list[str], period_col: str) -> DataFrame:
    """Sorted distinct periods per group, oldest first."""
    keyed = docs.where(F.col(period_col).isNotNull()).select(*by, period_key(F.col(period_col)).alias("key")).distinct()
    return keyed.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("key")), lambda k: k["name"]).alias("periods"))


def period_matches(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents (period) that serve wanted periods: the same one, or a quarter of a wanted full year."""
    w = wanted.select(F.col("period").alias("wanted"), fiscal_year(F.col("period")).alias("fy"))
    d = docs.withColumn("fy", fiscal_year(F.col("period")))
    return d.join(w, "fy").where((F.col("period") == F.col("wanted")) | (F.col("wanted") == F.col("fy")))
