"""The keyword router on questions of every kind."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import router

NAMES = ["Acme Annual Report FY25.pdf"]
CASES = {
    "DOCUMENT": [
        "What was Acme's consolidated revenue from operations in FY2025?", "What was the revenue?", "How many employees did the company have at year end?",
        "Per the annual report, who chairs the audit committee?", "What does the report say about dividends?", "What was profit after tax in 2024?",
        "Which page lists the borrowings?", "What was revenue in FY2025, and what was profit in FY2025?", "What was Acme and Sons revenue in FY2025?", "Tell me about Acme",
        "Tell me what is on page 12", "Liabilities by segment", "how does the cash flow look", "IN THE FILING?", "What is revenue in FY 25",
    ],
    "GENERAL": [
        "What is EBITDA?", "What's revenue", "Define working capital", "Explain how depreciation works", "What is the capital of France?", "Who wrote Hamlet?",
        "Why is the sky blue?", "Tell me a joke", "", None, "?!", "how do subsidiaries work", "What are subsidiaries?", "who is who and what is what",
    ],
    "MIXED": [
        "What was Acme's profit before tax in FY2025, and what is the capital of France?", "Who wrote Pride and Prejudice, and what was Acme's revenue in FY2025?",
        "What was revenue in FY2025? Who is the Prime Minister of India?", "What was profit in FY2025; what is inflation?", "Profit of the company; define equity",
        "Revenue in 2024, and inflation is what?",
    ],
}


@pytest.mark.parametrize("route", sorted(CASES))
def test_routes(spark, route):
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(CASES[route])], "i int, q string")
    names = F.array(*[F.lit(n) for n in NAMES])
    got = frame.select("i", router.keyword_route(F.col("q"), names).alias("r")).collect()
    assert [(CASES[route][r["i"]], r["r"]) for r in got if r["r"] != route] == []


def test_names(spark):
    names = F.array(*[F.lit(n) for n in ("EIG AR FY25.pdf", "Q3_results-2024 final.pdf")])
    row = spark.range(1).select(router.name_words(names).alias("w"), router.keyword_route(F.lit("Tell me about Acme")).alias("r")).first()
    assert set(row["w"]) == {"eig", "results"} and row["r"] == "GENERAL"
