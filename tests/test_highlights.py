"""Highlight terms against cases by hand."""

from quillspark.operators.highlights import MOST_TERMS, highlight_terms


def terms_of(spark, answer, chunks, how=()):
    answers = spark.createDataFrame([(1, answer, list(how))], "id int, answer string, how array<string>")
    cited = spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], "id int, chunk int, text string")
    found = highlight_terms(answers, cited, "id", "answer", "chunk", "text", "how").collect()
    return [list(r["terms"]) for r in sorted(found, key=lambda r: r["chunk"])]


def test_figures_as_printed_in_the_chunk(spark):
    # the chunk's spelling counts, in the answer's order; a year, a mark and a two-digit number are no terms
    got = terms_of(spark, "In 2024 [S1] it was 1097.36, then 94.9 for 12 sites.", ["94.90 | 1,097.36 | 12 | 2024", "none here", None])
    assert got == [["1,097.36", "94.90"], [], []]


def test_a_derived_figure_gives_its_operands(spark):
    chunk = "Profit 1,097.36 and 615.30; rate 100"
    assert terms_of(spark, "It rose by 482.06.", [chunk], ["482.06 = 1097.36 − 615.30"]) == [["1,097.36", "615.30"]]
    assert terms_of(spark, "It rose by 78.3%.", [chunk], ["78.3 = (1097.36 − 615.30) / 615.30 × 100", "no derivation"]) == [["1,097.36", "615.30"]]


def test_each_term_once_and_a_bounded_number(spark):
    many = ", ".join(f"{n}.5" for n in range(200, 220))
    assert terms_of(spark, f"{many} and 200.50", [many]) == [[f"{n}.5" for n in range(200, 200 + MOST_TERMS)]]
    # the first printed form of a value stands for all
    assert terms_of(spark, "1,250.0 and 1250", ["1250.00 then 1,250"]) == [["1250.00"]]


def test_null_and_empty(spark):
    assert terms_of(spark, None, ["5,000", ""]) == [[], []]
    assert terms_of(spark, "", ["5,000"]) == [[]]
    assert terms_of(spark, "5,000", []) == []
