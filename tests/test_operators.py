"""Operators on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions import figures, text
from quillspark.operators import answers, catalog, chunking, evaluation, metrics, retrieval


def column(spark, function, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_search_terms(spark):
    assert column(spark, text.search_terms, "The 31st of March, 1,467.25 units", "", None) == [["31", "march", "1,467.25", "units"], [], None]


def test_token_estimate(spark):
    assert column(spark, text.token_estimate, "short, extraordinarily", "") == [1 + 1 + 3, 0]
    assert chunking.estimate("short, extraordinarily") == 5


def test_snippet(spark):
    assert column(spark, lambda v: text.snippet(v, 6), "a  b", "abcd efgh") == ["a b", "abcd…"]


def test_bm25_scope_keeps_statistics(spark):
    chunks = spark.createDataFrame([("a", "red fish"), ("b", "red red bird"), ("c", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "red red")], "query_id int, query string")
    free = {r["chunk_id"]: r["score"] for r in retrieval.bm25(chunks, asked).collect()}
    scope = spark.createDataFrame([("a",)], "chunk_id string")
    held = {r["chunk_id"]: r["score"] for r in retrieval.bm25(chunks, asked, scope=scope).collect()}
    assert set(free) == {"a", "b"} and held == {"a": free["a"]}


def test_fit_context_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, i + 1, f"d{i}", "w " * n) for i, n in enumerate((8, 9, 2))], "q int, rank int, id string, text string")
    kept = retrieval.fit_context(rows, "q", "id", "text", 10).orderBy("rank").collect()
    assert [(r["id"], r["used_tokens"]) for r in kept] == [("d0", 10), ("d2", 10)]
    first = retrieval.fit_context(rows, "q", "id", "text", 1).collect()
    assert [r["id"] for r in first] == ["d0"]


def test_keep_lexical_top(spark):
    fused = spark.createDataFrame([(1, f"d{i}", 1.0, i) for i in range(1, 6)], "q int, id string, score double, rank int")
    lexical = spark.createDataFrame([(1, "d5", 1)], "q int, id string, rank int")
    moved = retrieval.keep_lexical_top(fused, lexical, 1, 2, "q", "id").orderBy("rank").collect()
    assert [r["id"] for r in moved] == ["d1", "d5", "d2", "d3", "d4"]


def test_cosine_of_zero(spark):
    row = spark.sql("select array(0f, 0f) a, array(1f, 0f) b").select(retrieval.cosine(F.col("a"), F.col("b"))).first()
    assert row[0] == 0.0


def test_ratio_of_empty_pool_is_null(spark):
    row = spark.range(3).agg(metrics.ratio(F.col("id") > 0, F.lit(False)), metrics.ratio(F.col("id") > 0, F.lit(True))).first()
    assert row[0] is None and row[1] == pytest.approx(2 / 3)


def test_mix_shift_is_null_after_a_gap(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 8, 22)]
    rows = spark.createDataFrame([(d, p) for d, p in zip(days, "aba")], "ts timestamp, part string")
    shifts = {str(r["week"]): r["shift"] for r in metrics.mix_shift(metrics.weekly_mix(rows, "ts", "part")).collect()}
    assert shifts == {"2024-01-01": None, "2024-01-08": 1.0, "2024-01-22": None}


def test_severity_ranks_questions_back(spark):
    rows = spark.createDataFrame([("answered",), ("unclear",)], "s string")
    assert rows.agg(metrics.worst_status(F.col("s"))).first()[0] == "unclear"


def test_indicator_limits_are_still_good(spark):
    row = spark.range(1).select(
        metrics.indicator("error_rate", F.lit(0.02), F.lit(9)), metrics.indicator("top_score", F.lit(0.4), F.lit(9)), metrics.indicator("error_rate", F.lit(0.9), F.lit(4))
    ).first()
    assert list(row) == ["green", "red", "grey"]


def test_figures(spark):
    assert column(spark, figures.figures, "1,25,630 and 1,2,3 or 12,563.5,") == [["1,25,630", "1", "2", "3", "12,563.5"]]
    answers_ = spark.createDataFrame([(1, "Sales rose 5.5% to 1,250 crore in FY26 on 31 March 2025; 3 units, 2024, [S1], 3rd.")], "id int, t string")
    got = {(str(r["mantissa"].normalize()), r["exponent"], r["is_percent"]) for r in figures.claims(answers_, "id", "t").collect()}
    assert got == {("5.5", 0, True), ("1.25E+3", 7, False)}


def test_what_is_no_quantity(spark):
    none = ["[S1]", "2024-25", "FY2024/25", "31 March 2025", "31st Dec., 2024", "March 31, 2025", "1. item", "FY 25", "FY25-26", "Q 3", "H1 FY26", "3 segments", "3rd", "in 2024", "A4", "2x"]
    some = {"We sold 12 markets 2025 units": "12", "a decline 12, 2024 figure": "12", "12 marks in all": "12", "rose 5 percent": "5", "7 lakh": "7", "Note 12.5": "12.5", "2024 crore": "2024"}
    rows = spark.createDataFrame([(t, t) for t in [*none, *some]], "id string, t string")
    got = {r["id"]: str(r["mantissa"].normalize() + 0) for r in figures.claims(rows, "id", "t").collect()}
    assert {k: float(v) for k, v in got.items()} == {k: float(v) for k, v in some.items()}


def test_number_check(spark):
    source = "Revenue 1,097.36 and 615.30 crore; profit 120, cost 80, margin 12.5%"
    cases = {
        "Revenue was 1,097.36": "pass", "Up by 482.06": "pass", "A share of 56.1%": "pass", "It grew 50%": "pass", "It fell 33.3 per cent": "pass",
        "Up by 482.07": "fail", "A share of 56.2%": "fail", "Nothing in FY25": "na", "6,153,000,000": "pass", "A rise of 33.3": "fail", "12.5 and 99": "fail",
    }
    asked = spark.createDataFrame([(k, k) for k in cases], "id string, text string")
    sources = asked.select("id", F.lit(source).alias("text"))
    assert {r["id"]: r["status"] for r in figures.number_check(asked, sources, "id").collect()} == cases
    many = asked.select("id", F.concat_ws(" ", F.sequence(F.lit(1000), F.lit(1800))).alias("text"))
    assert {r["status"] for r in figures.number_check(asked, many, "id").collect()} == {"fail", "na"}


def test_periods(spark):
    names = column(spark, catalog.period, "Q1 FY2026 report", "annual FY 2024-25", "h2 fy26", "2024-25", "none")
    assert names == ["Q1 FY26", "FY25", "H2 FY26", None, None]
    assert column(spark, catalog.spellings, "FY26")[0] == ["FY2026", "FY 2025-26"]


def test_split_text_keeps_everything():
    body = "First one. Second two.\n\n" + "x" * 400 + " end."
    pieces = chunking.split_text(body, 20, 4)
    assert all(chunking.estimate(p) <= 20 for p in pieces)
    assert "".join("".join(pieces).split()).count("x") >= 400
    assert chunking.split_text("", 20, 4) == [] and chunking.split_text(None, 20, 4) == []


def test_table_pieces_repeat_the_header():
    rows = [["a", "b|c"]] + [[str(i), "value"] for i in range(6)]
    pieces = chunking.table_pieces("T", rows, 40)
    assert len(pieces) > 1 and all(p.startswith("T\n| a | b\\|c |\n| --- | --- |") for p in pieces)


def test_anchored_rows_do_not_chain(spark):
    words = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 4.0)], "page int, y double")
    assert [r["row_no"] for r in chunking.anchored_rows(words, "page", "y").orderBy("y").collect()] == [1, 1, 2]


def test_best_threshold_takes_the_smallest(spark):
    rows = spark.createDataFrame([(1, False), (2, False), (3, True), (4, True)], "s int, p boolean")
    best = evaluation.best_threshold(rows, "s", "p").first()
    assert (best["tau"], best["accuracy"]) == (2.5, 1.0)


def test_kappa_is_null_where_chance_always_agrees(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert evaluation.agreement(rows, "a", "b").first()["kappa"] is None


def test_upsert_leaves_other_columns(spark):
    old = spark.createDataFrame([(1, "x", 5), (2, "y", None)], "k int, s string, f int")
    new = spark.createDataFrame([(1, "z"), (3, "n")], "k int, s string")
    rows = sinks.upserted(old, new, ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "z", 5), (2, "y", None), (3, "n", None)]


def test_flat_yaml_and_appended_records(spark, tmp_path):
    from quillspark.sources import files

    (tmp_path / "map.yaml").write_text("# names\nacme: Acme AR.pdf  # latest\n\nbeta: \"B: one #2.pdf\"\ngamma: 'g.pdf'\nnot a pair\n")
    found = {(r.key, r.filename) for r in files.flat_yaml(spark, str(tmp_path / "map.yaml")).collect()}
    assert found == {("acme", "Acme AR.pdf"), ("beta", "B: one #2.pdf"), ("gamma", "g.pdf")}

    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, note string")
    files.append_records(rows, path)
    spark.createDataFrame([('{"id": 3, "no',), ("",), ("garbage",)], "value string").write.mode("append").text(path)
    files.append_records(rows.limit(0), path)
    assert {tuple(r) for r in files.whole_records(spark, path, "id long, note string").collect()} == {(1, "a"), (2, None)}


def test_replies_are_checked(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import answers as A

    routes = spark.createDataFrame([(0, '{"route": "mixed"}'), (1, "[]"), (2, None), (3, 'x {"route": "NO", "confidence": 1} y')], "id int, r string")
    assert [tuple(r.c) for r in routes.orderBy("id").select(A.checked_route(F.col("r")).alias("c")).collect()] == [
        ("MIXED", 0.0, None), (None, None, "bad_json"), (None, None, "bad_json"), (None, None, "unknown_route"),
    ]
    cases = [
        (0, "sales of 5", None, "error"), (1, "sales of 5", "none", "bad_json"), (2, "sales of 5", '{"clear": true}', "bad_json"),
        (3, "sales of 5", '{"clear": false, "question": "x"}', "unclear"), (4, "sales of 5", '{"clear": true, "question": "sales of 6"}', "rejected"),
        (5, "sales of 5", '{"clear": true, "question": " "}', "rejected"), (6, "sales of 5", '{"clear": true, "question": "the sales of 5"}', "rewritten"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "id int, q string, r string").orderBy("id")
    got = [tuple(r.c) for r in rows.select(A.rewritten(F.col("q"), F.col("r")).alias("c")).collect()]
    assert [g[0] for g in got] == [c[3] for c in cases]
    assert got[-1][1] == "the sales of 5" and all(g[1] == "sales of 5" for g in got[:-1])
