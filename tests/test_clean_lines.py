"""Cleaned lines against a plain version and cases by hand."""

import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from quillspark import catalogue
from quillspark.functions import text as X


def lines_of(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(X.clean_lines(F.col("t"))).collect()]


def test_folds_and_blanks(spark):
    assert lines_of(spark, "O\ufb00erings \u2460\n\n \t\u00a0\n\uff21\u3000b  c ", "", None) == [["Offerings 1", "A b c"], [], None]


def test_rupee_signs(spark):
    kept = ["`code`", "` word", "a ` b", "`12"]
    given = ["` 3,124.83", "`(5)", "in ` million", "` CRORE", "` in lakh", "Basic (in `)", "` millions"]
    want = ["₹ 3,124.83", "₹(5)", "in ₹ million", "₹ CRORE", "₹ in lakh", "Basic (in ₹)", "` millions"]
    assert lines_of(spark, *given) == [[w] for w in want]
    assert lines_of(spark, *kept) == [[k] for k in kept]


def test_every_document(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = catalogue.QUERIES["STR4_folded_lines"](spark, sf_dir).collect()
    assert len(found) == len(docs)
    for row in found:
        plain = [re.sub(r"\s+", " ", line).strip() for line in unicodedata.normalize("NFKC", docs[row["doc_id"]]).split("\n")]
        joined = "\n".join(line for line in plain if line)
        assert "`" not in joined and row["lines_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
