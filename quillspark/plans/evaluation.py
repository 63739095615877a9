"""Evaluation queries: labels stand for verdicts, conversations for run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..session import table
from .registry import query

_V = "v AS (SELECT d.doc_id, d.lang AS slice, quality, toxic, n_chars FROM documents d LEFT JOIN labels l USING (doc_id))"
_ROUTED = """t AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'DOCUMENT' WHEN length(text) % 3 = 1 THEN 'GENERAL' ELSE 'MIXED' END AS true_route,
CASE WHEN role = 'system' THEN 'OTHER' WHEN length(text) % 5 = 0 THEN 'MIXED' WHEN length(text) % 3 = 0 THEN 'DOCUMENT' ELSE 'GENERAL' END AS pred FROM conversations)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("slice"), "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(size % 3 == 0, "DOCUMENT").when(size % 3 == 1, "GENERAL").otherwise("MIXED").alias("true_route"),
        F.when(F.col("role") == "system", "OTHER").when(size % 5 == 0, "MIXED").when(size % 3 == 0, "DOCUMENT").otherwise("GENERAL").alias("pred"),
    )


@query(
    "AGG24_answer_block",
    f"""WITH {_V} SELECT slice, count(*) AS n, count(quality) AS judged, count(*) - count(quality) AS unjudged, count(*) FILTER (quality = 1) * 1.0 / nullif(count(quality), 0) AS accuracy,
count(*) FILTER (quality = 1 AND toxic = 0) * 1.0 / nullif(count(*) FILTER (toxic = 0), 0) AS accuracy_when_answered, count(*) FILTER (toxic = 1) * 1.0 / nullif(count(toxic), 0) AS grounded FROM v GROUP BY ROLLUP (slice)""",
)
def answer_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24 AGG18 AGG26: answer quality overall and per slice, unknown verdicts on neither side."""
    good, answered = F.col("quality") == 1, F.col("toxic") == 0
    return verdicts(spark, sf_dir).rollup("slice").agg(
        F.count("*").alias("n"), F.count("quality").alias("judged"), (F.count("*") - F.count("quality")).alias("unjudged"), E.share(good).alias("accuracy"),
        E.ratio(good, answered).alias("accuracy_when_answered"), E.share(F.col("toxic") == 1).alias("grounded"),
    )


@query(
    "AGG25_abstention_block",
    f"""WITH {_V}, o AS (SELECT slice, quality = 0 AS should, toxic = 1 AS did FROM v WHERE quality IS NOT NULL)
SELECT slice, count(*) FILTER (did AND should) * 1.0 / nullif(count(*) FILTER (should), 0) AS recall, count(*) FILTER (NOT did AND should) * 1.0 / nullif(count(*) FILTER (should), 0) AS false_answer,
count(*) FILTER (did AND should) * 1.0 / nullif(count(*) FILTER (did), 0) AS abstention_precision, count(*) FILTER (did AND NOT should) * 1.0 / nullif(count(*) FILTER (NOT should), 0) AS wrong_abstention FROM o GROUP BY slice""",
)
def abstention_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25 FLT17: abstention against what should have been refused."""
    should, did = F.col("quality") == 0, F.col("toxic") == 1
    return verdicts(spark, sf_dir).where("quality is not null").groupBy("slice").agg(
        E.ratio(did & should, should).alias("recall"), E.ratio(~did & should, should).alias("false_answer"),
        E.ratio(did & should, did).alias("abstention_precision"), E.ratio(did & ~should, ~should).alias("wrong_abstention"),
    )


@query(
    "AGG22_kappa",
    "WITH a AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS agreement, avg(quality) AS pa, avg(toxic) AS pb FROM labels) SELECT n, round(agreement, 6) AS agreement, round((agreement - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM a",
)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22 AGG29 JN14: agreement of two verdicts."""
    return E.agreement(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(
    "AGG19_confusion",
    f"""WITH {_ROUTED}, l AS (SELECT unnest(['DOCUMENT', 'GENERAL', 'MIXED']) AS true_route)
SELECT true_route, count(*) FILTER (pred = 'DOCUMENT') AS "DOCUMENT", count(*) FILTER (pred = 'GENERAL') AS "GENERAL", count(*) FILTER (pred = 'MIXED') AS "MIXED" FROM l LEFT JOIN t USING (true_route) GROUP BY 1""",
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: confusion matrix with zero cells."""
    return E.confusion(routed(spark, sf_dir), "true_route", "pred")


@query(
    "AGG20_route_summary",
    f"""WITH {_ROUTED} SELECT true_route, count(*) AS n, avg(CASE WHEN pred = true_route THEN 1.0 ELSE 0.0 END) AS recall,
count(*) FILTER (pred = true_route AND true_route <> 'MIXED') * 1.0 / nullif(count(*) FILTER (true_route <> 'MIXED'), 0) AS plain_accuracy FROM t GROUP BY ROLLUP (true_route)""",
)
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20 AGG38: accuracy (overall row), recall per class, accuracy without MIXED."""
    right, plain = F.col("pred") == F.col("true_route"), F.col("true_route") != "MIXED"
    return routed(spark, sf_dir).withColumn("plain", plain).withColumn("right", right).rollup("true_route").agg(
        F.count("*").alias("n"), E.ratio(F.col("right"), F.lit(True)).alias("recall"), E.ratio(F.col("right"), F.col("plain")).alias("plain_accuracy")
    )


@query(
    "AGG21_best_threshold",
    """WITH s AS (SELECT n_chars % 1000 AS score, toxic = 1 AS pos FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, lag(score) OVER (ORDER BY score) AS lower FROM (SELECT DISTINCT score FROM s)),
c AS (SELECT coalesce((score + lower) / 2.0, score) AS tau FROM g), a AS (SELECT tau, avg(CASE WHEN (score >= tau) = pos THEN 1.0 ELSE 0.0 END) AS accuracy FROM c, s GROUP BY tau)
SELECT CAST(tau AS DOUBLE) AS tau, round(accuracy, 6) AS accuracy FROM a ORDER BY round(accuracy, 9) DESC, tau LIMIT 1""",
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21: the best threshold on a score."""
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    best = E.best_threshold(scored.select((F.col("n_chars") % 1000).alias("score"), (F.col("toxic") == 1).alias("pos")), "score", "pos")
    return best.select(F.col("tau").cast("double").alias("tau"), F.round("accuracy", 6).alias("accuracy"))


@query("WIN8_last_record", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8 SRC7: the last record of each id."""
    return E.last_per(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("FLT9_duplicate_texts", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT9 SRC4: documents whose content came earlier."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return E.duplicates(hashed, "sha", "doc_id").select("doc_id")


@query("SRC3_content_hash", "SELECT doc_id, left(sha256(text), 16) AS id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3 HSH1: content hashes and sizes."""
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.left(sha, F.lit(16)).alias("id"), sha.alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "FLT8_validation",
    """SELECT item_id, array_to_string(list_filter([CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN length(text) > 200 THEN 'long' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END], lambda x: x IS NOT NULL), ',') AS problems FROM benchmark""",
)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT8 FLT13 SRC8: rule violations of question rows."""
    size = F.length("text")
    rules = F.array_compact(F.array(
        F.when(F.length(F.trim("text")) == 0, "empty"), F.when(size > 200, "long"), F.when(F.contains("text", F.lit("\n")), "lines")
    ))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(rules, ",").alias("problems"))


@query("AGG44_set_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG44: counts by each field, and all."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupingSets([[], [docs.lang], [docs.source]], docs.lang, docs.source).agg(F.count("*").alias("n"))


@query("JN9_missing_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9 FLT12: documents without a verdict."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    "JN6_page_hits",
    """WITH g AS (SELECT vec_id, label AS doc, vec_id AS page FROM embeddings WHERE vec_id % 20 = 0)
SELECT g.vec_id, count(e.vec_id) AS strict_and_near FROM g LEFT JOIN embeddings e ON e.label = g.doc AND abs(e.vec_id - g.page) <= 5 GROUP BY g.vec_id""",
)
def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6 AGG23: pages of the same document within a tolerance, misses kept."""
    pages = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("page"))
    gold = pages.where("page % 20 = 0").select(F.col("doc").alias("g_doc"), F.col("page").alias("g_page"), F.floor(F.col("page") / 5).alias("b"))
    # a band join as an equi-join on neighbouring bands of the tolerance's width
    banded = gold.withColumn("band", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    met = banded.join(pages.withColumn("band", F.floor(F.col("page") / 5)), "band", "left")
    near = (F.col("doc") == F.col("g_doc")) & (F.abs(F.col("page") - F.col("g_page")) <= 5)
    return met.groupBy(F.col("g_page").alias("vec_id")).agg(F.count_if(near).alias("strict_and_near"))


@query(
    "LLM7_calibration_sample",
    "SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY md5('7' || doc_id), doc_id) <= 20",
)
def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM7: a stratified sample, 20 right and 20 wrong (a sampling operator)."""
    from pyspark.sql import Window

    order = Window.partitionBy("quality").orderBy(F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, sf_dir, "labels").withColumn("r", F.row_number().over(order)).where("r <= 20").select("doc_id", "quality")


@query(
    "SET5_changed_settings",
    "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.role AS before, b.role AS after FROM (SELECT * FROM conversations WHERE turn = 0) a FULL JOIN (SELECT * FROM conversations WHERE turn = 1) b ON a.conv_id = b.conv_id WHERE a.role IS DISTINCT FROM b.role",
)
def changed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5: keys whose value differs between two maps, null-safe."""
    rows = table(spark, sf_dir, "conversations")
    a = rows.where("turn = 0").select("conv_id", F.col("role").alias("before"))
    b = rows.where("turn = 1").select("conv_id", F.col("role").alias("after"))
    return a.join(b, "conv_id", "full").where(~F.col("before").eqNullSafe(F.col("after")))


@query(
    "SNK6_flat_metrics",
    "WITH a AS (SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang) SELECT 'documents.' || lang || '.n' AS metric, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT 'documents.' || lang || '.chars', CAST(chars AS DOUBLE) FROM a",
)
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: a nested report as (metric, value) rows."""
    block = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.sum("n_chars").cast("double").alias("chars"))
    long = block.unpivot(["lang"], ["n", "chars"], "name", "value")
    return long.select(F.concat_ws(".", F.lit("documents"), "lang", "name").alias("metric"), "value")
