"""Ingestion, chunking, routing and answering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapsed, search_terms
from ..operators import answers as A
from ..operators import chunking as K
from ..operators import router as Q
from ..operators.scan_search import scan
from ..session import table
from ..tables import shared_dir
from ..operators import search_index as S
from ..streaming import ingest as I
from .registry import query
from .retrieval import BM25_SQL, kept, terms_sql


@query("UDTF1_chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10 STR3 UDTF1: all documents in chunks of at most 400 estimated tokens with overlap."""
    return K.chunk_pages(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SRC1_html_pages")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: page records from HTML, in place of PDF pages."""
    text = K.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("filename"), text.alias("text"), F.lit("text").alias("source_kind"))


@query(
    "SRC2_page_checks",
    "SELECT page_id, CASE WHEN html IS NULL OR length(html) = 0 THEN 'empty' WHEN NOT contains(lower(left(html, 1024)), '<html') THEN 'no_html' WHEN length(html) > 5000 THEN 'too_long' ELSE 'ok' END AS verdict FROM pages",
)
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: sniffing and limits."""
    html = F.col("html")
    verdict = (
        F.when(html.isNull() | (F.length(html) == 0), "empty").when(~F.contains(F.lower(F.left(html, F.lit(1024))), F.lit("<html")), "no_html")
        .when(F.length(html) > 5000, "too_long").otherwise("ok")
    )
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


@query("SRC5_ready_documents", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars > 100")
def ready_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5 FLT1 FLT16: table scan with pushed predicates."""
    return table(spark, sf_dir, "documents").where("lang in ('de', 'fr') and n_chars > 100").select("doc_id", "lang", "n_chars")


@query(
    "FLT1_searched_split",
    "SELECT source, count(*) FILTER (doc_id % 5 <> 0) AS searched, count(*) FILTER (doc_id % 5 = 0) AS not_ready FROM documents GROUP BY source",
)
def searched_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 STM6: documents that a search covers and those not ready, per source."""
    status = F.when(F.col("doc_id") % 5 == 0, "QUEUED").otherwise("READY")
    ready = status.isin("READY", "PARTIAL")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(ready).alias("searched"), F.count_if(~ready).alias("not_ready"))


@query(
    "FLT3_scanned_pages", "SELECT doc_id, n_chars < 120 AND (doc_id % 10) / 10.0 >= 0.6 AS scanned FROM documents",
)
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3: pages with little text and much image."""
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") < 120) & (F.col("doc_id") % 10 / 10.0 >= 0.6)).alias("scanned"))


def _any(entries: list[str]) -> str:
    return "|".join(e[:-1] + "[a-z0-9]*" if e[-1] == "*" else e for e in entries).replace("'", "''")


# The router by regular expressions: parts are cut at a mark, which stands in for a look-ahead.
_ABOUT = (
    r"CASE WHEN regexp_matches(c, '\b(?:fy ?[0-9]{2,4}|(?:19|20)[0-9][0-9]|page [0-9]+|DOCUMENT)\b') THEN TRUE "
    r"WHEN regexp_matches(c, '^[^a-z0-9]*(?:and )?(?:MEANING)\b') OR regexp_matches(c, '^[^a-z0-9]*(?:and )?how (?:do|does) .*\bwork\b') THEN FALSE "
    r"ELSE regexp_matches(c, '\b(?:TOPIC)\b') END"
).replace("DOCUMENT", _any(Q.VOCABULARY["document"])).replace("MEANING", _any(Q.VOCABULARY["meaning"])).replace("TOPIC", _any(Q.VOCABULARY["topic"]))
_PARTS = (
    r"string_split(regexp_replace(regexp_replace(regexp_replace(low, '[?;]', chr(1), 'g'), ',\s*and (\w+ (?:VERBS)\b)', chr(1) || '\1', 'g'), "
    r"'\band ((?:ASKING)\b)', chr(1) || '\1', 'g'), chr(1))"
).replace("VERBS", "|".join(Q.AUXILIARIES)).replace("ASKING", "|".join(Q.ASKING))
ROUTED_SQL = f"""
low AS (SELECT id, lower(coalesce(question, '')) AS low FROM asked),
part AS (SELECT id, unnest(list_filter({_PARTS}, lambda c: regexp_matches(c, '[a-z0-9]'))) AS c FROM low),
kinds AS (SELECT id, count(DISTINCT {_ABOUT}) AS n FROM part GROUP BY id),
whole AS (SELECT id, {_ABOUT} AS about FROM (SELECT id, low AS c FROM low)),
routed AS (SELECT id, CASE WHEN n = 2 THEN 'MIXED' WHEN about THEN 'DOCUMENT' ELSE 'GENERAL' END AS route FROM whole LEFT JOIN kinds USING (id))
"""
# What every order and its customer may be asked about: values of the tables in the places that decide.
ASKED_SQL = """
asked AS (SELECT o_orderkey AS id, CASE o_orderstatus
  WHEN 'F' THEN 'What was the profit of ' || c_name || ' in ' || year(o_orderdate) || ', and what is a ' || lower(c_mktsegment) || ' bond?'
  WHEN 'O' THEN 'What is the ' || lower(c_mktsegment) || ' ' || CASE WHEN o_totalprice > 250000 THEN 'revenue' ELSE 'business' END || '; which ' || lower(substr(o_orderpriority, 3)) || ' plants?'
  ELSE 'Tell me about the ' || lower(c_mktsegment) || ' orders and who placed ' || lower(substr(o_orderpriority, 3)) END AS question
  FROM orders JOIN customer ON c_custkey = o_custkey)
"""


@query("STR12_keyword_router", f"WITH {ASKED_SQL}, {ROUTED_SQL} SELECT id, route FROM routed")
def keyword_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR12: the keyword router on a question about every order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    segment, priority = F.lower("c_mktsegment"), F.lower(F.substr("o_orderpriority", F.lit(3)))
    question = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("What was the profit of "), "c_name", F.lit(" in "), F.year("o_orderdate"), F.lit(", and what is a "), segment, F.lit(" bond?")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("What is the "), segment, F.when(F.col("o_totalprice") > 250000, " revenue").otherwise(" business"), F.lit("; which "), priority, F.lit(" plants?")))
        .otherwise(F.concat(F.lit("Tell me about the "), segment, F.lit(" orders and who placed "), priority))
    )
    return both.select(F.col("o_orderkey").alias("id"), Q.keyword_route(question).alias("route"))


@query(
    "LLM1_routed_turns",
    "SELECT lang, count(*) FILTER (text IS NOT NULL AND regexp_matches(lower(text), '(^|[^a-z0-9''])(19|20)[0-9][0-9]([^a-z0-9'']|$)')) AS with_year, count(*) AS n FROM documents GROUP BY lang",
)
def routed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM1: texts that the offline router would send to documents for a year that they name, by language."""
    year = F.lower("text").rlike(r"(^|[^a-z0-9'])(19|20)[0-9][0-9]([^a-z0-9']|$)")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.coalesce(year, F.lit(False))).alias("with_year"), F.count("*").alias("n"))


@query(
    "FLT6_citations",
    """WITH c AS (SELECT event_id, list_transform([event_id % 4, event_id % 3, event_id % 4, 9], lambda x: 'S' || x) AS cited FROM events)
SELECT event_id, array_to_string(list_filter([cited[1], CASE WHEN cited[2] <> cited[1] THEN cited[2] END], lambda x: x IN ('S1', 'S2', 'S3')), ',') AS valid FROM c""",
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6: cited ids normalised, unknown ones dropped, order kept."""
    ids = [F.col("event_id") % 4, F.col("event_id") % 3, F.col("event_id") % 4, F.lit(9)]
    cited = F.array(*[F.concat(F.lit("[s"), i.cast("string"), F.lit(" ]")) for i in ids])
    known = F.array(*[F.lit(x) for x in ("S1", "S2", "S3")])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(A.valid_citations(cited, known), ",").alias("valid"))


@query("LLM3_offline_answers")
def offline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM3 UDF3: the extractive stand-in answers each item from its best keyword hit."""
    from .retrieval import lexical

    best = lexical(spark, sf_dir).where("rank = 1").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    asked = table(spark, sf_dir, "benchmark").select("item_id", search_terms(F.col("text")).alias("terms"))
    return best.join(asked, "item_id").select("item_id", "doc_id", A.extractive_answer(F.col("terms"), F.col("text")).alias("answer"))


@query(
    "STM5_ingest_status",
    "SELECT source, CASE WHEN count(*) FILTER (n_chars < 200) * 2 > count(*) THEN 'FAILED' WHEN sum(n_chars) = 0 THEN 'FAILED' ELSE 'READY' END AS status FROM documents GROUP BY source",
)
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM5: failure policy per source."""
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") < 200).alias("failed"), F.count("*").alias("total"), F.sum("n_chars").alias("chunks"))
    return pages.select("source", I.ingest_status(F.col("failed"), F.col("total"), F.col("chunks")).alias("status"))


@query("EXT_windowed_events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: daily windows over events, the same function that runs on a stream with a watermark."""
    return I.windowed_counts(table(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 6))


@query("STM1_streamed_chunks")
def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM1 STM2 STM3 SNK1: all documents ingested as a stream, and the chunks that the target then holds."""
    import uuid

    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    I.ingest(spark, f"{sf_dir}/documents.parquet", f"{root}/chunks", f"{root}/progress").awaitTermination()
    return I.current_chunks(spark, f"{root}/chunks")


@query("PRJ1_page_labels", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'p.' || page_id ELSE 'p.' || (page_id - 1) || ' (PDF p.' || page_id || ')' END AS label FROM pages")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1 PRJ3: how a page is shown."""
    own, printed = F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, F.col("page_id")).otherwise(F.col("page_id") - 1).cast("string")
    label = F.when(own == printed, F.concat(F.lit("p."), own)).otherwise(F.concat(F.lit("p."), printed, F.lit(" (PDF p."), own, F.lit(")")))
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label"))


@query("STR4_clean_lines", r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: length of the text with white space collapsed."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(collapsed(F.col("text"))).cast("long").alias("n"))


# Items of the benchmark ask about documents, users' turns are talk.
_LABELLED_SQL = """
asked AS (SELECT 'i' || item_id AS id, text AS question, 'DOCUMENT' AS truth FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '.' || turn, text, 'GENERAL' FROM conversations WHERE role = 'user')
"""


@query(
    "AGG38_router_benchmark",
    f"""WITH {_LABELLED_SQL}, {ROUTED_SQL}, {BM25_SQL.replace("SELECT DISTINCT item_id, unnest(" + terms_sql("text") + ") AS term FROM benchmark", "SELECT DISTINCT id AS item_id, unnest(" + terms_sql("question") + ") AS term FROM asked")},
best AS (SELECT item_id AS id, max(score) AS score FROM s GROUP BY item_id),
v AS (SELECT id, truth, 'keyword' AS variant, route FROM asked JOIN routed USING (id)
  UNION ALL SELECT id, truth, 'score', CASE WHEN coalesce(score, 0) >= 60 THEN 'DOCUMENT' ELSE 'GENERAL' END FROM asked LEFT JOIN best USING (id)
  UNION ALL SELECT id, truth, 'constant', 'DOCUMENT' FROM asked)
SELECT variant, count(*) AS n, round(avg(CASE WHEN route = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(count(*) FILTER (route <> truth AND truth = 'DOCUMENT') AS BIGINT) AS missed,
CAST(count(*) FILTER (route <> truth AND truth = 'GENERAL') AS BIGINT) AS wrongly_sent FROM v GROUP BY variant""",
)
def router_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG38: three routers side by side on benchmark items and users' turns: keywords, the best hit's score, and the fallback
    that sends everything to the documents."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("id"), F.col("text").alias("question"), F.lit("DOCUMENT").alias("truth"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    turns = turns.select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), F.col("text").alias("question"), F.lit("GENERAL").alias("truth"))
    asked = items.unionAll(turns)
    questions = asked.select("id", F.col("question").alias("query"))
    best = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), questions, 1, "id", "query", "doc_id")
    best = (S.search(kept(spark, sf_dir), questions, 1, "id", "query", "doc_id")[0] if best is None else best).select("id", "score")
    routed = asked.join(best, "id", "left").select(
        "id", "truth", Q.keyword_route(F.col("question")).alias("keyword"), Q.score_route(F.col("score"), 60.0).alias("score"), F.lit("DOCUMENT").alias("constant"),
    )
    long = routed.unpivot(["id", "truth"], ["keyword", "score", "constant"], "variant", "route")
    wrong = F.col("route") != F.col("truth")
    return long.groupBy("variant").agg(
        F.count("*").alias("n"), F.round(F.avg((~wrong).cast("double")), 6).alias("accuracy"), F.count_if(wrong & (F.col("truth") == "DOCUMENT")).alias("missed"),
        F.count_if(wrong & (F.col("truth") == "GENERAL")).alias("wrongly_sent"),
    )
