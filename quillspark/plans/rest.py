"""Queries of the operators that other plans only touch: files, keyed writes, restarts, replies, headings and slices."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..functions import figures as N
from ..functions import text as X
from ..operators import answers as A
from ..operators import catalog as C
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..session import table
from ..sources import files
from ..tables import saved, shared_dir
from .figures import edge_lines
from .registry import ORACLES, query
from .retrieval import BM25_SQL, GOLD_SQL, LENGTH_SQL, fused_lists, gold_pairs, lexical, terms_sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "SRC4_new_uploads",
    """WITH e AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL)
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_uploads FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT h FROM e) GROUP BY 1""",
)
def new_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: uploads taken in once per content; content that an earlier attempt stored stays out, after a failed attempt it is queued again."""
    uploads = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stored = uploads.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("content_hash")
    fresh = uploads.join(stored, "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_uploads"))


@query("SRC9_docs_map", "SELECT source AS key, 'report ' || max(doc_id) || '.pdf' AS filename FROM documents WHERE source IS NOT NULL GROUP BY 1")
def docs_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: a map of keys to file names, read from a flat YAML file with comments and quotes (derived from the documents)."""
    named = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.max("doc_id").alias("n"))
    file_name = F.concat(F.lit("report "), F.col("n").cast("string"), F.lit(".pdf"))
    quoted = F.when(F.col("n") % 2 == 0, F.concat(F.lit('"'), file_name, F.lit('"  # latest'))).otherwise(file_name)
    path = _folder(spark, "docs-map")
    named.select(F.concat(F.lit("# a source and its file\n"), "source", F.lit(":  "), quoted).alias("value")).write.text(path)
    return files.flat_yaml(spark, path)


@query("SNK4_appended_records", "SELECT event_id, user_id, event_type FROM events")
def appended_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: records appended as JSON lines in two runs, beside torn lines of a writer that was stopped; readers see whole records only."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = _folder(spark, "records")
    files.append_records(events.where("event_id % 2 = 0"), path)
    torn = F.to_json(F.struct("event_id", "user_id", "event_type"))
    events.where("event_id % 17 = 0").select(F.left(torn, F.length(torn) - 4).alias("value")).write.mode("append").text(path)
    files.append_records(events.where("event_id % 2 = 1"), path)
    return files.whole_records(spark, path, "event_id bigint, user_id bigint, event_type string")


_CONTENT_KEYS = ("input", "output")


@query(
    "SNK7_content_stripped",
    "SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'input,role' ELSE 'role' END AS keys, CASE WHEN conv_id % 4 = 0 THEN md5(text) END AS content FROM conversations",
)
def content_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: trace attributes without their content keys, unless the conversation opted in."""
    attributes = F.create_map(F.lit("input"), F.col("text"), F.lit("role"), F.col("role"))
    kept = F.map_filter(attributes, lambda k, v: ~k.isin(*_CONTENT_KEYS) | (F.col("conv_id") % 4 == 0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", kept.alias("kept"))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("keys"), F.md5(F.try_element_at("kept", F.lit("input"))).alias("content"))


# Lines of documents as chunks with a deterministic id; a second run writes some of them anew.
_LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"


def _line_chunks(docs: DataFrame) -> DataFrame:
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(F.sha2(F.concat_ws("-", "doc_id", "pos"), 256).alias("chunk_id"), "doc_id", F.md5("line").alias("line_md5"))


@query(
    "SNK1_upserted_chunks",
    f"""WITH {_LINES_SQL} SELECT sha256(doc_id || '-' || pos) AS chunk_id, doc_id, md5(line) AS line_md5,
CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 2 ELSE 1 END AS version FROM l""",
)
def upserted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: chunks with deterministic ids upserted by two runs; what both wrote stands there once, with the later version."""
    docs = table(spark, sf_dir, "documents")
    again = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    first, second = (_line_chunks(d).withColumn("version", F.lit(n)) for n, d in ((1, docs), (2, again)))
    return sinks.upserted(first, second, ["chunk_id"])


_STATES = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'P' THEN 'PARTIAL' ELSE 'PROCESSING' END AS status FROM orders"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("PROCESSING")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("piece")).distinct()


def _with_pieces(states: DataFrame, pieces: DataFrame) -> DataFrame:
    counts = pieces.groupBy("o_orderkey").agg(F.count("*").alias("n_pieces"))
    return states.join(counts, "o_orderkey", "left").na.fill(0, ["n_pieces"])


@query(
    "STM3_requeued",
    f"""WITH s AS ({_STATES}), p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN status = 'READY' THEN 'READY' ELSE 'QUEUED' END AS status, CASE WHEN status = 'READY' THEN coalesce(n, 0) ELSE 0 END AS n_pieces FROM s LEFT JOIN p ON l_orderkey = o_orderkey""",
)
def requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM3: after a crash, what was not finished is queued again and its pieces go."""
    states = _states(spark, sf_dir)
    open_ = states.where("status in ('QUEUED', 'PROCESSING', 'PARTIAL')").select("o_orderkey", F.lit("QUEUED").alias("status"))
    left = sinks.deleted(_pieces(spark, sf_dir), open_, ["o_orderkey"])
    return _with_pieces(sinks.upserted(states, open_, ["o_orderkey"]), left)


@query(
    "STM2_restarted",
    f"""WITH s AS ({_STATES}), p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT o_orderkey, l_linenumber AS piece, CASE WHEN status = 'PARTIAL' THEN 2 ELSE 1 END AS run FROM s JOIN p ON l_orderkey = o_orderkey WHERE status <> 'PARTIAL' OR l_linenumber <= 2""",
)
def restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM2: a restarted document loses its old pieces first, also those that the new run does not write; running again changes nothing."""
    states = _states(spark, sf_dir)
    redo = states.where("status = 'PARTIAL'").select("o_orderkey")
    old = _pieces(spark, sf_dir).join(states, "o_orderkey", "left_semi").withColumn("run", F.lit(1))
    fresh = old.where("piece <= 2").join(redo, "o_orderkey", "left_semi").withColumn("run", F.lit(2))

    def run(target: DataFrame) -> DataFrame:
        return sinks.deleted(target, redo, ["o_orderkey"]).unionByName(fresh)

    return run(run(old))


@query(
    "SNK10_failed_ingest",
    f"""WITH s AS ({_STATES}), p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN status = 'PARTIAL' THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'PARTIAL' THEN 'Error: order ' || o_orderkey END AS error,
CASE WHEN status = 'PARTIAL' THEN round((o_orderkey % 1000) / 7.0, 2) END AS seconds, CASE WHEN status = 'PARTIAL' THEN 0 ELSE coalesce(n, 0) END AS n_pieces FROM s LEFT JOIN p ON l_orderkey = o_orderkey""",
)
def failed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: a failed ingest drops its pieces and records error and seconds."""
    key = F.col("o_orderkey")
    states = _states(spark, sf_dir).withColumns({"error": F.lit(None).cast("string"), "seconds": F.lit(None).cast("double")})
    error, seconds = F.concat(F.lit("Error: order "), key.cast("string")), F.round(key % 1000 / F.lit(7.0), 2)
    failed = states.where("status = 'PARTIAL'").select("o_orderkey", F.lit("FAILED").alias("status"), error.alias("error"), seconds.alias("seconds"))
    left = sinks.deleted(_pieces(spark, sf_dir), failed, ["o_orderkey"])
    return _with_pieces(sinks.upserted(states, failed, ["o_orderkey"]), left)


@query(
    "PRJ3_citations",
    f"""WITH {BM25_SQL}, t AS (SELECT item_id, doc_id, rank, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM lex JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT item_id, doc_id, 'S' || rank AS marker, coalesce(source, '?') || '/' || doc_id AS shown, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(left(t, 159)) || '…' END AS snippet FROM t""",
)
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3: citations of the five best hits: marker, what is shown, snippet."""
    hits = R.small(lexical(spark, sf_dir).where("rank <= 5").select("item_id", "doc_id", "rank"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(hits, "doc_id")
    shown = F.concat(F.coalesce("source", F.lit("?")), F.lit("/"), F.col("doc_id").cast("string"))
    return rows.select("item_id", "doc_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("marker"), shown.alias("shown"), X.snippet(F.col("text"), 160).alias("snippet"))


@query("AGG2_best_scores", f"WITH {BM25_SQL} SELECT doc_id, round(max(score), 6) AS best, count(*) AS n_items FROM lex GROUP BY doc_id")
def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2: the best keyword score that each document reaches over all items, and for how many items it is listed."""
    return lexical(spark, sf_dir).groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("best"), F.count("*").alias("n_items"))


@query(
    "AGG18_slices",
    """SELECT CAST(grouping(lang) AS INT) AS all_langs, CAST(grouping(source) AS INT) AS all_sources, lang, source, count(*) AS n, count(quality) AS judged, count(*) FILTER (quality = 1) * 1.0 / nullif(count(quality), 0) AS share
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""",
)
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: one metric overall and by two kinds of slices, in one pass; a null slice is told from the whole."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lang, source = F.col("lang"), F.col("source")
    return rows.groupingSets([[], [lang], [source]], lang, source).agg(
        F.grouping("lang").cast("int").alias("all_langs"), F.grouping("source").cast("int").alias("all_sources"),
        F.count("*").alias("n"), F.count("quality").alias("judged"), E.share(F.col("quality") == 1).alias("share"),
    )


@query("WIN1_fused_ranks", f"WITH {BM25_SQL}, {LENGTH_SQL} SELECT item_id, doc_id, CAST(rank AS BIGINT) AS rank FROM fused")
def fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: places 1 to k of the fused list."""
    return fused_lists(spark, sf_dir)[1].select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))


_PERIODS = """p AS (SELECT DISTINCT o_custkey, right(CAST(year(o_orderdate) AS VARCHAR), 2) AS y, CASE WHEN o_orderkey % 5 = 0 THEN 9 WHEN o_orderkey % 7 = 0 THEN ceil(quarter(o_orderdate) / 2.0) ELSE quarter(o_orderdate) END AS part,
CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'H' || CAST(ceil(quarter(o_orderdate) / 2.0) AS INT) || ' ' ELSE 'Q' || quarter(o_orderdate) || ' ' END || 'FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS name FROM orders)"""


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, quarter = F.col("o_orderkey"), F.quarter("o_orderdate")
    part = F.when(key % 5 == 0, "").when(key % 7 == 0, F.concat(F.lit("H"), F.ceil(quarter / 2).cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_custkey", F.concat(part, F.lit("FY"), F.right(F.year("o_orderdate").cast("string"), F.lit(2))).alias("period"))


@query("TOP4_periods_in_order", f"WITH {_PERIODS} SELECT o_custkey, string_agg(name, ',' ORDER BY CAST(y AS INT), part, name) AS periods FROM p GROUP BY o_custkey")
def periods_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP4: periods oldest first, a half beside the quarter of its number, the full year after its parts."""
    return C.coverage(_periods(spark, sf_dir), ["o_custkey"], "period").select("o_custkey", F.array_join("periods", ",").alias("periods"))


@query(
    "JN18_covered_periods",
    f"WITH {_PERIODS} SELECT o_custkey, string_agg(name, ',' ORDER BY CAST(y AS INT), part, name) AS periods FROM p WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey",
)
def covered_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18: the periods covered for the companies asked about."""
    asked = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    found = C.coverage(_periods(spark, sf_dir).join(asked, "o_custkey", "left_semi"), ["o_custkey"], "period")
    return found.select("o_custkey", F.array_join("periods", ",").alias("periods"))


@query(
    "WIN10_packed_lines",
    """WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, length(unnest(string_split(text, chr(10)))) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, n, n AS used, 1 AS piece FROM l WHERE i = 1 UNION ALL
  SELECT l.doc_id, l.i, l.n, CASE WHEN w.used + l.n <= 400 THEN w.used + l.n WHEN w.n <= 80 AND w.n + l.n <= 400 THEN w.n + l.n ELSE l.n END, CASE WHEN w.used + l.n <= 400 THEN w.piece ELSE w.piece + 1 END
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, CAST(max(piece) AS BIGINT) AS n_pieces, CAST(arg_max(used, i) AS BIGINT) AS last_chars FROM w GROUP BY doc_id""",
)
def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: lines packed greedily into pieces of 400 characters; a piece begins with the line before it, where that has at most 80 and fits."""
    sizes = F.transform(F.split("text", "\n"), F.length)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("before"), F.lit(0).alias("piece"))

    def add(held: Column, n: Column) -> Column:
        fits = (held["piece"] > 0) & (held["used"] + n <= 400)
        tail = (held["piece"] > 0) & (held["before"] <= 80) & (held["before"] + n <= 400)
        used = F.when(fits, held["used"] + n).when(tail, held["before"] + n).otherwise(n)
        return F.struct(used.alias("used"), n.alias("before"), F.when(fits, held["piece"]).otherwise(held["piece"] + 1).alias("piece"))

    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.aggregate(sizes, start, add).alias("held"))
    return rows.select("doc_id", F.col("held.piece").cast("long").alias("n_pieces"), F.col("held.used").cast("long").alias("last_chars"))


# Topics and the beginnings of words that tell them.
_TOPICS = {"licence": ("licen", "copyright"), "contact": ("mail", "phone"), "web": ("http", "www"), "law": ("right", "warrant")}


@query(
    "STR11_topics",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(starts)})') THEN '{name}' END" for name, starts in sorted(_TOPICS.items()))
    + "], lambda t: t IS NOT NULL), ',') AS topics FROM documents",
)
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR11: topics whose stems begin a word of the text."""
    low = F.lower("text")
    found = [F.when(low.rlike(rf"(?<![a-z0-9])({'|'.join(starts)})"), name) for name, starts in sorted(_TOPICS.items())]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_compact(F.array(*found)), ",").alias("topics"))


# Texts by the remainder of a part's key, and the claims that remain in them.
_NOISY = [
    ("In FY 25 the plant ran", 0), ("1. First item of the list", 0), ("By 31 March 2025 it was done", 0), ("In 2024-25 nothing changed", 0), ("sold 12,345 units", 1),
    ("the 3rd quarter", 0), ("Q3 was fair", 0), ("sold 45.5 lakh and 1,25,630 more", 2), ("5 people came", 0), ("a margin of 5%", 1), ("see [S2] for it", 0),
]


@query("NUM4_claims_left", "SELECT p_partkey, CAST(CASE p_partkey % " + str(len(_NOISY)) + "".join(f" WHEN {i} THEN {n}" for i, (_, n) in enumerate(_NOISY)) + " END AS BIGINT) AS n_claims FROM part")
def claims_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM4: dates, spans, period codes, list numbers, years, single digits, ordinals and citations are no claims."""
    text = F.get(F.array(*[F.lit(t) for t, _ in _NOISY]), (F.col("p_partkey") % len(_NOISY)).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    counts = N.claims(parts, "p_partkey", "text").groupBy("p_partkey").agg(F.count("*").alias("n_claims"))
    return parts.select("p_partkey").join(counts, "p_partkey", "left").na.fill(0, ["n_claims"])


@query(
    "JSN2_checked_replies",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'DOCUMENT' WHEN 1 THEN 'GENERAL' WHEN 2 THEN 'MIXED' END AS route, CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END AS confidence,
CASE event_id % 6 WHEN 3 THEN 'unknown_route' WHEN 4 THEN 'bad_json' WHEN 5 THEN 'bad_json' END AS problem FROM events""",
)
def checked_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN2: replies parsed against a schema: letter case and fences are forgiven, confidence is held between 0 and 1, unknown routes and broken JSON are not."""
    kind = F.col("event_id") % 6
    reply = (
        F.when(kind == 0, '{"route": "document", "confidence": 7}').when(kind == 1, '```json\n{"route": " General ", "confidence": "0.5"}\n```')
        .when(kind == 2, 'Here it is: {"route": "MIXED", "confidence": -1}').when(kind == 3, '{"route": "WEATHER", "confidence": 0.4}')
        .when(kind == 4, '{"route": "DOCUMENT", "confidence"').otherwise("no object at all")
    )
    return table(spark, sf_dir, "events").select("event_id", A.checked_route(reply).alias("r")).select("event_id", "r.*")


@query(
    "STM6_disclosure",
    """SELECT source, CASE WHEN n < m THEN 'searched ' || n || ' of ' || m || ' pages' END AS note FROM (SELECT source, count(*) FILTER (n_chars > 200) AS n, count(*) AS m FROM documents GROUP BY source)""",
)
def disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM6: what a search over a partly ingested source discloses; null where all of it was searched."""
    done = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 200).alias("n"), F.count("*").alias("m"))
    return done.select("source", F.when(F.col("n") < F.col("m"), F.format_string("searched %d of %d pages", "n", "m")).alias("note"))


@query(
    "STM7_text_pages_first",
    "SELECT l_orderkey, page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY scanned, page) AS BIGINT) AS turn FROM (SELECT l_orderkey, l_linenumber AS page, bool_and(l_quantity < 10) AS scanned FROM lineitem GROUP BY 1, 2)",
)
def text_pages_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM7: pages with text are worked on before those that need recognition, each kind in page order (few lines an order)."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.bool_and(F.col("l_quantity") < 10).alias("scanned"))
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("scanned", "page")).cast("long")
    return pages.select("l_orderkey", "page", turn.alias("turn"))


@query(
    "UDF6_first_line_terms",
    f"""WITH {BM25_SQL}, t AS (SELECT doc_id, {terms_sql("string_split(text, chr(10))[1]")} AS head FROM documents), i AS (SELECT item_id, {terms_sql("text")} AS asked FROM benchmark)
SELECT item_id, doc_id, CAST(len(list_intersect(list_distinct(head), list_distinct(asked))) AS BIGINT) AS shared FROM lex JOIN t USING (doc_id) JOIN i USING (item_id) WHERE rank <= 20""",
)
def first_line_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF6: the texts of ranked ids are looked up by a join; how many of the item's terms stand in a hit's first line."""
    hits = R.small(lexical(spark, sf_dir).where("rank <= 20").select("item_id", "doc_id"))
    heads = table(spark, sf_dir, "documents").select("doc_id", X.search_terms(F.substring_index("text", "\n", 1)).alias("head"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", X.search_terms(F.col("text")).alias("asked"))
    both = heads.join(hits, "doc_id").join(R.small(asked), "item_id")
    return both.select("item_id", "doc_id", F.size(F.array_intersect("head", "asked")).cast("long").alias("shared"))


@query(
    "LLM2_rewrites",
    """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'bad_json' WHEN 2 THEN 'unclear' WHEN 3 THEN 'rejected' ELSE 'rewritten' END AS outcome,
md5(CASE WHEN conv_id % 5 = 4 THEN 'About: ' || text ELSE text END) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL""",
)
def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM2: the original question stays after an error, broken JSON, a reply that calls it unclear, or a rewrite with new numbers."""
    kind, text = F.col("conv_id") % 5, F.col("text")
    said = lambda clear, new: F.to_json(F.struct(F.lit(clear).alias("clear"), new.alias("question")))
    reply = (
        F.when(kind == 1, F.lit('{"clear": tr')).when(kind == 2, said(False, text)).when(kind == 3, said(True, F.concat(text, F.lit(" in 987654321"))))
        .when(kind == 4, said(True, F.concat(F.lit("About: "), text)))
    )
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", "text", reply.alias("reply"))
    judged = rows.select("conv_id", "turn", A.rewritten(text, F.col("reply")).alias("r"))
    return judged.select("conv_id", "turn", "r.outcome", F.md5("r.question").alias("question"))


@query(
    "LLM4_labelled_answers",
    "SELECT conv_id, turn, 'general knowledge' AS label, md5('General knowledge, not from your documents: ' || trim(text)) AS answer FROM conversations WHERE role = 'assistant' AND length(trim(text)) > 0",
)
def labelled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM4: answers without documents always carry their label; empty ones are no answers."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant' and length(trim(text)) > 0")
    answer = F.concat(F.lit("General knowledge, not from your documents: "), F.trim("text"))
    return rows.select("conv_id", "turn", F.lit("general knowledge").alias("label"), F.md5(answer).alias("answer"))


@query(
    "LLM5_judge_budget",
    """SELECT conv_id, turn, spent, spent <= 1500 AS judged FROM (SELECT conv_id, turn, CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn, role, text RANGE UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM conversations)""",
)
def judge_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM5: turns are judged in order until a conversation's budget of characters is spent; the others stay unjudged."""
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "conversations").withColumn("spent", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(so_far).cast("long"))
    return rows.select("conv_id", "turn", "spent", (F.col("spent") <= 1500).alias("judged"))


_HEADING = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query("PDF2_page_headings", f"SELECT page_id, coalesce({_HEADING.format('h1')}, {_HEADING.format('title')}) AS heading FROM pages")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF2: the heading of a page: its first h1, else its title; null without either."""

    def inside(tag: str) -> Column:
        inner = F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return F.nullif(X.collapsed(F.regexp_replace(inner, r"(?s)<[^>]*>", " ")), F.lit(""))

    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(inside("h1"), inside("title")).alias("heading"))


@query(
    "PDF3_stripped_edges",
    f"""WITH r AS (SELECT doc, line_key FROM ({ORACLES["AGG34_edge_lines"]})),
x AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, n, (i <= 3 OR i > n - 3) AND EXISTS (SELECT 1 FROM r WHERE r.doc = source AND r.line_key = trim(regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '\\s+', ' ', 'g'))) AS gone FROM x)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, count(*) FILTER (gone) AS n_stripped FROM k GROUP BY doc_id""",
)
def stripped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF3: repeated edge lines leave the first and last three lines of a page; inner lines stay, even if they read the same."""
    pages = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("source").alias("doc"), F.split("text", "\n").alias("ls"))
    outer = F.filter(F.transform("ls", lambda line, i: F.when((i < 3) | (i >= F.size("ls") - 3), line)), lambda line: line.isNotNull())
    edges = pages.select("doc_id", "doc", F.explode(outer).alias("line")).select("doc_id", "doc", X.line_key(F.col("line")).alias("line_key"))
    repeated = R.small(saved(edge_lines(spark, sf_dir).select("doc", "line_key")))
    gone = edges.join(repeated, ["doc", "line_key"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_stripped"))
    return pages.select("doc_id", F.size("ls").cast("long").alias("n_lines")).join(gone, "doc_id", "left").na.fill(0, ["n_stripped"])


@query(
    "PRJ11_not_ready_notice",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN 'Document ' || o_orderkey || ' is searched in part' ELSE 'Document ' || o_orderkey || ' is not ready yet' END AS notice FROM orders""",
)
def not_ready_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11: notice of documents that are not, or not wholly, searched."""
    status, name = F.col("status"), F.col("o_orderkey")
    notice = F.when(status == "PARTIAL", F.format_string("Document %d is searched in part", name)).when(status != "READY", F.format_string("Document %d is not ready yet", name))
    return _states(spark, sf_dir).select("o_orderkey", notice.alias("notice"))


@query(
    "PRJ14_gold_and_sections",
    r"""WITH f AS (SELECT doc_id, text, quality, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, quality IS NOT NULL AS has_gold, md5(CASE WHEN quality = 1 THEN text WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 119)) || '…' END) AS section FROM f""",
)
def gold_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ14: records with their gold, and sections with the cited text, else a snippet."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    section = F.coalesce(F.when(F.col("quality") == 1, F.col("text")), X.snippet(F.col("text"), 120))
    return rows.select("doc_id", F.col("quality").isNotNull().alias("has_gold"), F.md5(section).alias("section"))


@query(
    "PRJ15_judge_sources",
    r"""WITH c AS (SELECT page_id, CASE WHEN length(html) > 600 THEN left(html, 600) || ' [cut]' ELSE html END AS t FROM pages)
SELECT page_id, regexp_replace(t, '<(/?(?:div|p|title|body))', '&lt;\1', 'gi') AS source FROM c""",
)
def judge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15: what a judge is shown of a source: cut to 600 characters and marked so, its own tags made harmless."""
    html = F.col("html")
    cut = F.when(F.length(html) > 600, F.concat(F.left(html, F.lit(600)), F.lit(" [cut]"))).otherwise(html)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(cut, r"(?i)<(/?(?:div|p|title|body))", "&lt;$1").alias("source"))


@query(
    "AGG39_retrieval_block",
    f"""WITH {BM25_SQL}, {GOLD_SQL},
first AS (SELECT item_id, min(g.lang) AS slice, min(rank) AS r FROM gold g LEFT JOIN lex USING (item_id, doc_id) WHERE item_id IN (SELECT item_id FROM benchmark WHERE length(text) >= 100) GROUP BY item_id)
SELECT slice, count(*) AS n, avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) AS recall_at_1, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END) AS recall_at_3,
avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN r <= 8 THEN 1.0 ELSE 0.0 END) AS recall_at_8, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr
FROM first GROUP BY ROLLUP (slice)""",
)
def retrieval_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG39: recall and MRR over the records that pass a filter: items of 100 characters or more."""
    long_items = table(spark, sf_dir, "benchmark").where("length(text) >= 100").select("item_id")
    gold = saved(gold_pairs(spark, sf_dir).join(R.small(long_items), "item_id", "left_semi").withColumn("page", F.lit(1)))
    slices_ = gold.groupBy("item_id").agg(F.min("lang").alias("slice"))
    first = R.first_hits(lexical(spark, sf_dir).withColumn("page", F.lit(1)), gold, "item_id")
    return R.recall_and_mrr(first.join(slices_, "item_id"), "slice").withColumn("mrr", F.round("mrr", 6))


@query(
    "AGG43_live_tokens",
    """SELECT CASE conv_id % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'small' ELSE 'other' END AS model, role AS stage, CAST(coalesce(sum(length(text)) FILTER (turn % 2 = 1), 0) AS BIGINT) AS tokens,
count(*) FILTER (turn % 2 = 1) AS calls, count(*) FILTER (turn % 2 = 0) AS cached FROM conversations GROUP BY 1, 2""",
)
def live_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG43: tokens by model and stage; calls answered from a cache spend none."""
    model = F.when(F.col("conv_id") % 3 == 0, "large").when(F.col("conv_id") % 3 == 1, "small").otherwise("other")
    live = F.col("turn") % 2 == 1
    return table(spark, sf_dir, "conversations").groupBy(model.alias("model"), F.col("role").alias("stage")).agg(
        F.coalesce(F.sum(F.when(live, F.length("text"))), F.lit(0)).cast("long").alias("tokens"), F.count_if(live).alias("calls"), F.count_if(F.col("turn") % 2 == 0).alias("cached"),
    )
