"""Figures, names, periods, tables and set queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import figures as N
from ..functions import text as X
from ..operators import catalog as C
from ..session import table
from .registry import query


@query(
    "STR5_line_keys",
    r"SELECT line_key, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS line_key FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1 HAVING count(*) > 5",
)
def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5 AGG34: lines that repeat, digits folded."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(X.line_key(F.col("line")).alias("line_key")).agg(F.count("*").alias("n")).where("n > 5")


@query(
    "AGG34_edge_lines",
    r"""WITH l AS (SELECT source AS doc, doc_id AS page, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc, page, unnest(list_concat(ls[1:3], ls[-3:])) AS line FROM l),
k AS (SELECT DISTINCT doc, page, trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS line_key FROM e), p AS (SELECT doc, count(*) AS pages FROM l GROUP BY doc)
SELECT doc, line_key, count(*) AS n FROM k JOIN p USING (doc) WHERE line_key <> '' GROUP BY doc, line_key, pages HAVING pages >= 3 AND count(*) > 0.02 * pages""",
)
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG34 PDF3: lines at the edges of more than a share of a source's pages."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("ls"))
    edges = F.concat(F.slice("ls", 1, 3), F.slice("ls", -F.least(F.size("ls"), F.lit(3)), F.lit(3)))
    keys = pages.select("doc", "page", F.explode(edges).alias("line")).select("doc", "page", X.line_key(F.col("line")).alias("line_key")).where("line_key <> ''").distinct()
    sizes = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    counts = keys.groupBy("doc", "line_key").agg(F.count("*").alias("n"))
    return counts.join(sizes, "doc").where("pages >= 3 and n > 0.02 * pages").select("doc", "line_key", "n")


@query(
    "NUM1_grouping",
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1,25,630' WHEN 1 THEN CAST(p_size AS VARCHAR) || ',234' WHEN 2 THEN CAST(p_size AS VARCHAR) || ',23' ELSE CAST(p_size AS VARCHAR) END AS token FROM part)
SELECT p_partkey, token, regexp_matches(token, '^\d+$') OR regexp_matches(token, '^\d{1,3}(,\d{3})+$') OR regexp_matches(token, '^\d{1,2}(,\d{2})*,\d{3}$') AS valid FROM t""",
)
def grouping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM1: validity of digit grouping."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    token = F.when(kind == 0, "1,25,630").when(kind == 1, F.concat(size, F.lit(",234"))).when(kind == 2, F.concat(size, F.lit(",23"))).otherwise(size)
    rows = table(spark, sf_dir, "part").select("p_partkey", token.alias("token"))
    return rows.withColumn("valid", N.valid_grouping(F.col("token")))


@query("NUM2_document_figures", r"SELECT doc_id, len(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')) AS n_runs FROM documents")
def document_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM2: number runs per document."""
    runs = F.regexp_extract_all("text", F.lit(f"({N.NUMBER})"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(runs).cast("long").alias("n_runs"))


@query("NUM3_claims")
def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM3: quantity claims in documents, noise removed, with scale words and percent signs."""
    return N.claims(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "JN11_differences",
    """WITH o AS (SELECT DISTINCT l_orderkey AS g, CAST(l_quantity AS DECIMAL(20, 6)) AS v FROM lineitem), c AS (SELECT o_orderkey AS g, CAST(o_orderkey % 7 + 1 AS DECIMAL(20, 6)) AS claim FROM orders)
SELECT c.g AS grp, CAST(claim AS DOUBLE) AS claim, CAST(a.v AS DOUBLE) AS a, CAST(b.v AS DOUBLE) AS b FROM c JOIN o a ON a.g = c.g JOIN o b ON b.g = c.g AND b.v = a.v - claim""",
)
def derived_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: claims that are the exact difference of two figures of the same order."""
    operands = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_quantity").cast("decimal(20,6)").alias("value")).distinct()
    claimed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grp"), (F.col("o_orderkey") % 7 + 1).cast("decimal(20,6)").alias("claim"))
    found = N.differences(claimed, operands, "grp")
    return found.select("grp", *[F.col(c).cast("double").alias(c) for c in ("claim", "a", "b")])


# Per order: its quantities as the source's text, and an answer that claims their range, a share, and at times a figure that is
# nowhere.
_LINES = "SELECT l_orderkey AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1"


@query(
    "NUM5_number_check",
    f"""WITH l AS ({_LINES}), o AS (SELECT o_orderkey, lo, hi FROM orders JOIN l ON k = o_orderkey)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'na' WHEN o_orderkey % 4 = 0 OR lo = hi THEN 'fail' ELSE 'pass' END AS status,
CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_claims FROM o""",
)
def number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM4 NUM5: answers about orders checked against their lines: printed, derived and missing figures."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("decimal(10,1)").alias("q"))
    sources = lines.select("o_orderkey", F.concat(F.lit("Line of quantity "), F.col("q").cast("string")).alias("text"))
    range_ = lines.groupBy("o_orderkey").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    share = F.round(F.col("lo") * 100 / F.col("hi"), 1).cast("decimal(10,1)").cast("string")
    claim = F.concat(
        F.lit("In FY 25 and by 31 March 2025 [S1], the range was "), (F.col("hi") - F.col("lo")).cast("string"), F.lit("; the least is "), share,
        F.lit(" per cent of the most"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(", up "), (F.col("o_orderkey") % 60).cast("string"), F.lit(".57 lakh"))).otherwise(""), F.lit("."),
    )
    text = F.when(F.col("o_orderkey") % 5 == 0, "1. In 2024-25 no figure of Q3 was given.").otherwise(claim)
    asked = table(spark, sf_dir, "orders").select("o_orderkey").join(range_, "o_orderkey").select("o_orderkey", text.alias("text"))
    return N.number_check(asked, sources, "o_orderkey").select("o_orderkey", "status", "n_claims")


@query(
    "NUM7_numeric_match",
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 3 <> 0 END AS matches FROM part",
)
def numeric_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM7: gold figures found in answers, in another scale word or with further figures beside them."""
    key = F.col("p_partkey")
    gold = F.when(key % 5 == 0, "not stated in 2024").otherwise(F.concat(key.cast("string"), F.lit(".5 crore")))
    said = F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit(".7 crore"))).when(key % 3 == 1, F.concat((key * 100 + 50).cast("string"), F.lit(" lakh and 77 more")))
    said = said.otherwise(F.concat(F.lit("about "), key.cast("string"), F.lit(".5")))
    rows = table(spark, sf_dir, "part").select("p_partkey", gold.alias("gold"), said.alias("said"))
    return N.numeric_match(rows.select("p_partkey", F.col("gold").alias("text")), rows.select("p_partkey", F.col("said").alias("text")), "p_partkey")


@query(
    "JN12_claims_in_pool",
    "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = o_orderkey % 50) AS printed FROM orders",
)
def claims_in_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: whether a claim is among the printed figures."""
    claim = (F.col("o_orderkey") % 50).cast("double")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", claim.alias("claim"))
    pool = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("claim")).distinct().withColumn("hit", F.lit(True))
    return orders.join(pool, ["o_orderkey", "claim"], "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("printed"))


@query("NUM10_percent_rounding", "SELECT s_suppkey, CAST(round(CAST(s_acctbal AS DECIMAL(18, 4)), 1) AS DOUBLE) AS rounded FROM supplier")
def percent_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM10: half-up rounding of decimals to the printed digits."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal").cast("decimal(18,4)"), 1).cast("double").alias("rounded"))


@query(
    "STR7_acronyms",
    r"""SELECT p_partkey, list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('limited', 'ltd', 'plc', 'inc', 'corporation', 'corp', 'company', 'co')), lambda w: left(w, 1)), 'string_agg', '') AS acronym FROM part""",
)
def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7: acronyms of names."""
    return table(spark, sf_dir, "part").select("p_partkey", X.acronym(F.col("p_name")).alias("acronym"))


@query(
    "DAT1_all_periods",
    """SELECT o_orderkey, 'Q' || quarter(o_orderdate) || ' FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) || CASE o_orderkey % 3 WHEN 0 THEN ',Q2 FY26' WHEN 1 THEN ',FY25' ELSE '' END AS periods FROM orders""",
)
def all_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT1: all periods that a text names, spelt quarters and ranges too."""
    year = F.right(F.year("o_orderdate").cast("string"), F.lit(2))
    more = F.when(F.col("o_orderkey") % 3 == 0, " against the second quarter of FY 2026, Q2 FY26").when(F.col("o_orderkey") % 3 == 1, " and FY2024-25").otherwise(".")
    text = F.concat(F.lit("Results of Q"), F.quarter("o_orderdate").cast("string"), F.lit(" FY"), year, more)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.periods(text), ",").alias("periods"))


@query(
    "DAT2_periods",
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) ELSE 'Q' || quarter(o_orderdate) || ' FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) END AS period FROM orders)
SELECT period, regexp_extract(period, 'FY[0-9]{2}') AS fy, count(*) AS n FROM p GROUP BY 1""",
)
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT2: fiscal periods read from file names, and their years."""
    year = F.right(F.year("o_orderdate").cast("string"), F.lit(2))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("report fy 20"), year)).otherwise(F.concat(F.lit("report q"), F.quarter("o_orderdate").cast("string"), F.lit(" FY"), year))
    named = table(spark, sf_dir, "orders").select(C.period(name).alias("period"))
    return named.groupBy("period").agg(F.count("*").alias("n")).withColumn("fy", C.fiscal_year(F.col("period")))


@query(
    "AGG31_coverage",
    """WITH p AS (SELECT DISTINCT o_orderstatus AS kind, right(CAST(year(o_orderdate) AS VARCHAR), 2) AS y, quarter(o_orderdate) AS q FROM orders)
SELECT kind, string_agg('Q' || q || ' FY' || y, ', ' ORDER BY CAST(y AS INT), q) AS periods FROM p GROUP BY kind""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG31 TOP4 JN18: sorted periods per report type."""
    name = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" FY"), F.right(F.year("o_orderdate").cast("string"), F.lit(2)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), name.alias("period")).distinct()
    return C.coverage(rows, ["kind"], "period").withColumn("periods", F.array_join("periods", ", "))


@query(
    "AGG30_catalog",
    "SELECT lower(n_name) AS company_key, min(n_name) AS name, count(*) AS n_docs FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0 GROUP BY 1",
)
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30 TOP5 FLT1: documents (suppliers) by company (nation), failed ones left out."""
    docs = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("s_suppkey") % 10 == 0, "FAILED").otherwise("READY")
    return C.companies(docs, F.col("n_name"), F.col("s_suppkey"), status).select("company_key", "name", "n_docs")


@query(
    "JN8_period_match",
    """WITH d AS (SELECT o_orderkey, 'Q' || quarter(o_orderdate) || ' FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS period FROM orders), w AS (SELECT unnest(['FY96', 'Q2 FY97']) AS wanted)
SELECT o_orderkey, period, wanted FROM d JOIN w ON d.period = wanted OR (length(wanted) = 4 AND right(d.period, 4) = wanted)""",
)
def period_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8: documents that serve the periods asked for."""
    name = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" FY"), F.right(F.year("o_orderdate").cast("string"), F.lit(2)))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("period"))
    wanted = spark.createDataFrame([("FY96",), ("Q2 FY97",)], "period string")
    return C.period_matches(wanted, docs).select("o_orderkey", "period", "wanted")


@query(
    "STR15_markdown_rows",
    "SELECT l_orderkey, l_linenumber, '| ' || l_returnflag || ' | ' || l_linestatus || ' | a\\|b | ' || l_linenumber || ' |' AS md FROM lineitem",
)
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR15: table rows in Markdown, bars escaped."""
    cells = F.array("l_returnflag", "l_linestatus", F.lit("a|b"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.markdown_row(cells).alias("md"))


@query(
    "JN5_table_siblings",
    """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS id, l_returnflag || ' | --- |' AS key FROM lineitem)
SELECT a.doc_id, a.id, b.id AS sibling FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.key = b.key AND a.id <> b.id""",
)
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: other pieces of the same table (line items of an order with the same flag)."""
    from ..operators.retrieval import table_siblings

    chunks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit("table").alias("source_kind"),
        F.concat("l_returnflag", F.lit("\n| --- |\n"), F.col("l_linenumber").cast("string")).alias("text"), F.struct("l_orderkey", "l_linenumber").alias("chunk_id"),
    )
    return table_siblings(chunks).select(F.col("chunk_id.l_orderkey").alias("doc_id"), F.col("chunk_id.l_linenumber").alias("id"), F.col("sibling_id.l_linenumber").alias("sibling"))


@query(
    "WIN13_column_clusters",
    """WITH e AS (SELECT event_type, value, CASE WHEN value - lag(value) OVER (PARTITION BY event_type ORDER BY value, event_id) > 8 THEN 1 ELSE 0 END AS fresh, event_id FROM events),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY value, event_id) AS cluster FROM e)
SELECT event_type, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM c GROUP BY 1, 2 HAVING count(*) >= 6""",
)
def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13 WIN14: gaps-and-islands against the edge before, clusters of at least six, dealt by ranges of edges."""
    from ..operators import metrics as M

    return M.islands(table(spark, sf_dir, "events"), ["event_type"], "value", 8).where("n >= 6")


@query(
    "SET4_full_scope",
    "SELECT s_nationkey, count(DISTINCT s_suppkey % 3) = 3 AS covers_all FROM supplier GROUP BY 1",
)
def full_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4 SET2: whether a scope covers everything (then it is no scope)."""
    scope = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_set(F.col("s_suppkey") % 3).alias("scope"))
    every = F.array(*[F.lit(x).cast("long") for x in range(3)])
    return scope.select("s_nationkey", (F.size(F.array_except(every, "scope")) == 0).alias("covers_all"))


@query(
    "SNK9_insert_missing",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0",
)
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: insert unless the id exists."""
    from .. import sinks

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return sinks.inserted(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("SNK2_delete", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2 SNK10: documents left after a delete by id."""
    from .. import sinks

    docs, gone = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return sinks.deleted(docs, gone, ["doc_id"])


@query(
    "PRJ4_source_blocks",
    "SELECT item_id, '<source id=\"S' || item_id || '\">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</source>' AS block FROM benchmark",
)
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4 PRJ15: source blocks with escaped text."""
    block = F.concat(F.lit('<source id="S'), F.col("item_id").cast("string"), F.lit('">'), X.escaped(F.col("text")), F.lit("</source>"))
    return table(spark, sf_dir, "benchmark").select("item_id", block.alias("block"))


@query(
    "JSN1_event_props",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
)
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN1 JSN2: fenced or bare JSON replies read under a schema; what does not parse is null."""
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Reply: "), "props", F.lit(" done")))
    return table(spark, sf_dir, "events").select("event_id", lenient_json(wrapped, "k int")["k"].alias("k"))


def lenient_json(reply, schema: str):
    """A JSON object out of a reply: inside a fence, else from the first { to the last }."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braced = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(braced), schema)
