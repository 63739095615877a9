"""Geometry, table cleaning, query expansion, embedding and record blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import embedded, hashed_vectors
from ..operators import chunking as K
from ..operators import layout as L
from ..session import table
from .registry import query

_BOX = "SELECT l_orderkey AS page, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_quantity + 10 AS DOUBLE) AS x1, l_tax * 100 AS y0, l_tax * 100 + l_discount * 100 AS y1 FROM lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as page", "cast(l_quantity as double) as x0", "cast(l_quantity + 10 as double) as x1", "l_tax * 100 as y0", "l_tax * 100 + l_discount * 100 as y1"
    )


@query(
    "SET7_union_area",
    f"""WITH b AS ({_BOX}), e AS (SELECT DISTINCT page, unnest([x0, x1]) AS l FROM b), s AS (SELECT page, l, lead(l) OVER (PARTITION BY page ORDER BY l) AS r FROM e),
c AS (SELECT s.page, l, r, y0, y1, max(y1) OVER (PARTITION BY s.page, l ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s JOIN b ON b.page = s.page AND x0 <= l AND x1 >= r AND y1 > y0)
SELECT page, round(sum(greatest(0, y1 - greatest(y0, coalesce(reach, y0))) * (r - l)), 6) AS area FROM c GROUP BY page""",
)
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET7 PDF1: area that boxes cover together (line items as boxes)."""
    return L.union_area(boxes(spark, sf_dir), "page").withColumn("area", F.round("area", 6))


@query(
    "JN16_words_in_boxes",
    f"WITH b AS ({_BOX}) SELECT o_orderkey AS page, count(*) AS n FROM orders JOIN b ON b.page = o_orderkey AND o_custkey % 50 BETWEEN x0 AND x1 AND o_custkey % 10 BETWEEN y0 AND y1 GROUP BY 1",
)
def words_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16: words inside boxes of their page."""
    words = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 50).alias("x"), (F.col("o_custkey") % 10).alias("y"))
    return L.words_in_boxes(words, boxes(spark, sf_dir), "page").groupBy("page").agg(F.count("*").alias("n"))


@query(
    "STR16_clean_tables",
    "SELECT l_orderkey, '| ' || string_agg(l_returnflag || ' ' || l_linestatus, ' | ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) || ' |' AS line FROM lineitem GROUP BY l_orderkey",
)
def clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR16 AGG36: ragged tables padded, empty rows and columns dropped (one column holds figures, one is empty)."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("cell"))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    ragged = F.concat(F.array(F.array(F.lit(" "))), F.transform("rows", lambda r: F.array(F.lit(""), r["cell"])))
    clean = L.clean_table(ragged)
    return grouped.select("l_orderkey", F.concat(F.lit("| "), F.array_join(F.transform(clean, lambda r: r[0]), " | "), F.lit(" |")).alias("line"))


@query(
    "PDF8_highlighted_rows",
    r"""WITH l AS (SELECT doc_id, pos, list_distinct(regexp_extract_all(lower(line), '[a-z]+')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
s AS (SELECT doc_id, pos, len(list_intersect(w, ['the', 'of', 'and', 'license', 'version'])) AS shared FROM l)
SELECT doc_id, CAST(pos - 1 AS INT) AS pos, CAST(shared AS INT) AS shared FROM s WHERE shared > 0 QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY shared DESC) = 1""",
)
def highlighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF8: lines that share most words with a cited passage."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = lines.select("doc_id", "pos", F.regexp_extract_all(F.lower("line"), F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    cited = F.array(*[F.lit(w) for w in ("the", "of", "and", "license", "version")])
    return L.highlighted_rows(words, "doc_id", "w", cited).select("doc_id", "pos", "shared")


# A few expansion rules.
RULES = {"rev": "revenue", "pat": "profit after tax", "views": "page views", "k": "count"}


@query(
    "STR9_expansion",
    "SELECT event_id, 'views of ' || event_type || CASE WHEN event_type = 'view' THEN ' pat' ELSE '' END || CASE WHEN event_type = 'view' THEN ' profit after tax page views' ELSE ' page views' END AS expanded FROM events",
)
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR9: query expansion by rules, each once."""
    asked = F.concat(F.lit("views of "), F.col("event_type"), F.when(F.col("event_type") == "view", " pat").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", L.expanded_query(asked, RULES).alias("expanded"))


@query("UDF7_embeddings")
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1 UDF7: vectors of all documents by the offline stand-in, through the provider's interface."""
    return table(spark, sf_dir, "documents").select("doc_id", embedded(F.col("text"), lambda: hashed_vectors).alias("vector"))


@query("WIN11_table_pieces")
def table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11: customers' orders as tables, in Markdown pieces of at most 60 estimated tokens with header repeated."""

    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))).alias("rows")
    )

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(names: pd.Series, tables: pd.Series) -> pd.Series:
        head = ["order", "status", "priority"]
        return pd.Series([K.table_pieces(f"Customer {n}", [head, *[list(r) for r in t]], 60) for n, t in zip(names, tables)])

    return rows.select("o_custkey", F.posexplode(pieces("o_custkey", "rows")).alias("piece", "text"))


@query(
    "AGG38_router_variants",
    """WITH t AS (SELECT length(text) % 3 AS y, length(text) % 3 AS a, length(text) % 2 AS b, 0 AS c FROM conversations), u AS (SELECT 'exact' AS variant, y, a AS p FROM t UNION ALL SELECT 'parity', y, b FROM t UNION ALL SELECT 'constant', y, c FROM t)
SELECT variant, count(*) AS n, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM u GROUP BY variant""",
)
def router_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG38: routers side by side."""
    size = F.length("text")
    rows = table(spark, sf_dir, "conversations").select((size % 3).alias("y"), (size % 3).alias("exact"), (size % 2).alias("parity"), F.lit(0).alias("constant"))
    long = rows.unpivot(["y"], ["exact", "parity", "constant"], "variant", "p")
    return long.groupBy("variant").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


@query(
    "JN17_judged_parts",
    "SELECT doc_id, part, verdict FROM (SELECT doc_id, 'quality' AS part, quality AS verdict FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE verdict IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents)",
)
def judged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17: record and part for every verdict."""
    parts = table(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "part", "verdict").where("verdict is not null")
    return parts.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


@query("PRJ10_document_labels", r"SELECT page_id, left(regexp_replace(url, '[\x00-\x1F]', '', 'g'), 40) || CASE WHEN page_id % 4 = 0 THEN ' (not ready)' ELSE '' END AS label FROM pages")
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10: labels for the router, control characters stripped and cut."""
    plain = F.left(F.regexp_replace("url", r"[\x00-\x1F]", ""), F.lit(40))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(plain, F.when(F.col("page_id") % 4 == 0, " (not ready)").otherwise("")).alias("label"))


@query(
    "PRJ12_content_rows",
    "SELECT conv_id, count(*) FILTER (role = 'assistant') AS answered, string_agg(CASE WHEN role = 'assistant' THEN left(text, 20) END, '|' ORDER BY turn) AS kept FROM conversations GROUP BY conv_id",
)
def content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12 PRJ14 SNK7: content rows keep answered sections only."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.left("text", F.lit(20)).alias("text")))).alias("sections"))
    answered = F.filter("sections", lambda s: s["role"] == "assistant")
    kept = F.when(F.size(answered) > 0, F.array_join(F.transform(answered, lambda s: s["text"]), "|"))
    return turns.select("conv_id", F.size(answered).cast("long").alias("answered"), kept.alias("kept"))
