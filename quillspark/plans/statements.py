"""Queries on statement tables, recursive splitting and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import figures as N
from ..operators import splitting, statements
from ..session import table
from .registry import query
from .retrieval import estimate_sql

# An order as a statement: its lines are items, a heading stands before each run of one return flag, and after a run a figure: that
# of the run, that of all lines so far, or one that no section gives.
_ROWS_SQL = """
l AS (SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_returnflag AS f, l_quantity AS q, l_discount AS d FROM lineitem),
m AS (SELECT *, coalesce(lag(f) OVER w, '') <> f AS opens, coalesce(lead(f) OVER w, '') <> f AS closes, sum(q) OVER (PARTITION BY t ORDER BY n) AS upto FROM l WINDOW w AS (PARTITION BY t ORDER BY n)),
g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY n) AS run FROM m),
h AS (SELECT *, sum(q) OVER (PARTITION BY t, run) AS whole FROM g),
r AS (SELECT t, n * 3 + 1 AS pos, 'item' AS kind, 'line' AS label, q AS v FROM h UNION ALL SELECT t, n * 3, 'heading', 'flag ' || f, NULL FROM h WHERE opens
  UNION ALL SELECT t, n * 3 + 2, 'figure', NULL, CASE WHEN d < 0.05 THEN whole WHEN d < 0.08 THEN upto ELSE whole + 0.5 END FROM h WHERE closes AND d > 0.01)
"""


@query(
    "WIN15_named_subtotals",
    f"""WITH {_ROWS_SQL},
fig AS (SELECT *, (SELECT coalesce(max(p.pos), -1) FROM r p WHERE p.t = r.t AND p.kind = 'figure' AND p.pos < r.pos) AS after FROM r WHERE kind = 'figure'),
c AS (SELECT fig.t, fig.pos, hd.pos AS head, hd.label, sum(i.v) AS total, fig.v FROM fig JOIN r hd ON hd.t = fig.t AND hd.kind = 'heading' AND hd.pos < fig.pos AND hd.pos > fig.after
  JOIN r i ON i.t = fig.t AND i.kind = 'item' AND i.pos > hd.pos AND i.pos < fig.pos GROUP BY ALL),
b AS (SELECT t, pos, arg_max(label, head) AS label FROM c WHERE abs(total - v) <= greatest(0.015, abs(v) * 1e-6) AND total <> 0 GROUP BY t, pos)
SELECT fig.t AS table_id, fig.pos, fig.v AS value, coalesce(b.label || ' (subtotal)', 'Subtotal') AS name FROM fig LEFT JOIN b ON b.t = fig.t AND b.pos = fig.pos""",
)
def named_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN15: figures after the sections of every order, named after the heading from which on the lines add up to them."""
    order = Window.partitionBy("t").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), "l_extendedprice", F.col("l_returnflag").alias("f"), F.col("l_discount").alias("d"))
    by_n = Window.partitionBy("t").orderBy("n")
    lines = lines.withColumn("n", F.row_number().over(order))
    lines = lines.withColumns({
        "opens": F.coalesce(F.lag("f").over(by_n), F.lit("")) != F.col("f"), "closes": F.coalesce(F.lead("f").over(by_n), F.lit("")) != F.col("f"), "upto": F.sum("q").over(by_n),
    })
    lines = lines.withColumn("run", F.sum(F.col("opens").cast("int")).over(by_n)).withColumn("whole", F.sum("q").over(Window.partitionBy("t", "run")))
    figure = F.when(F.col("d") < 0.05, F.col("whole")).when(F.col("d") < 0.08, F.col("upto")).otherwise(F.col("whole") + 0.5)
    row = lambda shift, kind, label, value: F.struct((F.col("n") * 3 + shift).cast("long").alias("pos"), F.lit(kind).alias("kind"), label.alias("label"), value.alias("value"))
    none = F.lit(None)
    rows = F.array_compact(F.array(
        row(1, "item", F.lit("line"), F.col("q")), F.when(F.col("opens"), row(0, "heading", F.concat(F.lit("flag "), "f"), none.cast("double"))),
        F.when(F.col("closes") & (F.col("d") > 0.01), row(2, "figure", none.cast("string"), figure)),
    ))
    return statements.named_subtotals(lines.select(F.col("t").alias("table_id"), F.explode(rows).alias("r")).select("table_id", "r.*"))


@query(
    "PDF6_rebuilt_tables",
    """WITH l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_returnflag, l_linestatus,
  CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, printf('%.2f', l_extendedprice) AS p FROM lineitem),
k AS (SELECT page, count(*) AS lines FROM l GROUP BY page)
SELECT page, CAST(n + 1 AS INT) AS "row", 'Line ' || l_returnflag || ' ' || l_linestatus AS label, c AS col, CASE c WHEN 1 THEN 'Quantity sold' ELSE 'Price' END AS header, CASE c WHEN 1 THEN q ELSE p END AS amount
FROM l JOIN k USING (page), (SELECT unnest([1, 2]) AS c) WHERE lines BETWEEN 2 AND 5""",
)
def rebuilt_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF6: every order set as words on a page (right-aligned amounts, headers above, a label of three words a line; orders of over
    five lines have a paragraph of prose as well), and the tables read back from the words' boxes. Orders of one line show no column."""
    order = Window.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("page", F.col("l_orderkey")).withColumn("n", F.row_number().over(order)).withColumn("lines", F.count("*").over(Window.partitionBy("page")))

    def word(x0, text, y=None):
        text = F.lit(text) if isinstance(text, str) else text
        x0 = F.lit(float(x0)) if not hasattr(x0, "alias") else x0
        return F.struct(x0.cast("double").alias("x0"), (x0 + 5.0 * F.length(text)).cast("double").alias("x1"), (F.col("n") * 12.0 if y is None else F.lit(float(y))).alias("y"), text.alias("text"))

    def right(edge, text):
        return word(F.lit(float(edge)) - 5.0 * F.length(text), text)

    quantity, price = F.col("l_quantity").cast("int").cast("string"), F.format_string("%.2f", F.col("l_extendedprice"))
    body = F.array(word(0, "Line"), word(25, F.col("l_returnflag")), word(35, F.col("l_linestatus")), right(160, quantity), right(260, price))
    head = F.array(word(120, "Quantity", 0), word(141, "sold", 1.5), word(235, "Price", 0))
    prose = F.transform(F.sequence(F.lit(1), F.col("lines") * 9), lambda i: F.struct((i * 7.0).alias("x0"), (i * 7.0 + 5).alias("x1"), F.lit(900.0).alias("y"), F.lit("prose").alias("text")))
    words = F.when(F.col("n") == 1, F.concat(head, body, F.when(F.col("lines") > 5, prose).otherwise(F.filter(prose, lambda w: F.lit(False))))).otherwise(body)
    return statements.rebuilt_tables(lines.select("page", F.explode(words).alias("w")).select("page", "w.*"))


@query(
    "STR3_recursive_split",
    rf"""WITH RECURSIVE p(doc_id, path, level, text) AS (
SELECT doc_id, CAST([] AS INT[]), 0, text FROM documents WHERE text IS NOT NULL
UNION ALL
SELECT doc_id, list_append(path, CAST(i AS INT)), level + 1, parts[i + 1] FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT doc_id, path, level, CASE
  WHEN level < 3 THEN list_filter(list_transform(CASE level WHEN 0 THEN regexp_split_to_array(text, '\n\s*\n') WHEN 1 THEN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))
    ELSE regexp_split_to_array(text, '\s+') END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')
  ELSE [left(text, length(text) // 2), substr(text, length(text) // 2 + 1)] END AS parts FROM p WHERE level = 0 OR ({estimate_sql("text")} > 8 AND length(text) >= 2)))),
d AS (SELECT *, {estimate_sql("text")} AS tokens FROM p WHERE level > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS BIGINT) AS piece, text, tokens FROM d WHERE tokens <= 8 OR length(text) < 2""",
)
def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: all documents in pieces of at most eight estimated tokens, split only where needed."""
    return splitting.split_recursively(table(spark, sf_dir, "documents"), 8)


@query(
    "JN11_ratios",
    """WITH o AS (SELECT DISTINCT l_orderkey AS g, CAST(l_quantity AS DECIMAL(18, 6)) AS v FROM lineitem),
c AS (SELECT o_orderkey AS g, round(CAST(o_totalprice AS DECIMAL(18, 2)) / 2000, d) AS claim, d FROM orders, (SELECT unnest([0, 1]) AS d)),
p AS (SELECT c.g, claim, d, a.v AS a, b.v AS b FROM c JOIN o a ON a.g = c.g JOIN o b ON b.g = c.g WHERE claim <> 0),
e AS (SELECT *, unnest([a, a - b, b - a]) AS part FROM p)
SELECT DISTINCT g AS grp, CAST(claim AS DOUBLE) AS claim, CAST(d AS INT) AS decimals FROM e WHERE part >= 0 AND floor(CAST(part AS DOUBLE) * 100 * pow(10, d) / b + 0.5 + 1e-9) = round(claim * pow(10, d))""",
)
def derived_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: percentages claimed of orders that are a share, growth or decline of two of their quantities."""
    operands = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_quantity").cast("decimal(24,6)").alias("value")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grp"), (F.col("o_totalprice").cast("decimal(18,2)") / 2000).alias("c"))
    claimed = orders.select("grp", F.explode(F.array(*[F.struct(F.round("c", d).cast("decimal(24,6)").alias("claim"), F.lit(d).alias("decimals")) for d in (0, 1)])).alias("x")).select("grp", "x.*")
    return N.ratios(claimed.where("claim <> 0"), operands, "grp").select("grp", F.col("claim").cast("double").alias("claim"), "decimals")


# Orders of each customer as pieces of a table, greedily filled.
_PIECES_SQL = f"""r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, o_orderpriority) AS n,
  '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS line, 'Customer ' || o_custkey || chr(10) || '| order | status | priority |' || chr(10) || '| --- | --- | --- |' AS head FROM orders),
c AS (SELECT *, {estimate_sql("line")} AS cost, 60 - {estimate_sql("head")} AS room FROM r),
w AS (SELECT o_custkey, n, line, head, 0 AS piece, cost AS used FROM c WHERE n = 1
  UNION ALL SELECT c.o_custkey, c.n, c.line, c.head, CASE WHEN w.used + c.cost > c.room THEN w.piece + 1 ELSE w.piece END, CASE WHEN w.used + c.cost > c.room THEN c.cost ELSE w.used + c.cost END
  FROM w JOIN c ON c.o_custkey = w.o_custkey AND c.n = w.n + 1),
pieces AS (SELECT o_custkey AS key, piece, head || chr(10) || string_agg(line, chr(10) ORDER BY n) AS text FROM w GROUP BY o_custkey, piece, head)"""


@query("UDTF1_streamed_pieces", f"WITH RECURSIVE {_PIECES_SQL} SELECT key, piece, text FROM pieces")
def streamed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDTF1 WIN11: customers' orders in Markdown pieces by a table function that is handed each table's rows in order."""
    from ..operators import chunking as K

    K.register_table_pieces(spark)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.concat(F.lit("Customer "), "o_custkey").alias("title"), F.array(F.lit("order"), F.lit("status"), F.lit("priority")).alias("header"),
        F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("cells"), "o_orderkey",
    )
    return spark.sql("SELECT * FROM table_pieces(TABLE(SELECT * FROM {rows}) PARTITION BY key ORDER BY (o_orderkey, cells), 60)", rows=rows)


@query(
    "WIN7_table_siblings",
    f"""WITH RECURSIVE {_PIECES_SQL},
t AS (SELECT key * 1000 + piece AS id, key, piece, {estimate_sql("text")} AS tokens FROM pieces),
v AS (SELECT key, piece, tokens AS used, TRUE AS taken, id FROM t WHERE piece = 0
  UNION ALL SELECT t.key, t.piece, CASE WHEN v.used + t.tokens <= 170 THEN v.used + t.tokens ELSE v.used END, v.used + t.tokens <= 170, t.id FROM v JOIN t ON t.key = v.key AND t.piece = v.piece + 1)
SELECT key, id AS chunk_id, CAST(row_number() OVER (PARTITION BY key ORDER BY piece) AS BIGINT) AS place FROM v WHERE taken""",
)
def siblings_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7 UDF5 JN5: the first piece of every customer's table, and of its other pieces (same table by document, page, title and
    header) those that fit the room left of 170 tokens, in order."""
    from ..functions.text import token_estimate
    from ..operators import retrieval as R
    from ..tables import saved

    pieces = saved(streamed_pieces(spark, sf_dir))
    chunks = pieces.select((F.col("key") * 1000 + F.col("piece")).alias("chunk_id"), F.col("key").alias("doc_id"), F.lit(1).alias("page"), F.lit("table").alias("source_kind"), "text", "piece")
    sized = chunks.select("chunk_id", token_estimate(F.col("text")).alias("tokens"))
    kept = chunks.where("piece = 0").join(sized, "chunk_id").select(F.col("doc_id").alias("key"), "chunk_id", F.lit(1).alias("rank"), "tokens")
    siblings = R.table_siblings(chunks.drop("piece")).join(sized.select(F.col("chunk_id").alias("sibling_id"), F.col("tokens").alias("sibling_tokens")), "sibling_id")
    return R.with_siblings(kept, siblings, "key", "chunk_id", 170).select("key", "chunk_id", F.col("place").cast("long").alias("place"))
