"""Run records, catalog rows, projections and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import figures as N
from ..functions import text as X
from ..operators import catalog as C
from ..operators import chunking as K
from ..operators.metrics import ratio
from ..session import table
from .registry import query
from .requests import _LOG, request_log


@query(
    "SRC7_run_log",
    """SELECT event_id % 500 AS id, max(event_id) AS line, CAST(max_by(json_extract_string(props, '$.k'), event_id) AS INT) AS k FROM events WHERE event_id % 13 <> 0 GROUP BY 1""",
)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: a log of JSON lines in which some are torn: those go, and the last line of each id wins."""
    line = F.when(F.col("event_id") % 13 == 0, F.left("props", F.lit(5))).otherwise(F.col("props"))
    parsed = table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.from_json(line, "k int")["k"].alias("k"))
    good = parsed.where("k is not null").withColumn("id", F.col("line") % 500)
    return good.groupBy("id").agg(F.max("line").alias("line"), F.max_by("k", "line").alias("k"))


@query(
    "SRC10_label_sheet",
    "SELECT doc_id, CASE quality WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS verdict FROM documents LEFT JOIN labels USING (doc_id)",
)
def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10 SNK5: verdicts as a sheet writes them (yes, no, blank), read back."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sheet = rows.select("doc_id", F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "0").otherwise("").alias("cell"))
    cell = F.lower(F.trim("cell"))
    return sheet.select("doc_id", F.when(cell.isin("yes", "y", "1", "true"), True).when(cell.isin("no", "n", "0", "false"), False).alias("verdict"))


@query(
    "SNK5_sheet_rows",
    "SELECT source, left(string_agg(left(text, 700), ' | ' ORDER BY doc_id), 2200) AS cell FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 4) GROUP BY source",
)
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: up to four sources of 700 characters in a cell of 2,200 (limits of the sheet)."""
    order = Window.partitionBy("source").orderBy("doc_id")
    first = table(spark, sf_dir, "documents").withColumn("r", F.row_number().over(order)).where("r <= 4")
    cells = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.left("text", F.lit(700)).alias("t")))).alias("c"))
    return cells.select("source", F.left(F.array_join(F.transform("c", lambda x: x["t"]), " | "), F.lit(2200)).alias("cell"))


@query("FLT2_allow_list", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2: documents of an allow-list."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("FLT10_rewrite_accepted", r"""WITH t AS (SELECT conv_id, turn, text AS a, left(text, 40) AS b FROM conversations)
SELECT conv_id, turn, length(trim(b)) > 0 AND length(b) <= 500 AND length(b) <= 3 * length(a) + 120 AND len(list_filter(regexp_extract_all(b, '\d+'), lambda n: NOT list_contains(regexp_extract_all(a, '\d+'), n))) = 0 AS accepted FROM t""")
def rewrite_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10 LLM2: a rewrite is kept when it is not empty, not too long and names no new number."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.left("text", F.lit(40)).alias("b"))
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    fits = (F.length(F.trim("b")) > 0) & (F.length("b") <= 500) & (F.length("b") <= 3 * F.length("a") + 120)
    return rows.select("conv_id", "turn", (fits & (F.size(F.array_except(digits(F.col("b")), digits(F.col("a")))) == 0)).alias("accepted"))


@query("FLT11_infra_errors", f"WITH {_LOG} SELECT route, count(*) FILTER (status <> 'error' OR rate_limited = 0) AS kept, count(*) FILTER (status = 'error' AND rate_limited > 0) AS infra FROM r GROUP BY route")
def infra_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11: rows that failed for outside reasons are counted apart."""
    infra = (F.col("status") == "error") & (F.col("rate_limited") > 0)
    return request_log(spark, sf_dir).groupBy("route").agg(F.count_if(~infra).alias("kept"), F.count_if(infra).alias("infra"))


@query("FLT15_outdated", "SELECT doc_id FROM documents WHERE coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id % 8 END, 0) < 6")
def outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT15: documents ingested by an older version, or by none."""
    version = F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 8)
    return table(spark, sf_dir, "documents").where(F.coalesce(version, F.lit(0)) < 6).select("doc_id")


@query("PRJ6_notices", f"""WITH {_LOG} SELECT trace_id, array_to_string(list_filter([CASE WHEN number_check = 'fail' THEN 'numbers' END, CASE WHEN citations_valid = 0 THEN 'citations' END, CASE WHEN router_ok = 0 THEN 'router' END], lambda x: x IS NOT NULL), ';') AS notices FROM r""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6 PRJ11: warnings of a section."""
    c = F.col
    every = F.array_compact(F.array(F.when(c("number_check") == "fail", "numbers"), F.when(c("citations_valid") == 0, "citations"), F.when(c("router_ok") == 0, "router")))
    return request_log(spark, sf_dir).select("trace_id", F.array_join(every, ";").alias("notices"))


@query("PRJ7_progress", "SELECT doc_id, least(greatest((doc_id % 120) / 100.0, 0), 1) AS progress, CASE WHEN length(source) > 4 THEN left(source, 3) || '…' ELSE source END AS label FROM documents")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ7: progress and labels for display."""
    share = F.least(F.greatest(F.col("doc_id") % 120 / 100.0, F.lit(0.0)), F.lit(1.0))
    label = F.when(F.length("source") > 4, F.concat(F.left("source", F.lit(3)), F.lit("…"))).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", share.alias("progress"), label.alias("label"))


@query("PRJ9_stored_or_guessed", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END), ''), p_type) AS company FROM part")
def stored_or_guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ9: a stored value wins over a guess, a blank one does not."""
    stored = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif(F.trim(stored), F.lit("")), F.col("p_type")).alias("company"))


@query("STR6_file_titles", r"SELECT page_id, trim(regexp_replace('Annual_Report__' || page_id || ' v2', '[_\s]+', ' ', 'g')) AS title FROM pages")
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6: titles from file names."""
    name = F.concat(F.lit("Annual_Report__"), F.col("page_id").cast("string"), F.lit(" v2.pdf"))
    return table(spark, sf_dir, "pages").select("page_id", X.file_title(name).alias("title"))


@query("STR10_spellings", "SELECT DISTINCT right(CAST(year(o_orderdate) AS VARCHAR), 2) AS y, 'FY20' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS long_name, 'FY 20' || lpad(CAST((CAST(right(CAST(year(o_orderdate) AS VARCHAR), 2) AS INT) + 99) % 100 AS VARCHAR), 2, '0') || '-' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS span FROM orders")
def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10 STR9: other spellings of fiscal years."""
    years = table(spark, sf_dir, "orders").select(F.right(F.year("o_orderdate").cast("string"), F.lit(2)).alias("y")).distinct()
    both = C.spellings(F.concat(F.lit("FY"), F.col("y")))
    return years.select("y", both[0].alias("long_name"), both[1].alias("span"))


@query("JN7_latest_ready", "SELECT source, max(doc_id) FILTER (n_chars > 500) AS latest, CASE WHEN max(doc_id) FILTER (n_chars > 500) IS NULL THEN 'not ready' END AS problem FROM documents GROUP BY source")
def latest_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7: the latest ready document of each name, else the problem."""
    latest = F.max(F.when(F.col("n_chars") > 500, F.col("doc_id")))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(latest.alias("latest"))
    return rows.withColumn("problem", F.when(F.col("latest").isNull(), "not ready"))


@query("JN15_current_records", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND (doc_id % 3 <> 0 OR lang IS NULL)")
def current_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15: records whose question is unchanged, by id and row hash; in the older version, some texts carry their language."""
    docs = table(spark, sf_dir, "documents")
    before = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.coalesce(F.concat(F.lit(" "), "lang"), F.lit("")))).otherwise(F.col("text"))
    records = docs.select("doc_id", F.sha2(before, 256).alias("row_hash"))
    return records.join(docs.select("doc_id", F.sha2("text", 256).alias("row_hash")), ["doc_id", "row_hash"]).select("doc_id")


@query("AGG9_ingest_speed", """WITH p AS (SELECT source, round(sum(n_chars) / 1000.0 / count(*), 3) AS per_page, sum(n_chars) / 1000.0 AS secs, count(*) AS pages FROM documents GROUP BY source)
SELECT round(median(per_page), 6) AS median_per_page, round(sum(per_page * pages) / sum(pages), 6) AS pooled FROM p""")
def ingest_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9: seconds per page, median and pooled, over values rounded per document first."""
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.sum("n_chars") / 1000.0 / F.count("*"), 3).alias("per_page"), F.count("*").alias("pages"))
    pooled = F.sum(F.col("per_page") * F.col("pages")) / F.sum("pages")
    return per.agg(F.round(F.median("per_page"), 6).alias("median_per_page"), F.round(pooled, 6).alias("pooled"))


@query("AGG28_token_block", f"WITH {_LOG}, u AS (SELECT route, 'in' AS kind, tokens_in AS n FROM r UNION ALL SELECT route, 'out', tokens_out FROM r) SELECT route, kind, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean FROM u GROUP BY 1, 2")
def token_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG28 AGG43 MAP1: token sums and means by part and kind."""
    rows = request_log(spark, sf_dir).select("route", F.col("tokens_in").alias("in"), F.col("tokens_out").alias("out"))
    return rows.unpivot(["route"], ["in", "out"], "kind", "n").groupBy("route", "kind").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"))


@query("AGG41_drift_block", f"WITH {_LOG} SELECT route, status, count(*) AS n FROM r GROUP BY CUBE (route, status)")
def drift_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG41: requests by route and status with all totals."""
    return request_log(spark, sf_dir).cube("route", "status").agg(F.count("*").alias("n"))


@query("AGG16_route_distance", "WITH s AS (SELECT source, lang, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source) AS p FROM documents GROUP BY 1, 2), o AS (SELECT lang, count(*) * 1.0 / sum(count(*)) OVER () AS q FROM documents GROUP BY 1), g AS (SELECT DISTINCT source FROM documents) SELECT g.source, round(sum(abs(coalesce(p, 0) - q)) / 2, 6) AS distance FROM g CROSS JOIN o LEFT JOIN s ON s.source = g.source AND s.lang = o.lang GROUP BY g.source")
def mix_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16: total variation of each source's languages from the whole."""
    docs = table(spark, sf_dir, "documents")
    pairs = docs.groupBy("source", "lang").agg(F.count("*").alias("n"))
    own = pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    whole = pairs.groupBy("lang").agg(F.sum("n").alias("n"))
    whole = whole.crossJoin(whole.agg(F.sum("n").alias("all"))).select("lang", (F.col("n") / F.col("all")).alias("q"))
    # languages and sources are group keys of a summed table, one row each
    grid = pairs.select("source").distinct().crossJoin(F.broadcast(whole))
    both = grid.join(own.select("source", "lang", "p"), ["source", "lang"], "left").na.fill(0.0, ["p"])
    return both.groupBy("source").agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 6).alias("distance"))


@query("WIN12_anchored_rows", """WITH RECURSIVE y AS (SELECT l_orderkey AS page, CAST(l_quantity AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem)),
w AS (SELECT page, y, i, y AS anchor, 1 AS row_no FROM y WHERE i = 1 UNION ALL SELECT y.page, y.y, y.i, CASE WHEN y.y - w.anchor > 3 THEN y.y ELSE w.anchor END, CASE WHEN y.y - w.anchor > 3 THEN w.row_no + 1 ELSE w.row_no END FROM w JOIN y ON y.page = w.page AND y.i = w.i + 1)
SELECT page, max(row_no) AS n_rows FROM w GROUP BY page""")
def row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: rows of words by distance from the row's anchor (line items' quantities as heights)."""
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y"))
    return K.anchored_rows(words, "page", "y").groupBy("page").agg(F.max("row_no").alias("n_rows"))


@query("WIN15_subtotals", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running, abs(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) - l_quantity) <= 0.5 AS is_subtotal FROM lineitem")
def subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN15: rows that equal the sum of the rows above."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    above = F.sum("l_quantity").over(order.rowsBetween(-2, -1))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"),
        (F.abs(above - F.col("l_quantity")) <= 0.5).alias("is_subtotal"),
    )


@query("WIN16_primary_citation", "SELECT o_custkey, arg_min(o_orderkey, (-length(o_orderpriority), o_orderkey)) AS primary_key FROM orders GROUP BY o_custkey")
def primary_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN16: the row with most terms, the first on ties."""
    rank = F.struct(F.length("o_orderpriority").alias("n"), (-F.col("o_orderkey")).alias("first"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("best")).select("o_custkey", (-F.col("best.first")).alias("primary_key"))


@query("WIN17_capped_listing", "WITH r AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_name) || CASE WHEN max(n) > 3 THEN ' … and ' || (max(n) - 3) || ' more' ELSE '' END AS listing FROM r WHERE r <= 3 GROUP BY s_nationkey")
def capped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN17: three names and how many more (a listing)."""
    order = Window.partitionBy("s_nationkey").orderBy("s_name")
    rows = table(spark, sf_dir, "supplier").withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("s_nationkey")))
    names = rows.where("r <= 3").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), ", ").alias("names"), F.max("n").alias("n"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" … and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return names.select("s_nationkey", F.concat("names", more).alias("listing"))


@query("TOP8_failures", f"WITH {_LOG} SELECT trace_id, route FROM r WHERE status = 'error' ORDER BY trace_id LIMIT 15")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP8: the first fifteen failures (a report)."""
    return request_log(spark, sf_dir).where("status = 'error'").select("trace_id", "route").orderBy("trace_id").limit(15)


@query("SET6_failure_union", f"WITH {_LOG} SELECT why, count(*) AS n FROM (SELECT 'refused' AS why FROM r WHERE status = 'abstained' UNION ALL SELECT 'failed' FROM documents WHERE n_chars < 50) GROUP BY why")
def failure_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET6: failures of two sources together."""
    refused = request_log(spark, sf_dir).where("status = 'abstained'").select(F.lit("refused").alias("why"))
    failed = table(spark, sf_dir, "documents").where("n_chars < 50").select(F.lit("failed").alias("why"))
    return refused.unionAll(failed).groupBy("why").agg(F.count("*").alias("n"))


@query("SET3_word_overlap", r"SELECT item_id, len(list_intersect(regexp_extract_all(lower(text), '[a-z]+'), ['the', 'of', 'and', 'que', 'der'])) AS shared FROM benchmark")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3: size of an intersection of word sets."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    fixed = F.array(*[F.lit(w) for w in ("the", "of", "and", "que", "der")])
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(F.array_intersect(words, fixed)).cast("long").alias("shared"))


@query("NUM6_equal_figures", "SELECT p_partkey, p_size = p_partkey % 50 OR p_size * 1000 = p_partkey % 50 * 1.0 AS equal FROM part")
def equal_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM6 NUM7: figures equal as printed or in value with a scale word."""
    claim = F.col("p_partkey") % 50
    same = N.equal_figures(F.col("p_size"), F.lit(3), claim, F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", same.alias("equal"))


@query("NUM8_negatives", "SELECT c_custkey, CAST(round(c_acctbal, 2) AS DOUBLE) AS value FROM customer")
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM8: parenthesised negatives and nil dashes read as numbers."""
    plain = F.format_number(F.abs("c_acctbal"), 2)
    printed = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(plain)
    bare = F.regexp_replace(printed, r"[(),]", "")
    value = F.when(printed.rlike(r"^\(.*\)$"), -bare.try_cast("double")).when(printed.isin("-", "–", "—"), 0.0).otherwise(bare.try_cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))


@query("CLS1_failure_reasons", "SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'rate_limited' ELSE 'other' END AS reason FROM events")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS1 CLS4: reasons of failures from their messages."""
    kind = F.col("event_type")
    message = F.lower(F.when(kind == "error", "Read timed out").when(kind == "click", "HTTP 429 Too Many Requests").otherwise("unknown"))
    reason = F.when(message.like("%timed out%"), "timeout").when(message.like("%429%"), "rate_limited").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query("LLM6_judge_plan", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'run' WHEN quality IS NULL THEN 'judge' ELSE 'skip' END AS step FROM documents d LEFT JOIN labels l USING (doc_id)")
def judge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM6: what is left to do for each record."""
    known = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("known").isNull(), "run").when(F.col("quality").isNull(), "judge").otherwise("skip").alias("step"))


@query("AGG40_latency_share", f"WITH {_LOG} SELECT user_id, count(*) FILTER (t_total_ms > 1000 AND status = 'answered') * 1.0 / nullif(count(*) FILTER (status = 'answered'), 0) AS slow_share FROM r GROUP BY user_id")
def slow_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG40 AGG7: share of slow answers per user, null without answers."""
    answered = F.col("status") == "answered"
    return request_log(spark, sf_dir).groupBy("user_id").agg(ratio((F.col("t_total_ms") > 1000), answered).alias("slow_share"))


@query("STR8_headings", "SELECT doc_id, CASE WHEN starts_with(lower(text), lower(left(text, 4))) AND doc_id % 2 = 0 THEN length(text) ELSE length(text) + length(source) + 2 END AS n FROM documents")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8: a heading stands before a text unless the text begins with it."""
    heading = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(4))).otherwise(F.col("source"))
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    full = F.when(F.startswith(norm(F.col("text")), norm(heading)), F.col("text")).otherwise(F.concat(heading, F.lit("\n\n"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(full).cast("long").alias("n"))


@query("STR13_filled_prompts", "SELECT conv_id, turn, 'Role: ' || role || ' / {role} asks' AS prompt FROM conversations")
def filled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13: a template filled in one pass: what a value holds is not filled again."""
    template = "Role: {role} / {rest}"
    values = {"role": F.col("role"), "rest": F.lit("{role} asks")}
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(*parts, F.lit(rest)).alias("prompt"))


@query("STR14_highlight_terms", r"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda t: length(t) >= 3)))::INT AS n_terms FROM documents")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR14: figures to highlight as printed, bare ones of three digits or more."""
    runs = F.regexp_extract_all("text", F.lit(f"({N.NUMBER})"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.filter(runs, lambda t: F.length(t) >= 3))).alias("n_terms"))


@query("FLT5_reply_gate", "SELECT event_id, CASE WHEN value < 10 THEN 'low_score' WHEN event_id % 3 = 0 THEN 'insufficient' WHEN event_id % 4 = 0 THEN 'no_valid_citations' END AS reason FROM events")
def reply_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5 FLT7: the first gate that stops an answer."""
    from ..operators.answers import abstain_reason

    c = F.col
    cited = F.when(c("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("S1")))
    reason = abstain_reason(F.lit(False), c("value") / 40, F.lit(True), c("event_id") % 3 == 0, cited)
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query("FLT18_numeric_applies", f"WITH {_LOG} SELECT trace_id, route <> 'GENERAL' AND number_check IN ('pass', 'fail') AS applies FROM r WHERE number_check IS NOT NULL")
def numeric_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18: whether a numeric match is asked of a record."""
    log = request_log(spark, sf_dir).where("number_check is not null")
    return log.select("trace_id", ((F.col("route") != "GENERAL") & F.col("number_check").isin("pass", "fail")).alias("applies"))


@query("PRJ8_examples", "SELECT source, 'What does ' || source || ' say in ' || max(lang) || '?' AS example FROM documents GROUP BY source")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ8: an example question per company, of its latest period."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("lang").alias("latest"))
    return rows.select("source", F.format_string("What does %s say in %s?", "source", "latest").alias("example"))


@query("PRJ13_error_rows", f"WITH {_LOG} SELECT trace_id, 'error' AS status, 'crashed' AS error FROM r WHERE status = 'error' UNION ALL SELECT page_id, 'refused', 'too_long' FROM pages WHERE length(html) > 5000")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ13: rows for crashed requests and refused uploads."""
    crashed = request_log(spark, sf_dir).where("status = 'error'").select("trace_id", F.lit("error").alias("status"), F.lit("crashed").alias("error"))
    refused = table(spark, sf_dir, "pages").where(F.length("html") > 5000)
    return crashed.unionAll(refused.select(F.col("page_id").alias("trace_id"), F.lit("refused").alias("status"), F.lit("too_long").alias("error")))


@query("STM4_cancelled", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 = 0)")
def cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM4: pages whose document has no tombstone."""
    tombs = table(spark, sf_dir, "documents").where("doc_id % 9 = 0").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").join(tombs, "page_id", "left_anti").select("page_id")
