"""Queries of single operators: rank lists, sets, percentiles, evaluation blocks, small rules, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import metrics as M
from ..operators import retrieval as R
from ..session import table
from ..tables import saved
from .registry import query
from .retrieval import BM25_SQL, LENGTH_SQL, fused_lists, lexical, terms_sql


@query("JN2_term_postings", f"WITH {BM25_SQL} SELECT item_id, doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_places FROM q JOIN p USING (term) GROUP BY 1, 2")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: query terms joined with the postings of the documents."""
    from ..functions.text import search_terms

    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(search_terms(F.col("text")))).alias("term"))
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(search_terms(F.col("text"))).alias("term"))
    postings = words.join(R.small(asked.select("term").distinct()), "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return postings.join(R.small(asked), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_places"))


@query("TOP1_lexical_top", f"WITH {BM25_SQL} SELECT item_id, doc_id, CAST(rank AS BIGINT) AS place FROM lex WHERE rank <= 10")
def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP1: the ten best keyword hits of each item, ties by document."""
    return lexical(spark, sf_dir).where("rank <= 10").select("item_id", "doc_id", F.col("rank").cast("long").alias("place"))


@query("TOP3_fused_order", f"WITH {BM25_SQL}, {LENGTH_SQL} SELECT item_id, string_agg(doc_id, ',' ORDER BY rank) AS docs FROM fused WHERE rank <= 8 GROUP BY item_id")
def fused_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP3 in fused order: the first eight documents of each item."""
    top = fused_lists(spark, sf_dir)[1].where("rank <= 8")
    lists = top.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("l"))
    return lists.select("item_id", F.array_join(F.transform("l", lambda x: x["doc_id"].cast("string")), ",").alias("docs"))


@query(
    "SET1_union_of_lists",
    f"WITH {BM25_SQL}, {LENGTH_SQL}, u AS (SELECT item_id, doc_id FROM lex WHERE rank <= 20 UNION SELECT item_id, doc_id FROM byl WHERE rank <= 20) SELECT item_id, count(*) AS n FROM u GROUP BY item_id",
)
def union_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: ids of two ranked lists together, each once."""
    lex = saved(lexical(spark, sf_dir))
    sizes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    order = Window.partitionBy("item_id").orderBy("n_chars", "doc_id")
    by_length = lex.select("item_id", "doc_id").join(sizes, "doc_id").withColumn("rank", F.row_number().over(order))
    both = lex.where("rank <= 20").select("item_id", "doc_id").union(by_length.where("rank <= 20").select("item_id", "doc_id")).distinct()
    return both.groupBy("item_id").agg(F.count("*").alias("n"))


@query("JN3_both_ranks", f"WITH {BM25_SQL}, {LENGTH_SQL} SELECT item_id, doc_id, CAST(l.rank AS BIGINT) AS lexical_rank, CAST(y.rank AS BIGINT) AS other_rank FROM (SELECT * FROM lex WHERE rank <= 20) l FULL JOIN (SELECT * FROM byl WHERE rank <= 20) y USING (item_id, doc_id)")
def both_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: two ranked lists joined by id, each rank null where its list lacks the id."""
    lex = saved(lexical(spark, sf_dir))
    sizes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    order = Window.partitionBy("item_id").orderBy("n_chars", "doc_id")
    other = lex.select("item_id", "doc_id").join(sizes, "doc_id").withColumn("other_rank", F.row_number().over(order).cast("long")).where("other_rank <= 20")
    own = lex.where("rank <= 20").select("item_id", "doc_id", F.col("rank").cast("long").alias("lexical_rank"))
    return own.join(other.select("item_id", "doc_id", "other_rank"), ["item_id", "doc_id"], "full")


@query("JN4_late_texts", f"WITH {BM25_SQL} SELECT item_id, doc_id, md5(text) AS text_md5, lang FROM lex JOIN documents USING (doc_id) WHERE rank <= 5")
def late_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: texts read only for the ids that ranking has left."""
    hits = R.small(lexical(spark, sf_dir).where("rank <= 5").select("item_id", "doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    return docs.join(hits, "doc_id").select("item_id", "doc_id", "text_md5", "lang")


@query(
    "WIN2_first_gold_rank",
    f"WITH {BM25_SQL}, g AS (SELECT item_id, l.doc_id, l.rank, row_number() OVER (PARTITION BY item_id, d.lang ORDER BY l.rank) AS r, d.lang FROM lex l JOIN documents d USING (doc_id)) SELECT item_id, lang, CAST(rank AS BIGINT) AS first_rank FROM g WHERE r = 1",
)
def first_gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2: the best rank of each language in every item's list."""
    hits = lexical(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return hits.groupBy("item_id", "lang").agg(F.min("rank").cast("long").alias("first_rank"))


@query("NUM9_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS score FROM embeddings")
def cosine_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM9: cosine of each vector with its mirror, six places."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(R.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("score"))


@query("AGG4_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: exact percentiles with linear interpolation, by ranged counting."""
    found = M.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("AGG7_ratio", "SELECT lang, CASE WHEN count(*) FILTER (n_chars > 500) = 0 THEN NULL ELSE count(*) FILTER (n_chars > 500 AND text LIKE '%license%') / CAST(count(*) FILTER (n_chars > 500) AS DOUBLE) END AS share FROM documents GROUP BY lang")
def conditional_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7: share of a conditional pool, null where the pool is empty."""
    long = F.col("n_chars") > 500
    hit = F.coalesce(F.contains("text", F.lit("license")), F.lit(False))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(M.ratio(hit, long).alias("share"))


@query(
    "AGG37_cost",
    """WITH c AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '120b' WHEN 1 THEN '20b' ELSE 'other' END AS model, sum(length(text)) FILTER (role = 'user') AS i, sum(length(text)) FILTER (role <> 'user') AS o FROM conversations GROUP BY 1, 2)
SELECT model, round(sum((coalesce(i, 0) * CASE model WHEN '20b' THEN 0.075 ELSE 0.15 END + coalesce(o, 0) * CASE model WHEN '20b' THEN 0.3 ELSE 0.6 END) / 1e6), 9) AS usd FROM c GROUP BY model""",
)
def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG37: price of tokens by model, unknown models at the default price."""
    size = F.coalesce(F.length("text"), F.lit(0))
    model = F.when(F.col("conv_id") % 3 == 0, "120b").when(F.col("conv_id") % 3 == 1, "20b").otherwise("other")
    each = table(spark, sf_dir, "conversations").groupBy("conv_id", model.alias("model")).agg(
        F.sum(F.when(F.col("role") == "user", size).otherwise(0)).alias("i"), F.sum(F.when(F.col("role") != "user", size).otherwise(0)).alias("o")
    )
    return each.groupBy("model").agg(F.round(F.sum(M.cost_usd(F.col("model"), F.col("i"), F.col("o"))), 9).alias("usd"))


@query("DAT3_week_starts", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def week_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT3: Monday of each event's week."""
    weeks = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week"))
    return weeks.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("HSH1_row_hash", "SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS row_hash FROM orders")
def row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH1: SHA-256 over a row's fields, as key of records and caches."""
    fields = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(fields, 256).alias("row_hash"))


@query("MAP1_summed_maps", "SELECT user_id, event_type AS k, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def summed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP1: maps of stage to value, summed by key over a user's records."""
    records = table(spark, sf_dir, "events").select("user_id", F.create_map("event_type", "value").alias("m"))
    return records.select("user_id", F.explode("m").alias("k", "v")).groupBy("user_id", "k").agg(F.round(F.sum("v"), 4).alias("total"))


@query(
    "ARR1_array_rules",
    f"WITH t AS (SELECT doc_id, {terms_sql('text')} AS a FROM documents) SELECT doc_id, len(list_distinct(a)) AS n_distinct, len(list_filter(a, lambda x: length(x) > 6)) AS n_long, len(list_filter(a, lambda x: x = 'license')) > 0 AS any_license, len(list_filter(a, lambda x: length(x) < 2)) = 0 AS all_two FROM t",
)
def array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR1: distinct, filter, any and all over the terms of each document."""
    from ..functions.text import search_terms

    a = F.col("a")
    rows = table(spark, sf_dir, "documents").select("doc_id", search_terms(F.col("text")).alias("a"))
    return rows.select(
        "doc_id", F.size(F.array_distinct(a)).cast("long").alias("n_distinct"), F.size(F.filter(a, lambda x: F.length(x) > 6)).cast("long").alias("n_long"),
        F.exists(a, lambda x: x == "license").alias("any_license"), F.forall(a, lambda x: F.length(x) >= 2).alias("all_two"),
    )


@query("SET2_ordered_distinct", "WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM f GROUP BY user_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2: each user's event types in the order of their first event."""
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    lists = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("l"))
    return lists.select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("kinds"))


@query("TOP6_most_common", "SELECT * FROM (SELECT o_orderpriority AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1) WHERE place <= 3")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP6: the three most frequent priorities, ties by name (a top-k report)."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(3)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")).cast("long"))


@query("TOP5_names", "SELECT c_custkey, c_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_custkey) AS BIGINT) AS place FROM customer")
def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP5: names in order, letter case ignored, by nation."""
    order = Window.partitionBy("c_nationkey").orderBy(F.lower("c_name"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.row_number().over(order).cast("long").alias("place"))


@query("WIN14_segments", """WITH w AS (SELECT l_orderkey AS page, l_linenumber AS row_no, l_quantity * 3 AS y, l_shipmode_gap FROM (SELECT *, l_quantity AS l_shipmode_gap FROM lineitem)),
g AS (SELECT page, row_no, y, y - lag(y) OVER (PARTITION BY page ORDER BY y, row_no) AS gap FROM w)
SELECT page, row_no, CAST(sum(CASE WHEN gap > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, row_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14: rows of a page fall into segments where the gap to the row above is over 45."""
    order = Window.partitionBy("page").orderBy("y", "row_no")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row_no"), (F.col("l_quantity") * 3).alias("y"))
    gap = rows.withColumn("gap", F.col("y") - F.lag("y").over(order))
    cut = F.sum(F.when(F.col("gap") > 45, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return gap.select("page", "row_no", cut.cast("long").alias("segment"))


@query("AGG36_median_size", "SELECT l_returnflag AS page, median(l_quantity) AS median_size, CAST(count(*) FILTER (l_quantity > m) AS BIGINT) AS n_larger FROM (SELECT *, median(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1")
def median_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG36: the median size of a page's words, and how many are larger (candidates for headings)."""
    words = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("page"), F.col("l_quantity").alias("size"))
    middle = M.summary(words, ["page"], "size").select("page", F.col("p50").alias("median_size"))
    return words.join(R.small(middle), "page").groupBy("page", "median_size").agg(F.count_if(F.col("size") > F.col("median_size")).alias("n_larger"))


@query("PDF1_image_ratio", "SELECT l_orderkey AS page, round(least(1.0, sum(l_quantity * l_discount * 10) / 500.0), 6) AS image_ratio FROM lineitem GROUP BY 1")
def image_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF1: share of a page's area that image boxes side by side cover, at most 1."""
    boxes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.sum(F.col("l_quantity") * F.col("l_discount") * 10).alias("area"))
    return boxes.select("page", F.round(F.least(F.lit(1.0), F.col("area") / 500.0), 6).alias("image_ratio"))


@query(
    "FLT7_abstain_reasons",
    """WITH e AS (SELECT event_id, event_id % 11 = 0 AS not_ready, event_id % 7 = 0 AS no_hits, value AS score, event_id % 5 = 0 AS llm_failed, event_id % 4 = 0 AS invalid, event_id % 3 = 0 AS declined, event_id % 2 = 0 AS uncited FROM events)
SELECT event_id, CASE WHEN not_ready THEN 'not_ready' WHEN no_hits THEN 'no_results' WHEN score < 10 THEN 'low_score' WHEN llm_failed THEN 'llm_error' WHEN invalid THEN 'invalid_output' WHEN declined THEN 'model_abstained' WHEN uncited THEN 'no_citations' END AS reason FROM e""",
)
def abstain_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7: the first gate that stops an answer gives the reason; null where none does."""
    gates = [
        ("not_ready", F.col("event_id") % 11 == 0), ("no_results", F.col("event_id") % 7 == 0), ("low_score", F.col("value") < 10),
        ("llm_error", F.col("event_id") % 5 == 0), ("invalid_output", F.col("event_id") % 4 == 0), ("model_abstained", F.col("event_id") % 3 == 0),
        ("no_citations", F.col("event_id") % 2 == 0),
    ]
    return table(spark, sf_dir, "events").select("event_id", A.first_reason(gates).alias("reason"))


@query(
    "AGG23_citation_hits",
    """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS page, l_linenumber * 2 AS gold FROM lineitem),
h AS (SELECT a.k, a.gold, max(CASE WHEN b.page = a.gold THEN 1 ELSE 0 END) AS hit, max(CASE WHEN abs(b.page - a.gold) <= 1 THEN 1 ELSE 0 END) AS near FROM c a JOIN c b ON a.k = b.k GROUP BY 1, 2)
SELECT k, max(hit) = 1 AS any_hit, max(near) = 1 AS any_near, min(hit) = 1 AS all_hit FROM h GROUP BY k""",
)
def citation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23: whether cited pages hold any gold page, any within one page, and all of them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"))
    cited = lines.groupBy("k").agg(F.collect_set("page").alias("cited"))
    gold = lines.select("k", (F.col("page") * 2).alias("gold")).distinct().join(cited, "k")
    hit = F.array_contains("cited", F.col("gold"))
    near = hit | F.array_contains("cited", F.col("gold") - 1) | F.array_contains("cited", F.col("gold") + 1)
    return gold.groupBy("k").agg(F.bool_or(hit).alias("any_hit"), F.bool_or(near).alias("any_near"), F.bool_and(hit).alias("all_hit"))


@query(
    "FLT12_skip_reasons",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN d.text IS NULL OR trim(d.text) = '' THEN 'no text' WHEN l.quality = 0 THEN 'low quality' END AS skipped FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12: why a row is left out of an evaluation; null for one that runs."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(marks, "doc_id", "left")
    gates = [("no label", F.col("known").isNull()), ("no text", F.trim(F.coalesce("text", F.lit(""))) == ""), ("low quality", F.col("quality") == 0)]
    return rows.select("doc_id", A.first_reason(gates).alias("skipped"))


@query(
    "FLT13_question_guard",
    "SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 500 THEN 'too long' ELSE 'ok' END AS verdict FROM conversations WHERE role = 'user'",
)
def question_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13: questions must not be empty nor longer than 500 characters."""
    gates = [("empty", F.trim(F.coalesce("text", F.lit(""))) == ""), ("too long", F.length("text") > 500)]
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.coalesce(A.first_reason(gates), F.lit("ok")).alias("verdict"))


@query("FLT17_abstention_outcome", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'ANSWER' WHEN quality = 0 THEN 'ABSTAIN' ELSE 'OTHER' END AS outcome FROM labels")
def abstention_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT17: outcome of a row: answered, abstained, or neither."""
    gates = [("ANSWER", (F.col("quality") == 1) & (F.col("toxic") == 0)), ("ABSTAIN", F.col("quality") == 0)]
    return table(spark, sf_dir, "labels").select("doc_id", F.coalesce(A.first_reason(gates), F.lit("OTHER")).alias("outcome"))


@query(
    "CLS4_request_outcomes",
    "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'exception' WHEN event_id % 9 = 0 THEN 'http_error' WHEN value < 5 THEN 'degraded' ELSE 'ok' END AS outcome FROM events",
)
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS4: outcome of a request: exception, HTTP error, degraded, ok."""
    gates = [("exception", F.col("event_id") % 13 == 0), ("http_error", F.col("event_id") % 9 == 0), ("degraded", F.col("value") < 5)]
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(A.first_reason(gates), F.lit("ok")).alias("outcome"))


@query(
    "AGG26_general_block",
    """WITH r AS (SELECT c.conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS said, avg(length(text)) FILTER (role = 'assistant') AS chars FROM conversations c GROUP BY 1)
SELECT CASE WHEN said = 0 THEN 'unanswered' WHEN turns > 4 THEN 'mixed' ELSE 'general' END AS kind, count(*) AS n, CAST(sum(said) AS BIGINT) AS answers, round(avg(chars), 4) AS mean_chars FROM r GROUP BY 1""",
)
def general_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG26: general and mixed conversations: how many, with how many answers of what length."""
    said = F.col("role") == "assistant"
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(said).alias("said"), F.avg(F.when(said, F.length("text"))).alias("chars")
    )
    kind = A.first_reason([("unanswered", F.col("said") == 0), ("mixed", F.col("turns") > 4)])
    return each.groupBy(F.coalesce(kind, F.lit("general")).alias("kind")).agg(F.count("*").alias("n"), F.sum("said").alias("answers"), F.round(F.avg("chars"), 4).alias("mean_chars"))


@query("AGG29_agreement", "SELECT o_orderpriority AS slice, avg(CASE WHEN (o_orderkey % 3 = 0) = (o_totalprice > 150000) THEN 1.0 ELSE 0.0 END) AS agreement, count(*) FILTER (o_orderkey % 3 = 0 AND NOT o_totalprice > 150000) AS only_first FROM orders GROUP BY 1")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG29: how often two verdicts agree, and where only the first says yes, by slice."""
    one, two = F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") > 150000
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("slice")).agg(
        F.avg(F.when(one == two, 1.0).otherwise(0.0)).alias("agreement"), F.count_if(one & ~two).alias("only_first")
    )


@query("JN14_sheet_key", "SELECT d.doc_id, l.quality, l.toxic, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def sheet_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14: label sheet joined with its key."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "toxic", "lang")


@query("FLT14_router_ran", "SELECT role, count(*) FILTER (turn > 1 AND text IS NOT NULL) AS ran, count(*) AS n FROM conversations GROUP BY role")
def router_ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT14: rows for which routing ran, by role."""
    ran = (F.col("turn") > 1) & F.col("text").isNotNull()
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(ran).alias("ran"), F.count("*").alias("n"))


@query("FLT16_slices", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 5)")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT16: rows of the slices asked for, of sources that have enough rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    enough = R.small(docs.groupBy("source").agg(F.count("*").alias("n")).where("n >= 5").select("source"))
    return docs.where(F.col("lang").isin("de", "fr")).join(enough, "source", "left_semi").select("doc_id", "lang", "source")


@query(
    "UDAF1_variation_distance",
    """WITH d AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, count(*) / (SELECT count(*) FROM events)::DOUBLE AS share FROM events GROUP BY 1),
u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, event_type, share FROM u, t), s AS (SELECT user_id, sum(n) AS total FROM d GROUP BY 1)
SELECT user_id, round(0.5 * sum(abs(coalesce(n, 0) / total::DOUBLE - share)), 6) AS tvd FROM g LEFT JOIN d USING (user_id, event_type) JOIN s USING (user_id) GROUP BY user_id""",
)
def variation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDAF1: total-variation distance of each user's event mix from that of all events."""
    events = table(spark, sf_dir, "events")
    n = events.count()
    overall = events.groupBy("event_type").agg((F.count("*") / F.lit(n)).alias("share"))
    own = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    totals = own.groupBy("user_id").agg(F.sum("n").alias("total"))
    # types that a user lacks count with their whole share: 1 minus the shares of those it has
    joined = own.join(R.small(overall), "event_type").join(totals, "user_id")
    parts = joined.groupBy("user_id").agg(F.sum(F.abs(F.col("n") / F.col("total") - F.col("share"))).alias("d"), F.sum("share").alias("has"))
    return parts.select("user_id", F.round(0.5 * (F.col("d") + 1 - F.col("has")), 6).alias("tvd"))


@query(
    "SRC8_question_file",
    "SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'corrupt' WHEN conv_id % 5 = 0 THEN 'unknown route' WHEN text IS NULL OR trim(text) = '' THEN 'empty' ELSE 'ok' END AS verdict FROM conversations",
)
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: JSON lines of questions, some torn: parsed with a record of what does not parse, then validated."""
    rows = table(spark, sf_dir, "conversations")
    route = F.when(F.col("conv_id") % 5 == 0, "ELSEWHERE").otherwise("DOCUMENT")
    whole = F.to_json(F.struct(F.col("conv_id").alias("id"), F.col("text").alias("question"), route.alias("route")))
    lines = rows.select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, F.left(whole, F.length(whole) - 3)).otherwise(whole).alias("line"))
    kept = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "torn"}
    read = lines.select("conv_id", "turn", F.from_json("line", "id long, question string, route string, torn string", kept).alias("q"))
    gates = [
        ("corrupt", F.col("q.torn").isNotNull()), ("unknown route", ~F.col("q.route").isin("DOCUMENT", "GENERAL", "MIXED")),
        ("empty", F.trim(F.coalesce("q.question", F.lit(""))) == ""),
    ]
    return read.select("conv_id", "turn", F.coalesce(A.first_reason(gates), F.lit("ok")).alias("verdict"))
