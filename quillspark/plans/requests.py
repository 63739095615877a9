"""Request-log queries over `events`, each event standing for one request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import table
from ..tables import saved
from .registry import query

# How an event's columns stand for a request's, in SQL that Spark and DuckDB share.
COLUMNS = {
    "trace_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "route": "CASE event_type WHEN 'click' THEN 'GENERAL' WHEN 'signup' THEN 'MIXED' ELSE 'DOCUMENT' END",
    "status": "CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 0 THEN 'abstained' WHEN event_id % 11 = 0 THEN 'not_ready' ELSE 'answered' END",
    "t_total_ms": "value * 20",
    "t_router_ms": "CASE WHEN event_id % 5 <> 0 THEN value END",
    "router_ok": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 0 ELSE 1 END",
    "abstain_reason": "CASE WHEN event_type <> 'error' AND event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'low_score' ELSE 'insufficient' END END",
    "citations_valid": "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 ELSE 1 END",
    "number_check": "CASE event_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'na' END",
    "top_score": "CASE WHEN event_type <> 'click' THEN value / (value + 40) END",
    "model": "CASE event_id % 3 WHEN 0 THEN '120b' WHEN 1 THEN '20b' ELSE 'other' END",
    "tokens_in": "event_id % 3000 + 100",
    "tokens_out": "event_id % 500",
    "feedback": "CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 15 = 1 THEN -1 END",
    "judge_correct": "CASE WHEN event_id % 6 = 0 THEN 1 WHEN event_id % 6 = 1 THEN 0 END",
    "fallbacks": "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END",
    "rate_limited": "CASE WHEN event_id % 23 = 0 THEN 2 ELSE 0 END",
}
_LOG = "r AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + " FROM events)"


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{sql} AS {name}" for name, sql in COLUMNS.items()])


def _rounded(frame: DataFrame, *keep: str) -> DataFrame:
    doubles = {c for c, kind in frame.dtypes if kind == "double" and c not in keep}
    return frame.select(*[F.round(c, 6).alias(c) if c in doubles else c for c in frame.columns])


_SUMMARY = "count({0}) AS n, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.95), 6) AS p95, round(quantile_cont({0}, 0.99), 6) AS p99, round(avg({0}), 6) AS mean"


@query("AGG6_latency_summary", f"WITH {_LOG} SELECT route, {_SUMMARY.format('t_total_ms')} FROM r GROUP BY route")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4 AGG6: latency summary by route."""
    return _rounded(M.summary(request_log(spark, sf_dir), ["route"], "t_total_ms"))


@query(
    "AGG27_stage_latency",
    f"""WITH {_LOG}, u AS (SELECT 'router' AS stage, t_router_ms AS ms FROM r UNION ALL SELECT 'total', t_total_ms FROM r)
SELECT stage, {_SUMMARY.format('ms')} FROM u WHERE ms > 0 GROUP BY stage""",
)
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG27: latency by stage; stages that did not run are left out."""
    log = request_log(spark, sf_dir).select(F.col("t_router_ms").alias("router"), F.col("t_total_ms").alias("total"))
    stages = log.unpivot([], ["router", "total"], "stage", "ms").where("ms > 0")
    return _rounded(M.summary(stages, ["stage"], "ms"))


@query(
    "AGG5_nearest_rank",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM s""",
)
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5: percentile by nearest rank, found by counting: no list of a group is built."""
    return M.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95).withColumnRenamed("value", "p95")


@query(
    "AGG8_operations",
    f"""WITH {_LOG} SELECT count(*) AS n, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate, avg(CASE WHEN fallbacks > 0 THEN 1.0 ELSE 0.0 END) AS fallback_rate,
avg(CASE WHEN rate_limited > 0 THEN 1.0 ELSE 0.0 END) AS limited_rate, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
round(sum(tokens_in * CASE model WHEN '20b' THEN 0.075 ELSE 0.15 END + tokens_out * CASE model WHEN '20b' THEN 0.3 ELSE 0.6 END) / 1e6, 6) AS cost_usd FROM r""",
)
def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8 AGG37: rates, tokens and cost of all requests."""
    log = request_log(spark, sf_dir)
    every = F.lit(True)
    return log.agg(
        F.count("*").alias("n"), M.ratio(F.col("status") == "error", every).alias("error_rate"), M.ratio(F.col("fallbacks") > 0, every).alias("fallback_rate"),
        M.ratio(F.col("rate_limited") > 0, every).alias("limited_rate"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum(M.cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))), 6).alias("cost_usd"),
    )


@query(
    "AGG10_histogram",
    """WITH b AS (SELECT unnest(range(11)) AS bucket), c AS (SELECT least(floor(CAST(json_extract_string(props, '$.k') AS INT) / 10.0), 10) AS bucket, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT CAST(bucket AS INT) AS bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)""",
)
def question_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: question lengths in buckets, empty ones and the overflow kept."""
    log = table(spark, sf_dir, "events").where("event_type = 'view'")
    return M.histogram(log.select(F.get_json_object("props", "$.k").cast("int").alias("k")), "k", 10, 10)


@query("AGG11_value_counts", f"WITH {_LOG} SELECT abstain_reason AS reason, count(*) AS n FROM r WHERE abstain_reason IS NOT NULL GROUP BY 1")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11 TOP6: abstain reasons, most common first."""
    log = request_log(spark, sf_dir).where("abstain_reason is not null")
    return log.groupBy(F.col("abstain_reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query(
    "AGG12_output_rates",
    f"""WITH {_LOG} SELECT
count(*) FILTER (status = 'abstained') * 1.0 / count(*) FILTER (status IN ('answered', 'abstained')) AS abstention_rate,
count(*) FILTER (citations_valid = 0) * 1.0 / count(citations_valid) AS citation_invalid_rate,
count(*) FILTER (number_check = 'fail') * 1.0 / count(*) FILTER (number_check IN ('pass', 'fail')) AS number_fail_rate,
count(*) FILTER (router_ok = 0) * 1.0 / count(router_ok) AS router_fallback_rate FROM r""",
)
def output_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12 FLT14 AGG7: rates, each over its own pool."""
    c = F.col
    return request_log(spark, sf_dir).agg(
        M.ratio(c("status") == "abstained", c("status").isin("answered", "abstained")).alias("abstention_rate"),
        M.ratio(c("citations_valid") == 0, c("citations_valid").isNotNull()).alias("citation_invalid_rate"),
        M.ratio(c("number_check") == "fail", c("number_check").isin("pass", "fail")).alias("number_fail_rate"),
        M.ratio(c("router_ok") == 0, c("router_ok").isNotNull()).alias("router_fallback_rate"),
    )


@query(
    "AGG13_quality",
    f"""WITH {_LOG} SELECT route, count(*) FILTER (feedback = 1) AS thumbs_up, count(*) FILTER (feedback = -1) AS thumbs_down,
count(*) FILTER (judge_correct = 1) * 1.0 / nullif(count(judge_correct), 0) AS correct_rate, count(judge_correct) AS judged FROM r GROUP BY route""",
)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: feedback and judge verdicts; requests without a verdict leave both sides of the ratio."""
    c = F.col
    return request_log(spark, sf_dir).groupBy("route").agg(
        F.count_if(c("feedback") == 1).alias("thumbs_up"), F.count_if(c("feedback") == -1).alias("thumbs_down"),
        M.ratio(c("judge_correct") == 1, c("judge_correct").isNotNull()).alias("correct_rate"), F.count("judge_correct").alias("judged"),
    )


@query(
    "AGG14_daily_top_score",
    f"WITH {_LOG} SELECT CAST(ts AS DATE) AS day, round(median(top_score), 6) AS median_score, count(top_score) AS n FROM r WHERE top_score IS NOT NULL GROUP BY 1",
)
def daily_top_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14: median of the top score per UTC day."""
    log = request_log(spark, sf_dir).where("top_score is not null")
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.median("top_score"), 6).alias("median_score"), F.count("*").alias("n"))


_MIX = f"{_LOG}, m AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, route AS part, count(*) AS n FROM r GROUP BY 1, 2), x AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY week) AS share FROM m)"


@query("AGG15_weekly_mix", f"WITH {_MIX} SELECT week, part, n, round(share, 6) AS share FROM x")
def weekly_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15 DAT3: share of each route per week."""
    return _rounded(M.weekly_mix(request_log(spark, sf_dir), "ts", "route"))


@query(
    "JN13_mix_shift",
    f"""WITH {_MIX}, w AS (SELECT DISTINCT week FROM x), p AS (SELECT DISTINCT part FROM x),
g AS (SELECT week, part, coalesce(a.share, 0) AS s, coalesce(b.share, 0) AS e FROM w CROSS JOIN p LEFT JOIN x a USING (week, part) LEFT JOIN (SELECT week + 7 AS week, part, share FROM x) b USING (week, part))
SELECT CAST(week AS DATE) AS week, CASE WHEN week - 7 IN (SELECT week FROM w) THEN round(sum(abs(s - e)) / 2, 6) END AS shift FROM g GROUP BY week""",
)
def weekly_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13 AGG16: total variation against the calendar week before."""
    return _rounded(M.mix_shift(M.weekly_mix(request_log(spark, sf_dir), "ts", "route")))


@query(
    "CLS2_indicators",
    f"""WITH {_LOG}, v AS (SELECT route, count(*) AS n, quantile_cont(t_total_ms, 0.95) AS p95, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS err, median(top_score) AS top FROM r GROUP BY route)
SELECT route, CASE WHEN n < 5 THEN 'grey' WHEN p95 > 6000 THEN 'red' WHEN p95 > 4000 THEN 'amber' ELSE 'green' END AS latency,
CASE WHEN n < 5 THEN 'grey' WHEN err > 0.05 THEN 'red' WHEN err > 0.02 THEN 'amber' ELSE 'green' END AS errors,
CASE WHEN n < 5 OR top IS NULL THEN 'grey' WHEN top < 0.45 THEN 'red' WHEN top < 0.55 THEN 'amber' ELSE 'green' END AS top_score FROM v""",
)
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS2: traffic lights by route."""
    v = request_log(spark, sf_dir).groupBy("route").agg(
        F.count("*").alias("n"), F.percentile("t_total_ms", 0.95).alias("p95"), M.ratio(F.col("status") == "error", F.lit(True)).alias("err"), F.median("top_score").alias("top")
    )
    return v.select(
        "route", M.indicator("latency_p95_ms", F.col("p95"), F.col("n")).alias("latency"), M.indicator("error_rate", F.col("err"), F.col("n")).alias("errors"),
        M.indicator("top_score", F.col("top"), F.col("n")).alias("top_score"),
    )


@query(
    "CLS3_worst_status",
    f"""WITH {_LOG}, s AS (SELECT user_id, max(CASE status WHEN 'answered' THEN 0 WHEN 'abstained' THEN 1 WHEN 'not_ready' THEN 4 ELSE 5 END) AS w FROM r GROUP BY user_id)
SELECT user_id, CASE w WHEN 0 THEN 'answered' WHEN 1 THEN 'abstained' WHEN 4 THEN 'not_ready' ELSE 'error' END AS worst FROM s""",
)
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS3: each user's worst status."""
    return request_log(spark, sf_dir).groupBy("user_id").agg(M.worst_status(F.col("status")).alias("worst"))


@query(
    "WIN9_token_budget",
    f"""WITH {_LOG} SELECT trace_id, CAST(sum(tokens_in) OVER (PARTITION BY model ORDER BY floor(epoch(ts)) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS BIGINT) AS spent FROM r""",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9: tokens that each model has spent over the last minute."""
    return M.rolling_budget(request_log(spark, sf_dir), "model", "ts", "tokens_in").select("trace_id", "spent")


@query("SRC6_recent_requests", f"WITH {_LOG} SELECT trace_id, route, status FROM r WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def recent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: requests since a time; the bound reaches the scan."""
    events = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return events.selectExpr(*[f"{COLUMNS[c]} AS {c}" for c in ("trace_id", "route", "status")])


@query("TOP7_newest_unjudged", f"WITH {_LOG} SELECT trace_id, ts FROM r WHERE status = 'answered' AND judge_correct IS NULL ORDER BY ts DESC, trace_id LIMIT 100")
def newest_unjudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP7: the newest hundred answered requests without a verdict (a report)."""
    log = request_log(spark, sf_dir).where("status = 'answered' and judge_correct is null")
    return log.select("trace_id", "ts").orderBy(F.desc("ts"), "trace_id").limit(100)


@query(
    "JN1_request_content",
    f"""WITH {_LOG} SELECT trace_id, route, CAST(count(c.turn) AS BIGINT) AS turns FROM r LEFT JOIN conversations c ON r.trace_id = c.conv_id
WHERE status = 'answered' AND judge_correct IS NULL GROUP BY trace_id, route""",
)
def request_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1: unjudged answered requests with the content kept for them, if any."""
    log = request_log(spark, sf_dir).where("status = 'answered' and judge_correct is null").select("trace_id", "route")
    content = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), "turn")
    return log.join(content, "trace_id", "left").groupBy("trace_id", "route").agg(F.count("turn").alias("turns"))


@query(
    "PRJ5_request_row",
    f"""WITH {_LOG} SELECT trace_id, nullif(round(t_router_ms, 3), 0) AS t_router_ms, round((tokens_in * CASE model WHEN '20b' THEN 0.075 ELSE 0.15 END + tokens_out * CASE model WHEN '20b' THEN 0.3 ELSE 0.6 END) / 1e6, 9) AS cost FROM r""",
)
def request_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5: log rows; a stage that did not run is null, never 0."""
    cost = M.cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))
    return request_log(spark, sf_dir).select("trace_id", F.nullif(F.round("t_router_ms", 3), F.lit(0.0)).alias("t_router_ms"), F.round(cost, 9).alias("cost"))


@query(
    "SNK3_log_upsert",
    f"""WITH {_LOG}, old AS (SELECT trace_id, status, feedback FROM r WHERE trace_id % 2 = 0), new AS (SELECT trace_id, 'answered' AS status FROM r WHERE trace_id % 3 = 0)
SELECT coalesce(n.trace_id, o.trace_id) AS trace_id, coalesce(n.status, o.status) AS status, o.feedback FROM old o FULL JOIN new n ON o.trace_id = n.trace_id""",
)
def log_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: an upsert of log columns that leaves feedback as it is."""
    from .. import sinks

    log = request_log(spark, sf_dir)
    old = log.where("trace_id % 2 = 0").select("trace_id", "status", "feedback")
    new = log.where("trace_id % 3 = 0").select("trace_id", F.lit("answered").alias("status"))
    return sinks.upserted(old, new, ["trace_id"])


@query(
    "AGG32_load_levels",
    f"""WITH {_LOG}, l AS (SELECT user_id % 5 + 1 AS level, count(*) AS n, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS err, sum(rate_limited) AS limited, quantile_cont(t_total_ms, 0.95) AS p95,
epoch(max(ts)) - epoch(min(ts)) AS secs FROM r GROUP BY 1)
SELECT level, n, round(n * 60.0 / secs, 6) AS per_minute, CASE WHEN err >= 0.05 THEN 'broken' WHEN limited > 0 OR p95 > 6000 THEN 'strained' ELSE 'fine' END AS verdict FROM l""",
)
def load_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG32: requests per minute and verdict by level of concurrency."""
    log = request_log(spark, sf_dir).withColumn("level", F.col("user_id") % 5 + 1)
    seconds = F.max("ts").cast("double") - F.min("ts").cast("double")
    v = log.groupBy("level").agg(
        F.count("*").alias("n"), M.ratio(F.col("status") == "error", F.lit(True)).alias("err"), F.sum("rate_limited").alias("limited"),
        F.percentile("t_total_ms", 0.95).alias("p95"), seconds.alias("secs"),
    )
    verdict = F.when(F.col("err") >= 0.05, "broken").when((F.col("limited") > 0) | (F.col("p95") > 6000), "strained").otherwise("fine")
    return v.select("level", "n", F.round(F.col("n") * 60.0 / F.col("secs"), 6).alias("per_minute"), verdict.alias("verdict"))


@query(
    "AGG33_first_strained",
    f"WITH {_LOG}, l AS (SELECT user_id % 50 AS level, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS err FROM r GROUP BY 1) SELECT min(level) FILTER (err >= 0.2) AS first_level FROM l",
)
def first_strained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG33: first level at which a fifth of the requests fail."""
    v = request_log(spark, sf_dir).groupBy((F.col("user_id") % 50).alias("level")).agg(M.ratio(F.col("status") == "error", F.lit(True)).alias("err"))
    return v.agg(F.min(F.when(F.col("err") >= 0.2, F.col("level"))).alias("first_level"))


@query(
    "AGG42_call_stats",
    f"""WITH {_LOG} SELECT user_id, count(*) AS calls, string_agg(DISTINCT model, ',' ORDER BY model) AS models, CAST(sum(fallbacks) AS BIGINT) AS fallbacks, CAST(sum(rate_limited) AS BIGINT) AS limited FROM r GROUP BY user_id""",
)
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG42: model calls per requester."""
    return request_log(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("calls"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
        F.sum("fallbacks").cast("long").alias("fallbacks"), F.sum("rate_limited").cast("long").alias("limited"),
    )


@query(
    "AGG45_online_judging",
    f"""WITH {_LOG} SELECT CASE WHEN route = 'GENERAL' THEN 'not_document' WHEN judge_correct IS NULL THEN 'no_content' WHEN judge_correct = 1 THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM r WHERE status = 'answered' GROUP BY 1""",
)
def online_judging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG45: tally of judging answered requests."""
    c = F.col
    outcome = F.when(c("route") == "GENERAL", "not_document").when(c("judge_correct").isNull(), "no_content").when(c("judge_correct") == 1, "correct").otherwise("wrong")
    return request_log(spark, sf_dir).where("status = 'answered'").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("AGG4_sketch_errors", "SELECT event_type, share, TRUE AS within FROM (SELECT DISTINCT event_type FROM events WHERE value IS NOT NULL), (SELECT unnest([0.5, 0.95, 0.99]) AS share)")
def sketch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4 AGG14 AGG27: percentiles of every type's values from merged daily sketches, and whether their true ranks lie within
    1.5 % of the wanted ones."""
    from ..operators import sketches

    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    days = saved(sketches.daily_sketches(events, ["event_type"], "ts", "value"))
    errors = sketches.rank_errors(events, sketches.window_quantiles(days, ["event_type"]), ["event_type"], "value")
    return errors.select("event_type", "share", (F.coalesce("error", F.lit(1.0)) <= 0.015).alias("within"))
