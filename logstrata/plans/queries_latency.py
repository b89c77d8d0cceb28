"""Queries: endpoint statistics, top consumers, errors, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latency
from .queries_search import file_catalog
from .registry import query

STATS = """SELECT {keys}, count(*) AS count, count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0) AS rps, quantile_cont(duration_ms, 0.99) AS p99,
  quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.5) AS median, max(duration_ms) AS max, min(duration_ms) AS min, stddev_pop(duration_ms) AS stddev,
  count(*) * quantile_cont(duration_ms, 0.99) AS score, count(*) FILTER (status >= 500) * 100.0 / count(*) AS fail_pct FROM request_log GROUP BY {keys}"""
BY_ENDPOINT = STATS.format(keys="session_id, endpoint")
ROUNDED = "round(rps, 8) AS rps, round(p99, 3) AS p99, round(p95, 3) AS p95, round(median, 3) AS median, max, min, round(stddev, 2) AS stddev, round(score, 1) AS score, round(fail_pct, 4) AS fail_pct"


def rounded(df, *keys):
    places = {"rps": 8, "p99": 3, "p95": 3, "median": 3, "stddev": 2, "score": 1, "fail_pct": 4}
    return df.select(*keys, "count", *[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in "rps p99 p95 median max min stddev score fail_pct".split()])


def stats(t):
    return latency.endpoint_stats(t.request_log(), ["session_id", "endpoint"])


@query("endpoint_statistics", "E14", "request_log", f"SELECT session_id, endpoint, count, {ROUNDED} FROM ({BY_ENDPOINT}) s")
def endpoint_statistics(t):
    return rounded(stats(t), "session_id", "endpoint")


BY_DAY = STATS.replace("{keys}, count", "endpoint, date_trunc('day', ts) AS day, count").replace("{keys}", "endpoint, date_trunc('day', ts)")


@query("endpoint_statistics_by_day", "E15 F14", "request_log", f"SELECT endpoint, strftime(day, '%Y-%m-%d') AS day, count, {ROUNDED} FROM ({BY_DAY}) s")
def endpoint_statistics_by_day(t):
    rows = latency.stats_series(latency.endpoint_stats(t.request_log(), ["endpoint"], "1d"))
    return rounded(rows, "endpoint", F.date_format("interval", "yyyy-MM-dd").alias("day"))


@query("slowest_endpoints", "G6 C21 L4", "request_log", f"""
SELECT session_id, endpoint, round(p99, 3) AS p99, CASE WHEN p99 > 5000 THEN 'red' WHEN p99 > 1000 THEN 'yellow' ELSE 'green' END AS band,
  CASE WHEN fail_pct > 10 THEN 'red' WHEN fail_pct > 5 THEN 'yellow' ELSE 'green' END AS fail_band, CASE WHEN score > 1e7 THEN 'red' WHEN score > 1e6 THEN 'yellow' ELSE 'green' END AS score_band
FROM ({BY_ENDPOINT}) s WHERE contains(lower(endpoint), '#r') ORDER BY p99 DESC, endpoint LIMIT 15""")
def slowest_endpoints(t):
    top = latency.top_endpoints(latency.filter_endpoints(stats(t), "#R"), "p99", 15)
    return top.select(
        "session_id", "endpoint", F.round("p99", 3).alias("p99"), latency.metric_band(F.col("p99"), "p99").alias("band"),
        latency.metric_band(F.col("fail_pct"), "fail_pct").alias("fail_band"), latency.metric_band(F.col("score"), "score").alias("score_band"),
    )


def top_sql(dim, sort, limit):
    metrics = ["count", "fails", "duration_ms", "db_ms", "mem_kb"]
    shares = ", ".join(f"round({m} * 100.0 / sum({m}) OVER (), 6) AS {m}_pct" for m in metrics)
    return f"""WITH per AS (SELECT {dim}, count(*) AS count, count(*) FILTER (status >= 500) AS fails, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(db_ms) AS BIGINT) AS db_ms, CAST(sum(mem_kb) AS BIGINT) AS mem_kb FROM request_log GROUP BY 1)
SELECT {dim}, {", ".join(metrics)}, {shares} FROM per ORDER BY {sort} DESC, {dim} LIMIT {limit}"""


def top(name, dim, sort, limit):
    @query(name, "E16", "request_log", top_sql(dim, sort, limit))
    def run(t):
        rows = latency.top_consumers(t.request_log(), dim, sort, limit)
        return rows.select(*[F.round(c, 6).alias(c) if c.endswith("_pct") else F.col(c) for c in rows.columns])


top("top_projects", "project", "duration_ms", 10)
top("top_users_by_memory", "user_name", "mem_kb", 20)
top("top_paths_by_db", "endpoint", "db_ms", 10)


@query("consumer_totals", "E17", "request_log", """
SELECT count(*) AS count, count(*) FILTER (status >= 500) AS fails, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(db_ms) AS BIGINT) AS db_ms, CAST(sum(mem_kb) AS BIGINT) AS mem_kb FROM request_log""")
def consumer_totals(t):
    return latency.consumer_totals(t.request_log())


@query("error_message_statistics", "E18", "request_log", """
SELECT session_id, error_message, count(*) AS count, count(DISTINCT user_name) AS users, count(DISTINCT project) AS projects, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
FROM request_log WHERE error_message IS NOT NULL GROUP BY 1, 2""")
def error_message_statistics(t):
    rows = latency.error_stats(t.request_log())
    return rows.withColumn("first_day", F.date_format("first_ts", "yyyy-MM-dd")).withColumn("last_day", F.date_format("last_ts", "yyyy-MM-dd")).drop("first_ts", "last_ts")


@query("error_message_events", "E18", "request_log", """
SELECT session_id, error_message, strftime(ts, '%Y-%m-%d') AS day, endpoint, user_name, project FROM request_log WHERE error_message IS NOT NULL""")
def error_message_events(t):
    return latency.error_events(t.request_log()).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts")


@query("latency_dashboard", "E19", "request_log", f"""
SELECT CAST(sum(count) AS BIGINT) AS total_requests, count(*) AS total_endpoints, round(avg(p99), 2) AS avg_p99, round(avg(fail_pct), 4) AS error_rate,
  max_by(endpoint, score) AS top_endpoint, round(max(score), 1) AS max_score FROM ({BY_ENDPOINT}) s""")
def latency_dashboard(t):
    rows = latency.latency_overview(stats(t))
    return rows.select("total_requests", "total_endpoints", F.round("avg_p99", 2).alias("avg_p99"), F.round("error_rate", 4).alias("error_rate"), "top_endpoint", F.round("max_score", 1).alias("max_score"))


@query("sessions_compared", "D4 L2", "request_log", f"""
WITH s AS ({BY_ENDPOINT}), b AS (SELECT * FROM s WHERE session_id = 'node0'), o AS (SELECT * FROM s WHERE session_id = 'node1'),
j AS (SELECT replace(coalesce(b.endpoint, o.endpoint), '', '') AS endpoint, b.count AS base_count, o.count AS other_count, round(b.p99, 3) AS base_p99, round(o.p99, 3) AS other_p99, o.p99 / b.p99 AS r FROM b FULL JOIN o ON substring(b.endpoint, 12) = substring(o.endpoint, 12) AND b.endpoint = o.endpoint)
SELECT endpoint, base_count, other_count, base_p99, other_p99, coalesce(r > 1.1, FALSE) AS is_regression, coalesce(r < 0.9, FALSE) AS is_improvement, coalesce(abs(round((r - 1) * 100, 1)) > 50, FALSE) AS high_impact FROM j""")
def sessions_compared(t):
    rows = latency.compare_flags(latency.compare_sessions(stats(t), "node0", "node1"))
    return rows.select("endpoint", "base_count", "other_count", F.round("base_p99", 3).alias("base_p99"), F.round("other_p99", 3).alias("other_p99"), "is_regression", "is_improvement", "high_impact")


@query("flags_lost_between_sessions", "D4 L2", "request_log", """
WITH r AS (SELECT session_id, split_part(endpoint, '#', 2) AS endpoint, duration_ms * CASE WHEN session_id = 'node1' AND endpoint LIKE '%#a' THEN 2 WHEN session_id = 'node0' AND endpoint LIKE '%#n' THEN 3 ELSE 1 END AS duration_ms, status FROM request_log),
s AS (SELECT session_id, endpoint, count(*) AS n, quantile_cont(duration_ms, 0.99) AS p99 FROM r GROUP BY 1, 2)
SELECT b.endpoint, b.n AS base_count, o.n AS other_count, round(o.p99 / b.p99, 6) AS p99_ratio, o.p99 / b.p99 > 1.1 AS is_regression, o.p99 / b.p99 < 0.9 AS is_improvement
FROM (SELECT * FROM s WHERE session_id = 'node0') b JOIN (SELECT * FROM s WHERE session_id = 'node1') o ON b.endpoint = o.endpoint""")
def flags_lost_between_sessions(t):
    times = F.expr("CASE WHEN session_id = 'node1' AND endpoint LIKE '%#a' THEN 2 WHEN session_id = 'node0' AND endpoint LIKE '%#n' THEN 3 ELSE 1 END")
    rows = t.request_log().withColumn("duration_ms", F.col("duration_ms") * times).withColumn("endpoint", F.split_part("endpoint", F.lit("#"), F.lit(2)))
    both = latency.compare_flags(latency.compare_sessions(latency.endpoint_stats(rows, ["session_id", "endpoint"]), "node0", "node1"))
    return both.select("endpoint", "base_count", "other_count", F.round("p99_ratio", 6).alias("p99_ratio"), "is_regression", "is_improvement")


@query("latency_advice", "L3", "request_log", "SELECT 1 AS rank, 'Slow requests found' AS title, 'high' AS priority FROM (SELECT quantile_cont(duration_ms, 0.99) AS p FROM request_log) x WHERE p > 5000 UNION ALL "
       "SELECT 4, 'Set this session against another', 'medium' FROM (SELECT count(*) AS n FROM request_log) y WHERE n > 0 UNION ALL "
       "SELECT 2, 'Many requests fail', 'high' FROM (SELECT max(f) AS f FROM (SELECT count(*) FILTER (status >= 500) * 100.0 / count(*) AS f FROM request_log GROUP BY session_id, endpoint) a) z WHERE f > 10")
def latency_advice(t):
    return latency.latency_advice(stats(t))


@query("latency_log_files", "L1", "log_lines", """
SELECT session_id, path, CASE WHEN path LIKE '%production_json.log' THEN 'production_json' WHEN path LIKE '%gitaly/current' THEN 'gitaly' ELSE 'sidekiq' END AS latency_type
FROM log_lines WHERE path LIKE '%production_json.log' OR path LIKE '%gitaly/current' OR path LIKE '%sidekiq/current' GROUP BY session_id, path""")
def latency_log_files(t):
    return latency.latency_files(file_catalog(t)).select("session_id", "path", "latency_type")
