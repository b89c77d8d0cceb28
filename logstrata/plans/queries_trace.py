"""Queries: ids, events, causal edges, clocks, critical path, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.causality import causality, classify_event, is_causal
from ..functions.fields import field, with_fields
from ..operators import trace
from .registry import query

# event types of the derived messages; only PostgreSQL lines have words the classifier knows
TYPED = """typed AS (SELECT *, CASE WHEN component = 'postgresql' AND contains(message, 'statement') THEN 'query_execute' WHEN component = 'postgresql' AND (contains(message, 'error') OR severity = 'ERROR') THEN 'query_error'
  WHEN severity IN ('ERROR', 'FATAL') THEN 'error' ELSE 'generic' END AS event_type FROM trace_events)"""
LINKS = """CASE WHEN a.component = 'rails' AND b.component = 'sidekiq' THEN 0.9 WHEN a.component = 'rails' AND b.component = 'gitaly' THEN 0.8 WHEN a.component = 'rails' AND b.component = 'postgresql' THEN 0.7
  WHEN a.component = 'sidekiq' AND b.component = 'gitaly' THEN 0.9 WHEN a.component = 'sidekiq' AND b.component = 'postgresql' THEN 0.8 WHEN a.component = 'gitaly' AND b.component = 'postgresql' THEN 0.9
  WHEN a.component = 'workhorse' AND b.component = 'gitaly' THEN 0.9 WHEN a.component = 'workhorse' AND b.component = 'rails' THEN 0.8 ELSE 0.1 END"""
PAIRS = f"""pairs AS (SELECT a.correlation_id, a.event_key AS src, b.event_key AS dst, (b.t_ms - a.t_ms) AS dt,
  exp(-((b.t_ms - a.t_ms) / 1000.0) / 30.0) * 0.3 + {LINKS} * 0.3 + CASE WHEN a.job_id = b.job_id THEN 0.95 WHEN a.user_id = b.user_id THEN 0.3 ELSE 0.0 END * 0.2 AS confidence
  FROM typed a JOIN typed b ON a.correlation_id = b.correlation_id AND b.t_ms >= a.t_ms AND b.t_ms - a.t_ms <= 300000 AND (a.t_ms < b.t_ms OR a.event_key < b.event_key))"""


def events(t):
    rows = t.trace_events()
    kind = classify_event(F.col("component"), F.col("severity"), F.col("message"))
    return trace.conform(rows.withColumn("event_type", kind))


@query("event_types", "K3", "trace_events", f"WITH {TYPED} SELECT component, event_type, count(*) AS n FROM typed GROUP BY 1, 2")
def event_types(t):
    return events(t).groupBy("component", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("id_index", "K1 B31", "log_lines", "SELECT correlation_id, session_id, path, line_no FROM log_lines")
def id_index(t):
    return trace.build_id_index(t.lines())


@query("events_of_ids", "D2 K2", "log_lines", """
SELECT correlation_id, session_id, path, line_no, component, severity, message, CAST(NULL AS STRING) AS job_id, substring(md5(concat(path, ':', CAST(line_no AS STRING), ':', correlation_id)), 1, 16) AS event_id,
  epoch_ms(date_trunc('second', ts)) AS t_ms FROM log_lines WHERE correlation_id IN (SELECT correlation_id FROM log_lines WHERE status >= 500)""")
def events_of_ids(t):
    lines = t.log_lines()
    wanted = lines.where("status >= 500").select("correlation_id")
    parsed = with_fields(lines.select("session_id", "path", "line_no", "content", "component"))
    parsed = parsed.withColumn("ts", field("time").try_cast("timestamp")).withColumn("severity", field("severity")).withColumn("message", field("message"))
    found = trace.to_events(trace.events_for_ids(trace.build_id_index(lines), parsed, wanted))
    return found.select("correlation_id", "session_id", "path", "line_no", "component", "severity", "message", "job_id", "event_id", "t_ms")


EDGES_SQL = f"WITH {TYPED}, {PAIRS} SELECT correlation_id, src, dst, round(confidence, 8) AS confidence FROM pairs WHERE confidence > 0.5"


@query("causal_edges", "D3 K5", "trace_events", EDGES_SQL)
def causal_edges(t):
    return trace.causal_edges(events(t)).withColumn("confidence", F.round("confidence", 8))


@query("causal_edges_of_busy_ids", "D3 K5", "trace_events", EDGES_SQL)
def causal_edges_of_busy_ids(t):
    """Every id with more than two events per window takes the routed join; the edges must not change."""
    return trace.causal_edges(events(t), busy=2).withColumn("confidence", F.round("confidence", 8))


@query("causality_of_pairs", "K4 K5", "trace_events", f"""
WITH {TYPED}, {PAIRS} SELECT correlation_id, count(*) AS pairs, round(sum(confidence), 4) AS total, count(*) FILTER (causal) AS causal FROM (
  SELECT p.*, (dt <= 60000 AND x.component || '>' || y.component IN ('rails>sidekiq','rails>gitaly','sidekiq>gitaly','sidekiq>postgresql','gitaly>postgresql','workhorse>gitaly','workhorse>rails')) OR coalesce(x.job_id = y.job_id, FALSE) AS causal
  FROM pairs p JOIN typed x ON p.src = x.event_key JOIN typed y ON p.dst = y.event_key) z GROUP BY 1""")
def causality_of_pairs(t):
    rows = events(t).select("correlation_id", *trace.PAIR_COLUMNS)
    on = (F.col("a.correlation_id") == F.col("b.correlation_id")) & (F.struct("a.t_ms", "a.event_key") < F.struct("b.t_ms", "b.event_key"))
    near = rows.alias("a").join(rows.alias("b"), on).where(F.col("b.t_ms") - F.col("a.t_ms") <= 300000)
    rows = near.select("a.correlation_id", causality("a", "b").alias("p"), is_causal("a", "b").alias("c"))
    return rows.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("p"), 4).alias("total"), F.count_if("c").alias("causal"))


NAMES = ["rails", "workhorse", "sidekiq", "gitaly", "postgresql"]
PICK = lambda of: "CASE " + of + " " + " ".join(f"WHEN '{n}' THEN r.{n}" for n in NAMES) + " END"
# Clocks event by event: one column per component, carried along each id.
CLOCKS = f"""o AS MATERIALIZED (SELECT *, row_number() OVER w AS n, lag(component) OVER w AS pc, coalesce((t_ms - lag(t_ms) OVER w <= 60000 AND lag(component) OVER w || '>' || component IN
  ('rails>sidekiq','rails>gitaly','sidekiq>gitaly','sidekiq>postgresql','gitaly>postgresql','workhorse>gitaly','workhorse>rails')) OR job_id = lag(job_id) OVER w, FALSE) AS causal FROM typed WINDOW w AS (PARTITION BY correlation_id ORDER BY t_ms, event_key)),
r AS (SELECT correlation_id, n, event_key, 1 AS lamport, {", ".join(f"CASE WHEN component = '{x}' THEN 1 ELSE 0 END AS {x}" for x in NAMES)} FROM o WHERE n = 1 UNION ALL
 SELECT correlation_id, n, event_key, c, {", ".join(f"CASE WHEN component = '{x}' THEN c ELSE {x} END" for x in NAMES)} FROM (
  SELECT o.correlation_id, o.n, o.event_key, o.component, {", ".join(f"r.{x}" for x in NAMES)}, CASE WHEN o.causal THEN greatest({PICK("o.component")} + 1, {PICK("o.pc")}) + 1 ELSE {PICK("o.component")} + 1 END AS c
  FROM r JOIN o ON o.correlation_id = r.correlation_id AND o.n = r.n + 1) x),
clk AS (SELECT r.correlation_id, r.event_key, r.lamport, row_number() OVER (PARTITION BY r.correlation_id ORDER BY r.lamport, t_ms, r.event_key) AS causal_rank FROM r JOIN typed USING (event_key))"""


@query("logical_clocks", "F6 F7", "trace_events", f"WITH RECURSIVE {TYPED}, {CLOCKS} SELECT correlation_id, event_key, CAST(lamport AS BIGINT) AS lamport, causal_rank FROM clk")
def logical_clocks(t):
    return trace.causal_rank(trace.lamport(events(t))).select("correlation_id", "event_key", "lamport", "causal_rank")


# Longest ways by following the edges: forward from every event, backward from those without effects.
CPM = """edges AS MATERIALIZED (SELECT correlation_id, src, dst FROM pairs WHERE confidence > 0.5),
f AS (SELECT event_key, CAST(0 AS DOUBLE) AS es, 0 AS depth FROM typed UNION
  SELECT e.dst, f.es + t.dur_ms, f.depth + 1 FROM f JOIN edges e ON e.src = f.event_key JOIN typed t ON t.event_key = e.src),
es AS MATERIALIZED (SELECT event_key, max(es) AS es, max(depth) AS depth FROM f GROUP BY 1),
b AS (SELECT event_key, es AS ls FROM es WHERE event_key NOT IN (SELECT src FROM edges) UNION
  SELECT e.src, b.ls - t.dur_ms FROM b JOIN edges e ON e.dst = b.event_key JOIN typed t ON t.event_key = e.src),
ls AS (SELECT event_key, min(ls) AS ls FROM b GROUP BY 1),
cpm AS (SELECT t.correlation_id, t.event_key, es, ls, abs(ls - es) < 0.001 AS is_critical, depth, row_number() OVER (PARTITION BY t.correlation_id ORDER BY depth, t.t_ms, t.event_key) AS position FROM typed t JOIN es USING (event_key) JOIN ls USING (event_key))"""
CPM_SQL = f"""WITH RECURSIVE {TYPED}, {PAIRS}, {CPM}
SELECT correlation_id, event_key, round(es, 3) AS earliest_start, round(ls, 3) AS latest_start, is_critical, CAST(depth AS BIGINT) AS depth, position FROM cpm"""


@query("critical_path", "F10 F11", "trace_events", CPM_SQL)
def critical_path(t):
    paths = trace.topological_order(trace.critical_path(events(t)))
    return paths.select("correlation_id", "event_key", F.round("earliest_start", 3).alias("earliest_start"), F.round("latest_start", 3).alias("latest_start"), "is_critical", "depth", "position")


CHAINS_SQL = f"""WITH RECURSIVE {TYPED}, {PAIRS}, {CPM}, {CLOCKS},
a AS (SELECT t.*, c.causal_rank, m.es, m.is_critical, t.t_ms - lag(t.t_ms) OVER (PARTITION BY t.correlation_id ORDER BY t.t_ms, t.event_key) > 60000 AS gap FROM typed t JOIN clk c USING (event_key) JOIN cpm m USING (event_key))
SELECT correlation_id, count(*) AS event_count, coalesce(min_by(event_key, (es, causal_rank)) FILTER (is_critical AND event_type IN ('error', 'query_error')), min_by(event_key, causal_rank) FILTER (severity IN ('ERROR', 'FATAL'))) AS root_cause,
 min_by(event_key, causal_rank) FILTER (severity IN ('ERROR', 'FATAL') OR event_type = 'query_error') AS failure_point, coalesce(bool_or(gap), FALSE) AS has_gap, FALSE AS is_complete, count(*) FILTER (is_critical) AS critical_events, round(max(es), 3) AS path_ms FROM a GROUP BY 1"""


@query("chains", "K6", "trace_events", CHAINS_SQL)
def chains(t):
    rows = trace.trace_chains(events(t), sizes_from=t.trace_ids())
    return rows.select("correlation_id", "event_count", "root_cause", "failure_point", "has_gap", "is_complete", "critical_events", F.round("path_ms", 3).alias("path_ms"))


@query("chain_statistics", "E20", "trace_events", f"""
WITH {TYPED} SELECT correlation_id, max(t_ms) - min(t_ms) AS total_ms, count(*) AS event_count, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'job_fail' THEN job_id END) AS failed_jobs,
 count(*) FILTER (severity = 'ERROR') AS error_count, count(*) FILTER (severity = 'WARNING') AS warning_count, bool_or(severity IN ('ERROR', 'FATAL')) AS has_errors FROM typed GROUP BY 1""")
def chain_statistics(t):
    return trace.chain_stats(events(t)).select("correlation_id", "total_ms", "event_count", "users", "failed_jobs", "error_count", "warning_count", "has_errors")


@query("chain_users", "E20", "trace_events", "SELECT DISTINCT correlation_id, user_id FROM trace_events")
def chain_users(t):
    return trace.chain_members(events(t), "user_id")


@query("chain_time_by_component", "E21 K8", "trace_events", """
WITH c AS (SELECT correlation_id, max(t_ms) - min(t_ms) AS total_ms FROM trace_events GROUP BY 1)
SELECT e.correlation_id, component, count(*) AS events, CAST(sum(dur_ms) AS DOUBLE) AS time_ms, total_ms, round(CASE WHEN total_ms > 0 THEN sum(dur_ms) * 100.0 / total_ms ELSE 0.0 END, 6) AS share_pct
FROM trace_events e JOIN c ON e.correlation_id = c.correlation_id GROUP BY 1, 2, total_ms""")
def chain_time_by_component(t):
    rows = events(t)
    return trace.time_share(trace.chain_breakdown(rows, "component"), trace.chain_stats(rows)).withColumn("share_pct", F.round("share_pct", 6))


@query("chain_severities", "E21", "trace_events", "SELECT correlation_id, severity, count(*) AS events, CAST(sum(dur_ms) AS DOUBLE) AS time_ms FROM trace_events GROUP BY 1, 2")
def chain_severities(t):
    return trace.chain_breakdown(events(t), "severity")


@query("id_catalogue", "E22", "trace_events", """
SELECT correlation_id, count(*) AS event_count, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT component AS c FROM trace_events x WHERE x.correlation_id = e.correlation_id) y) AS components,
 bool_or(severity IN ('ERROR', 'FATAL')) AS has_errors FROM trace_events e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def id_catalogue(t):
    return trace.id_catalog(events(t), 100).withColumn("components", F.concat_ws(",", "components"))


@query("chain_gaps", "F8 K7", "trace_events", """
WITH g AS (SELECT correlation_id, t_ms - lag(t_ms) OVER (PARTITION BY correlation_id ORDER BY t_ms, event_key) > 60000 AS gap FROM trace_events)
SELECT correlation_id, FALSE AS has_start, FALSE AS has_end, coalesce(bool_or(gap), FALSE) AS has_gap, FALSE AS is_complete FROM g GROUP BY 1""")
def chain_gaps(t):
    return trace.is_complete(events(t))


@query("failure_points", "F9", "trace_events", f"""
WITH {TYPED} SELECT correlation_id, min_by(event_key, t_ms * 1000000 + line_rank) AS failure_point FROM (SELECT *, row_number() OVER (PARTITION BY correlation_id ORDER BY t_ms, event_key) AS line_rank FROM typed) x
WHERE severity IN ('ERROR', 'FATAL') OR event_type IN ('query_error', 'rpc_error', 'job_fail') GROUP BY 1""")
def failure_points(t):
    rows = events(t).withColumn("causal_rank", F.col("t_ms")).withColumn("earliest_start", F.lit(0.0)).withColumn("is_critical", F.lit(False))
    return trace.root_and_failure(rows).where("failure_point is not null").select("correlation_id", "failure_point")
