"""Queries: error detection, classification and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.error_rules import candidate_line, gate_words, is_false_positive, monitoring_source, pattern_rows, scannable_files
from ..functions.fields import with_fields
from ..functions.severity import classify_json, word_severity
from ..operators import errors, search
from ..operators.blocks import CONTINUATION, END, START, block_bounds, block_format, error_blocks, first_per_block, stack_trace
from ..operators.ordered import number_rows
from .queries_search import file_catalog
from .registry import query



def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# what the derived lines must match: harmless INFO lines drop out, the rest by the best pattern
MATCHED = """matched AS (SELECT *, CASE WHEN contains(message, 'deadlock') THEN 'postgres_deadlock' WHEN contains(message, 'lock timeout') THEN 'postgres_lock_timeout'
  WHEN contains(message, 'could not connect') THEN 'postgres_connect_refused' END AS pattern_id FROM log_lines WHERE severity IN ('ERROR', 'FATAL')),
found AS (SELECT *, 'PostgreSQL' AS pattern_component, 'ERROR' AS pattern_severity, concat(pattern_id, ':', CASE WHEN length(m) > 100 THEN concat(substring(m, 1, 100), '~', md5(m)) ELSE m END) AS signature FROM (SELECT *, regexp_replace(message, '\\b[0-9]+\\b', 'N', 'g') AS m FROM matched) y)"""


@query("pattern_matches", "D1 I1 C22 C24", "log_lines", f"""
WITH {MATCHED} SELECT session_id, path, line_no, pattern_id, pattern_component AS component, pattern_severity AS severity FROM found""")
def pattern_matches(t):
    return errors.match_patterns(t.lines()).select("session_id", "path", "line_no", "pattern_id", "component", "severity")


@query("error_scan", "I2 B35 B36 D6 F2 F3", "log_lines", f"""
WITH {MATCHED}, r AS (SELECT session_id, path, correlation_id, count(*) AS related FROM log_lines GROUP BY 1, 2, 3)
SELECT f.session_id, f.path, line_no, pattern_id, message, f.correlation_id, CAST(status AS STRING) AS error_code, signature, related, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  'postgresql' AS node, line_no AS block_start, line_no AS block_end FROM found f JOIN r ON f.session_id = r.session_id AND f.path = r.path AND f.correlation_id = r.correlation_id""")
def error_scan(t):
    return errors.scan_errors(t.stored_lines()).select(
        "session_id", "path", "line_no", "pattern_id", "message", "correlation_id", "error_code", "signature", "related",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "node", "block_start", "block_end",
    )


@query("error_groups", "E1 I3 G3", "log_lines", f"""
WITH {MATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY session_id, path, line_no) AS rn FROM found)
SELECT signature, count(*) AS count, min(message) FILTER (rn = 1) AS message, 'ERROR' AS severity, 'PostgreSQL' AS component, min(pattern_id) AS pattern_id, TRUE AS has_correlation,
  FALSE AS has_stack_trace, count(DISTINCT session_id || path) AS file_count, string_agg(session_id || ':' || CAST(line_no AS STRING), '|' ORDER BY rn) FILTER (rn <= 3) AS samples FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def error_groups(t):
    top = errors.error_report(errors.scan_errors(t.stored_lines(), related=False))["top"]
    shown = F.transform("samples", lambda s: F.concat_ws(":", s["session_id"], s["line_no"]))
    return top.withColumn("samples", F.concat_ws("|", shown))


@query("error_group_files", "E1", "log_lines", f"WITH {MATCHED} SELECT signature, session_id, path, count(*) AS count FROM found GROUP BY 1, 2, 3")
def error_group_files(t):
    return errors.error_group_files(errors.scan_errors(t.stored_lines(), related=False))


@query("error_counts_by_severity", "E2", "log_lines", f"WITH {MATCHED} SELECT pattern_severity AS severity, count(*) AS count FROM found GROUP BY 1")
def error_counts_by_severity(t):
    return errors.error_counts(errors.match_patterns(t.lines()), "severity")


@query("problem_groups", "E3 C20 H3", "log_lines", f"""
WITH {MATCHED}, g AS (SELECT signature, count(*) AS count, min_by(message, (session_id, path, line_no)) AS message FROM found GROUP BY 1)
SELECT 'PostgreSQL' AS component, 'ERROR' AS severity, regexp_replace(message, '\\b[0-9]+\\b', 'N', 'g') AS text, CAST(sum(count) AS BIGINT) AS total_count, count(*) AS problems FROM g
WHERE contains(lower(message), 'lock') AND count >= 10 GROUP BY 3""")
def problem_groups(t):
    groups = errors.error_report(errors.scan_errors(t.stored_lines(), related=False))["groups"]
    regular, _ = errors.split_monitoring(groups)
    kept = errors.filter_problems(regular, severity="error", component="PostgreSQL", text="LOCK", min_count=10)
    return errors.problem_groups(kept).select("component", "severity", "text", "total_count", "problems")


CLASSES = """c AS (SELECT *, CASE WHEN contains(message, 'deadlock') OR severity = 'FATAL' THEN 'critical' WHEN component = 'postgresql' THEN 'error'
  WHEN component = 'sidekiq' AND contains(content, 'dead') THEN 'error' WHEN severity = 'WARN' THEN 'warning' END AS cls,
 CASE WHEN severity = 'FATAL' THEN 'FATAL' WHEN contains(message, 'deadlock') THEN 'deadlock' WHEN contains(message, 'connection refused') THEN 'connection refused'
  WHEN component = 'postgresql' THEN 'canceling statement' WHEN component = 'sidekiq' AND contains(content, 'dead') THEN 'dead' WHEN severity = 'WARN' THEN 'WARN' END AS matched FROM log_lines)"""


@query("line_classes", "I4", "log_lines", f"""
WITH {CLASSES} SELECT component, coalesce(cls, 'none') AS severity, coalesce(matched, 'none') AS matched, cls IN ('critical', 'error') AND cls IS NOT NULL AS is_error,
 CASE cls WHEN 'critical' THEN 'critical_error' WHEN 'error' THEN concat(component, '_error') WHEN 'warning' THEN 'warning' ELSE 'none' END AS category, count(*) AS n FROM c GROUP BY 1, 2, 3, 4, 5""")
def line_classes(t):
    rows = errors.classified_lines(t.log_lines(numbered=False).select("component", "content"))
    named = [F.coalesce(c, F.lit("none")).alias(c) for c in ("severity", "matched", "category")]
    return rows.groupBy("component", "is_error", *named).agg(F.count(F.lit(1)).alias("n"))


@query("error_summary", "E4", "log_lines", f"""
WITH {CLASSES}, e AS (SELECT * FROM c WHERE cls IN ('critical', 'error'))
SELECT 'total' AS part, 'errors' AS key, CAST((SELECT count(*) FROM e) AS DOUBLE) AS value UNION ALL
SELECT 'total', 'rate', round((SELECT count(*) FROM e) * 100.0 / (SELECT count(*) FROM c), 2) UNION ALL
SELECT 'severity', cls, CAST(count(*) AS DOUBLE) FROM e GROUP BY 2 UNION ALL
SELECT 'category', CASE cls WHEN 'critical' THEN 'critical_error' ELSE concat(component, '_error') END, CAST(count(*) AS DOUBLE) FROM e GROUP BY 2 UNION ALL
SELECT 'pattern', matched, CAST(count(*) AS DOUBLE) FROM e GROUP BY 2""")
def error_summary(t):
    return errors.error_summary(errors.classified_lines(t.log_lines(numbered=False).select("component", "content")))


@query("json_line_classes", "I5", "log_lines", """
SELECT component, coalesce(CASE severity WHEN 'FATAL' THEN 'critical' WHEN 'ERROR' THEN 'error' WHEN 'WARN' THEN 'warning' END, 'none') AS severity,
 coalesce(CASE severity WHEN 'FATAL' THEN 'json_fatal' WHEN 'ERROR' THEN 'json_error' WHEN 'WARN' THEN 'json_warning' END, 'none') AS category, severity IN ('FATAL', 'ERROR') AS is_error, count(*) AS n FROM log_lines GROUP BY 1, 2, 3, 4""")
def json_line_classes(t):
    rows = with_fields(t.log_lines(numbered=False).select("component", "content")).select("component", classify_json().alias("c"))
    none = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit("none")).alias(c)
    return rows.groupBy("component", none("severity"), none("category"), F.col("c.is_error").alias("is_error")).agg(F.count(F.lit(1)).alias("n"))


@query("quick_error_scan", "I6", "log_lines", "SELECT session_id, path, line_no FROM log_lines WHERE status >= 500")
def quick_error_scan(t):
    return errors.quick_scan(t.lines())


@query("word_severities", "I7", "text_lines", """
SELECT session_id, CASE WHEN regexp_matches(l, 'fatal|panic|critical|emergency') THEN 'critical' WHEN regexp_matches(l, 'error|fail|exception|traceback') THEN 'error'
 WHEN regexp_matches(l, 'warn|deprecated') THEN 'warning' WHEN regexp_matches(l, 'info|notice') THEN 'info' ELSE 'debug' END AS severity, count(*) AS n FROM (SELECT session_id, lower(content) AS l FROM text_lines) x GROUP BY 1, 2""")
def word_severities(t):
    return t.text_lines().groupBy("session_id", word_severity(F.col("content")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("log_formats", "I9", "log_lines", "SELECT session_id, path, 'json' AS format FROM log_lines GROUP BY 1, 2")
def log_formats(t):
    return errors.detect_format(t.lines())


@query("plain_formats", "I9", "text_lines", """
SELECT session_id, path, CASE WHEN count(*) FILTER (contains(content, '=') AND NOT starts_with(trim(content), '{')) > count(*) * 0.5 THEN 'structured' ELSE 'plain' END AS format
FROM text_lines WHERE trim(content) <> '' AND line_no <= 100 GROUP BY 1, 2""")
def plain_formats(t):
    return errors.detect_format(t.text_lines())


@query("detected_components", "B24", "log_lines", "SELECT session_id, path, CASE WHEN path LIKE '%rails%' THEN 'gitlab-rails' WHEN path LIKE '%workhorse%' THEN 'workhorse' WHEN path LIKE '%sidekiq%' THEN 'sidekiq' WHEN path LIKE '%gitaly%' THEN 'gitaly' ELSE 'postgresql' END AS component FROM log_lines GROUP BY 1, 2, 3")
def detected_components(t):
    return errors.detect_component(t.lines())


@query("harmless_lines", "C22", "log_lines", "SELECT severity, count(*) AS lines, count(*) FILTER (severity = 'INFO') AS harmless FROM log_lines GROUP BY 1")
def harmless_lines(t):
    rows = t.log_lines(numbered=False).select("severity", is_false_positive().alias("harmless"))
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("lines"), F.count_if("harmless").alias("harmless"))


@query("scannable_files", "C23 D11", "log_lines", "SELECT DISTINCT session_id, path FROM log_lines")
def scannable_file_list(t):
    files = file_catalog(t).select("session_id", "path")
    dumps = files.select("session_id", F.concat("path", F.lit(".schema_dump")).alias("path"))
    return scannable_files(search.union_hits(files, dumps))


GATE = "|".join(gate_words([r[1] for r in pattern_rows()]))


@query("candidate_lines", "C24", "log_lines", f"SELECT severity, count(*) AS n FROM log_lines WHERE regexp_matches(lower(content), '{GATE}') GROUP BY 1".replace("'s", "''s"))
def candidate_lines(t):
    rows = t.log_lines(numbered=False).where(candidate_line([r[1] for r in pattern_rows()]))
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("monitoring_lines", "C25", "log_lines", """
SELECT CASE WHEN k < 30 THEN 'prometheus' WHEN k < 40 THEN 'loki' ELSE 'none' END AS source, count(*) AS n FROM log_lines GROUP BY 1""")
def monitoring_lines(t):
    text = F.concat(F.when(F.col("k") < 30, "Prometheus: ").when(F.col("k") < 40, "caller=loki ").otherwise("prometheus "), "content")
    rows = t.log_lines(numbered=False).select(text.alias("content")).select(F.coalesce(monitoring_source(), F.lit("none")).alias("source"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


LETTERS = """l AS MATERIALIZED (SELECT session_id, path, line_no, content, regexp_matches(content, '(?i)error|password|license|er') AS m, regexp_matches(content, $cont$) AS c, regexp_matches(content, $start$) AS s, regexp_matches(content, $end$) AS e, regexp_full_match(content, '[ \\t\\n\\v\\f\\r]*') AS blank FROM text_lines),
letters AS MATERIALIZED (SELECT session_id, path, line_no, content, m, CASE WHEN e THEN 'E' WHEN c THEN 'C' WHEN blank THEN 'B' ELSE 'N' END AS f,
 CASE WHEN line_no = 1 THEN CASE WHEN c THEN 'X' ELSE 'N' END WHEN s AND c THEN 'X' WHEN s THEN 'S' WHEN c THEN 'C' WHEN blank THEN 'B' ELSE 'N' END AS b FROM l),
seen AS MATERIALIZED (SELECT *, f <> 'C' AND NOT (f = 'B' AND coalesce(lead(f) OVER w, 'N') = 'C') AS stops, max(line_no) OVER (PARTITION BY session_id, path) AS last FROM letters WINDOW w AS (PARTITION BY session_id, path ORDER BY line_no)),
reach AS MATERIALIZED (SELECT *, min(CASE WHEN stops THEN line_no END) OVER (PARTITION BY session_id, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop, min(CASE WHEN f <> 'B' THEN line_no END) OVER n AS filled,
 max(CASE WHEN b NOT IN ('C', 'B') THEN line_no END) OVER (PARTITION BY session_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wall, min(CASE WHEN b = 'C' THEN line_no END) OVER n AS lead
 FROM seen WINDOW n AS (PARTITION BY session_id, path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""".replace("$cont$", sql_text(CONTINUATION)).replace("$start$", sql_text(START)).replace("$end$", sql_text(END))


@query("error_block_bounds", "F2 F4", "text_lines", f"""
WITH {LETTERS}
SELECT h.session_id, h.path, h.line_no, CASE WHEN wall.b = 'X' THEN h.wall + 1 WHEN wall.lead < h.line_no THEN wall.lead ELSE h.line_no END AS block_start,
 CASE WHEN filled.f = 'C' THEN coalesce(CASE WHEN stop.f = 'B' THEN stop.line_no ELSE stop.line_no - 1 END, h.last) ELSE h.line_no END AS block_end,
 CASE WHEN starts_with(trim(h.content), '{{') AND contains(h.content, '"level"') THEN 'json' WHEN regexp_matches(h.content, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN 'timestamp' WHEN starts_with(h.content, 'E, [') OR starts_with(h.content, 'I, [') THEN 'ruby'
  WHEN contains(h.content, 'Traceback') THEN 'python_stack' WHEN regexp_matches(h.content, 'goroutine|\\.go:') THEN 'go_stack' ELSE 'text' END AS format
FROM reach h LEFT JOIN reach wall ON wall.session_id = h.session_id AND wall.path = h.path AND wall.line_no = h.wall
LEFT JOIN reach filled ON filled.session_id = h.session_id AND filled.path = h.path AND filled.line_no = h.filled
LEFT JOIN reach stop ON stop.session_id = h.session_id AND stop.path = h.path AND stop.line_no = filled.stop WHERE h.m""")
def error_block_bounds(t):
    rows = t.text_lines().select("session_id", "path", "line_no", "content", block_format(F.col("content")).alias("format"))
    return block_bounds(rows, F.col("content").rlike("(?i)error|password|license|er"), ["format"]).drop("covered")


@query("error_block_lines", "F2 F3", "kube_events", """
WITH n AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n FROM kube_events), m AS (SELECT session_id, max(n) AS last FROM n GROUP BY 1)
SELECT n.session_id, n AS line_no, n AS block_start, least(n + 3, last) AS block_end, CAST(least(n + 3, last) - n + 1 AS BIGINT) AS block_lines FROM n JOIN m ON n.session_id = m.session_id WHERE n % 5 = 1""")
def error_block_lines(t):
    """Every fifth line is an error with three frames below it; the second frame matches too, inside that block."""
    rows = number_rows(t.kube_events(), ["session_id"], ["line_no"], F.floor(F.col("line_no") / 4096), "n")
    text = F.when(F.col("n") % 5 == 1, F.concat(F.lit("ERROR boom "), "n")).when(F.col("n") % 5 == 0, "plain").otherwise(F.concat(F.lit("  at frame"), "n"))
    lines = rows.select("session_id", F.lit("app.log").alias("path"), F.col("n").alias("line_no"), text.alias("content"))
    found = first_per_block(error_blocks(lines, (F.col("line_no") % 5).isin(1, 3)))
    return found.select("session_id", "line_no", "block_start", "block_end", F.size("block").cast("bigint").alias("block_lines"))


@query("stack_traces", "B37", "log_lines", """
SELECT event_id, concat('Traceback here|File "x.py", line ', CAST(k AS STRING), '|raise ', severity) AS python, concat('a.b.Exception: ', severity, '|at f(', CAST(k AS STRING), ')') AS java,
 concat('panic: ', severity, '|main.go:', CAST(k AS STRING)) AS go FROM log_lines""")
def stack_traces(t):
    k, sev = F.col("k").cast("string"), F.col("severity")
    block = F.array(
        F.lit("head"), F.lit("Traceback here"), F.concat(F.lit('  File "x.py", line '), k), F.concat(F.lit("    raise "), sev), F.lit("ValueError"), F.lit("  tail"),
    )
    java = F.array(F.lit("x"), F.concat(F.lit("a.b.Exception: "), sev), F.concat(F.lit("   at f("), k, F.lit(")")))
    go = F.array(F.concat(F.lit("panic: "), sev), F.lit("x"), F.concat(F.lit("  main.go:"), k))
    shown = [F.array_join(stack_trace(b, F.lit(f"{n}_stack")), "|").alias(n) for n, b in (("python", block), ("java", java), ("go", go))]
    return t.log_lines(numbered=False, texts=False).select("event_id", *shown)
