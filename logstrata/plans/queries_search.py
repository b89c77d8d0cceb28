"""Queries: parsing, predicates, search, histogram, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.fields import compute_once, field, flatten_fields, kv_pairs, parse_json, text_field, with_fields
from ..functions.paths import component_of, file_type, is_log_file, log_type_of, node_of, service_of, suitable
from ..functions.text import (
    clean_line, correlation_ids, error_signature, extract_ts, is_variable, match_hash, normalize_message, parse_bytes,
    parse_duration, parse_size_mb, safe_double,
)
from ..operators import profile, search
from .derived import TASK_LINES_OF_FIELDS
from .registry import query

# the JSON of a log line is known, so its fields are plain columns for the oracle
HIT = "SELECT event_id, session_id, path, status, severity FROM log_lines WHERE "


def hits(t, condition):
    rows = with_fields(t.log_lines(numbered=False)).where(condition)
    return rows.select("event_id", "session_id", "path", "status", "severity")


def predicate(name, ops, where, condition):
    query(name, ops, "log_lines", HIT + where)(lambda t: hits(t, condition()))


predicate("line_contains", "C1", "contains(lower(content), 'lock timeout')", lambda: p.contains("LOCK Timeout"))
predicate("line_not_contains", "C1", "NOT contains(lower(content), 'completed')", lambda: p.not_contains("Completed"))
predicate("line_regex", "C2", "regexp_matches(content, '(?i)worker[02] done')", lambda: p.regex(r"worker[02] done"))
predicate("field_equals", "C3", "lower(severity) = 'warn'", lambda: p.eq("severity", "Warn"))
predicate("field_equals_wildcard", "C3", "regexp_matches(message, '^Completed .* for user 1. in.*$')", lambda: p.eq("message", "completed * for user 1? in*"))
predicate("field_not_equals", "C4", "severity <> 'INFO'", lambda: p.neq("severity", "info"))
predicate("missing_field_not_equals", "C4", "TRUE", lambda: p.neq("absent_field", "x"))
predicate("field_greater", "C5", "status > 500", lambda: p.gt("status", 500))
predicate("field_between", "C5", "dur_ms >= 500 AND dur_ms <= 900", lambda: p.all_of(p.gte("duration_ms", 500), p.lte("duration_ms", 900)))
predicate("field_less", "C5", "k < 3", lambda: p.lt("ctx.k", 3))
predicate("field_contains", "C6", "contains(concat('u', CAST(user_id AS STRING)), '7')", lambda: p.field_contains("meta.user", "7"))
predicate("field_not_contains", "C6", "NOT contains(lower(message), 'user')", lambda: p.field_not_contains("message", "user"))
predicate("field_regex", "C7", "regexp_matches(message, 'in [0-9]{5,} ms$')", lambda: p.field_regex("message", r"in [0-9]{5,} ms$"))
predicate("field_invalid_regex", "C7", "FALSE", lambda: p.field_regex("message", "(unclosed"))
predicate("field_not_regex", "C8", "NOT regexp_matches(severity, '(?i)info|warn')", lambda: p.field_not_regex("severity", "info|warn"))
predicate("field_in_list", "C9", "severity = 'FATAL' OR severity LIKE 'W%'", lambda: p.is_in("severity", ["fatal", "W*"]))
predicate("field_not_in_list", "C9", "status NOT IN (200, 201, 404)", lambda: p.not_in("status", [200, 201, 404]))
predicate("field_exists", "C10", "TRUE", lambda: p.exists("meta.user"))
predicate("field_not_exists", "C10", "FALSE", lambda: p.not_exists("meta.user"))
predicate("field_is_null", "C11", "FALSE", lambda: p.eq("status", None))
predicate("field_is_not_null", "C11", "TRUE", lambda: p.neq("status", None))
predicate(
    "predicate_tree", "C13 B3",
    "(status >= 500 OR (severity = 'WARN' AND k >= 95)) AND NOT (user_id % 3 = 1 AND contains(message, 'deadlock'))",
    lambda: p.all_of(
        p.any_of(p.gte("status", 500), p.all_of(p.eq("severity", "warn"), p.gte("ctx.k", 95))),
        p.negate(p.all_of(F.col("session_id") == "node1", p.contains("deadlock"))),
    ),
)
predicate("empty_predicate_tree", "C13", "FALSE", lambda: p.all_of())
predicate(
    "condition_tree", "C15", "(severity <> 'INFO' AND dur_ms > 200 AND NOT contains(content, 'deadlock')) OR status <= 200 AND k = 7",
    lambda: p.json_condition({"type": "OR", "children": [
        {"type": "AND", "children": [
            {"type": "FIELD_NEQ", "field": "severity", "value": "info"}, {"type": "FIELD_GT", "field": "duration_ms", "value": 200},
            {"type": "NOT", "child": {"type": "TEXT", "value": "deadlock"}}]},
        {"type": "AND", "children": [
            {"type": "FIELD_LTE", "field": "status", "value": 200}, {"type": "FIELD_EQ", "field": "ctx.k", "value": 7}]}]}),
)


def file_catalog(t):
    """The files of the derived log lines, with what their paths say."""
    files = t.log_lines(numbered=False).groupBy("session_id", "path").agg(
        F.sum(F.length("content") + 1).alias("size"), F.count(F.lit(1)).alias("line_count")
    )
    kind = log_type_of(F.col("path"))
    return (
        files.withColumn("_kind", kind)
        .withColumn("service", service_of(F.col("path")))
        .withColumn("component", F.coalesce("_kind.component", component_of(F.col("path"))))
        .withColumn("log_type", F.col("_kind.log_type")).withColumn("format", F.coalesce("_kind.format", F.lit("unknown")))
        .withColumn("file_type", file_type(F.col("path"))).withColumn("is_suitable", suitable(F.col("path"))).drop("_kind")
    )


SERVICE_SQL = """CASE WHEN path LIKE '%production_json.log' THEN 'rails' WHEN path LIKE '%workhorse%' THEN 'workhorse'
  WHEN path LIKE '%/sidekiq/current' THEN 'sidekiq' WHEN path LIKE '%/gitaly/%' THEN 'gitaly' ELSE 'postgresql' END"""


@query("failing_requests_histogram", "B1 C5 C9 C13 E11 E12", "log_lines", """
WITH hits AS (SELECT ts, CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 THEN 'warning' WHEN severity IN ('ERROR','FATAL') THEN 'error'
  WHEN severity = 'WARN' THEN 'warning' ELSE 'info' END AS level FROM log_lines WHERE status >= 400 AND component IN ('rails','postgresql','gitaly')),
p AS (SELECT epoch_us(date_trunc('second', ts)) AS t, level FROM hits),
s AS (SELECT min(t) AS lo, max(t) AS hi, (max(t) - min(t)) / 50.0 AS w FROM p),
c AS (SELECT CAST(least(floor((t - lo) / w), 49) AS BIGINT) AS bucket, count(*) AS total, count(*) FILTER (level = 'error') AS errors,
  count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'info') AS info FROM p, s GROUP BY 1)
SELECT b.bucket, strftime(make_timestamp(CAST(floor(lo + b.bucket * w) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS start,
  coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(info, 0) AS info
FROM (SELECT unnest(range(50)) AS bucket) b CROSS JOIN s LEFT JOIN c ON b.bucket = c.bucket""")
def failing_requests_histogram(t):
    rows = with_fields(t.log_lines(numbered=False).select("session_id", "path", "component", "content"))
    found = rows.where(p.all_of(F.col("component").isin("rails", "postgresql", "gitaly"), p.gte("status", 400)))
    found = found.select(
        field("time").try_cast("timestamp").alias("ts"),
        search.hit_severity(field("status"), field("exception.class"), field("severity")).alias("level"),
    )
    return search.time_histogram(found).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("error_spikes", "E13", "log_lines", """
WITH p AS (SELECT epoch_us(date_trunc('second', ts)) AS t FROM log_lines WHERE status >= 500),
s AS (SELECT min(t) AS lo, max(t) AS hi, (max(t) - min(t)) / 40.0 AS w FROM p),
c AS (SELECT CAST(least(floor((t - lo) / w), 39) AS BIGINT) AS bucket, count(*) AS total FROM p, s GROUP BY 1),
h AS (SELECT b.bucket, coalesce(total, 0) AS total FROM (SELECT unnest(range(40)) AS bucket) b LEFT JOIN c ON b.bucket = c.bucket),
l AS (SELECT avg(total) + 2 * stddev_pop(total) AS lim FROM h)
SELECT bucket, total FROM h, l WHERE total > lim AND total > 5 ORDER BY bucket""")
def error_spikes(t):
    rows = with_fields(t.log_lines(numbered=False)).where(p.gte("status", 500))
    found = rows.select(field("time").try_cast("timestamp").alias("ts"), F.lit("error").alias("level"))
    return search.spikes(search.time_histogram(found, 40)).select("bucket", "total")


@query("json_fields_parsed", "B1 B3", "log_lines",
       "SELECT event_id, status, CAST(k AS STRING) AS k, concat('u', CAST(user_id AS STRING)) AS user_name, CAST(NULL AS STRING) AS absent, message FROM log_lines")
def json_fields_parsed(t):
    v = parse_json(F.concat(F.lit("2024-01-01T00:00:00.123Z "), F.col("content")))
    rows = t.log_lines(numbered=False).select("event_id", v.alias("fields"))
    return rows.select(
        "event_id", field("status").cast("int").alias("status"), field("ctx.k").alias("k"),
        field("meta.user").alias("user_name"), field("ctx.absent").alias("absent"), field("message").alias("message"),
    )


@query("json_fields_flattened", "B2", "log_lines", """
SELECT field, type, count(*) AS n, min(text) AS low, max(text) AS high FROM (
 SELECT 'time' AS field, 'string' AS type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM log_lines UNION ALL
 SELECT 'severity', 'string', severity FROM log_lines UNION ALL SELECT 'status', 'number', CAST(status AS STRING) FROM log_lines UNION ALL
 SELECT 'duration_ms', 'number', CAST(dur_ms AS STRING) FROM log_lines UNION ALL SELECT 'correlation_id', 'string', correlation_id FROM log_lines UNION ALL
 SELECT 'meta.user', 'string', concat('u', CAST(user_id AS STRING)) FROM log_lines UNION ALL SELECT 'ctx.k', 'number', CAST(k AS STRING) FROM log_lines UNION ALL
 SELECT 'ctx', 'object', concat('{"k":', CAST(k AS STRING), '}') FROM log_lines UNION ALL SELECT 'message', 'string', message FROM log_lines) x GROUP BY 1, 2""")
def json_fields_flattened(t):
    lines = t.log_lines(numbered=False, task_rows=TASK_LINES_OF_FIELDS)
    rows = flatten_fields(with_fields(lines.select("content")))
    return rows.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("low"), F.max("text").alias("high"))


@query("key_value_pairs", "B4", "log_lines", """
SELECT key, type, count(*) AS n, max(value) AS high FROM (
 SELECT 'user' AS key, 'number' AS type, CAST(user_id AS STRING) AS value FROM log_lines UNION ALL
 SELECT 'ok', 'boolean', CASE WHEN k < 50 THEN 'true' ELSE 'false' END FROM log_lines UNION ALL
 SELECT 'sev', 'string', severity FROM log_lines) x GROUP BY 1, 2""")
def key_value_pairs(t):
    text = F.concat(F.lit("user="), F.col("user_id"), F.lit(" ok="), F.when(F.col("k") < 50, "true").otherwise("false"), F.lit(" sev:"), F.col("severity"))
    rows = t.log_lines(numbered=False).select(F.explode(kv_pairs(text)).alias("p")).select("p.*")
    return rows.groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))


@query("text_field_forms", "B5", "log_lines", """
SELECT event_id, message AS quoted, severity AS single, CAST(k AS STRING) AS bare, CAST(NULL AS STRING) AS absent FROM log_lines""")
def text_field_forms(t):
    text = F.concat(F.lit("Msg=\""), F.col("message"), F.lit("\" sev: '"), F.col("severity"), F.lit("' K="), F.col("k"))
    return t.log_lines(numbered=False).select(
        "event_id", text_field(text, "msg").alias("quoted"), text_field(text, "sev").alias("single"),
        text_field(text, "k").alias("bare"), text_field(text, "other").alias("absent"),
    )


@query("field_aliases", "B6", "log_lines", "SELECT event_id, message AS msg, lower(severity) AS level, content AS whole FROM log_lines")
def field_aliases(t):
    rows = with_fields(t.log_lines(numbered=False)).select("event_id", p.resolve_field("msg").alias("msg"), F.lower(p.resolve_field("level")).alias("level"), "content")
    plain = rows.withColumn("fields", F.lit(None).cast("variant"))
    return plain.select("event_id", "msg", "level", p.resolve_field("message").alias("whole"))


@query("normalized_messages", "B13", "log_lines", """
SELECT n, count(*) AS lines FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  concat(message, ' (', CAST(k AS STRING), '): ', correlation_id, ' ', substring(CAST(ts AS STRING), 1, 19), ' ', CAST(k AS STRING), '.5 ms'),
  '\\b[a-f0-9]{32}\\b', '<CORRELATION_ID>', 'g'),
  '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}', '<TIMESTAMP>', 'g'), '\\([0-9]+\\):', '(<ID>):', 'g'),
  '\\b[0-9]+\\.[0-9]+ ms\\b', '<DURATION>', 'g') AS n0, regexp_replace(n0, '\\b[0-9]{6,}\\b', '<ID>', 'g') AS n FROM log_lines) x GROUP BY 1""")
def normalized_messages(t):
    text = F.concat("message", F.lit(" ("), "k", F.lit("): "), "correlation_id", F.lit(" "), F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), "k", F.lit(".5 ms"))
    return t.log_lines(numbered=False).groupBy(normalize_message(text).alias("n")).agg(F.count(F.lit(1)).alias("lines"))


@query("error_signatures", "B14", "log_lines", """
SELECT sig, count(*) AS n FROM (SELECT concat(component, ':', CASE WHEN length(m) > 100 THEN concat(substring(m, 1, 100), '~', md5(m)) ELSE m END) AS sig FROM (SELECT component, regexp_replace(message, '\\b[0-9]+\\b', 'N', 'g') AS m FROM log_lines) y) x GROUP BY 1""")
def error_signatures(t):
    rows = t.log_lines(numbered=False).select(error_signature(F.col("component"), F.col("message")).alias("sig"))
    return rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))


@query("error_match_hashes", "B15", "log_lines", """
SELECT h, count(*) AS n FROM (SELECT substring(md5(concat(component, ':', severity, ':', regexp_replace(message, '\\b[0-9]+\\b', 'N', 'g'))), 1, 16) AS h FROM log_lines) x GROUP BY 1""")
def error_match_hashes(t):
    rows = t.log_lines(numbered=False).select(match_hash(F.col("component"), F.col("severity"), F.col("message")).alias("h"))
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))


@query("cleaned_lines", "B16", "text_lines", """
SELECT session_id, count(*) AS lines, CAST(sum(length(c)) AS BIGINT) AS chars FROM (SELECT session_id, trim(regexp_replace(content, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS c FROM text_lines) x GROUP BY 1""")
def cleaned_lines(t):
    colour = chr(27) + "[31m"
    rows = t.text_lines().select("session_id", clean_line(F.concat(F.lit(colour), F.col("content"), F.lit(chr(27) + "[0m"))).alias("c"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("c")).alias("chars"))


@query("line_timestamps", "B18", "log_lines", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS found FROM log_lines")
def line_timestamps(t):
    return t.log_lines(numbered=False).select("event_id", F.date_format(extract_ts(F.col("content")), "yyyy-MM-dd HH:mm:ss").alias("found"))


@query("line_correlation_ids", "B31 B32", "log_lines", """
SELECT correlation_id AS id, count(*) AS narrow, count(*) AS wide FROM log_lines GROUP BY 1 UNION ALL
SELECT concat('job-', CAST(user_id AS STRING)) AS id, 0 AS narrow, count(*) AS wide FROM log_lines WHERE length(CAST(user_id AS STRING)) > 1 GROUP BY 1""")
def line_correlation_ids(t):
    text = F.concat("content", F.lit(" job_id=job-"), "user_id")
    rows = t.log_lines(numbered=False).select(
        F.explode(correlation_ids(text, wide=True)).alias("id"), correlation_ids(F.col("content")).alias("narrow")
    )
    return rows.groupBy("id").agg(F.count_if(F.expr("array_contains(narrow, id)")).alias("narrow"), F.count(F.lit(1)).alias("wide"))


@query("units_to_numbers", "B33 B34", "request_log", """
SELECT status, CAST(sum(duration_ms) AS BIGINT) AS seconds, CAST(sum(mem_kb * 1024) AS BIGINT) AS bytes, CAST(sum(mem_kb * 1024) AS BIGINT) AS mb,
  CAST(sum(db_ms) AS BIGINT) AS cells FROM request_log GROUP BY 1""")
def units_to_numbers(t):
    d = F.col("duration_ms")
    hms = F.concat(F.floor(d / 3600), F.lit("h"), F.floor((d % 3600) / 60), F.lit("m"), d % 60, F.lit("s"))
    rows = t.request_log().select(
        "status", hms.alias("hms"), F.concat("mem_kb", F.lit(" KiB")).alias("kib"), F.concat("mem_kb", F.lit("G")).alias("g"), F.concat("db_ms", F.lit("%")).alias("cell"),
    )
    # one number after the other: code for all of them at once is a method too long for the JVM's compiler
    for text, name, number in (("hms", "s", parse_duration), ("kib", "b", parse_bytes), ("g", "mb", parse_size_mb), ("cell", "c", safe_double)):
        rows = compute_once(compute_once(rows, **{text: F.col(text)}), **{name: number(F.col(text))}).drop(text)
    return rows.groupBy("status").agg(
        F.sum("s").cast("bigint").alias("seconds"), F.sum("b").alias("bytes"), F.sum("mb").cast("bigint").alias("mb"), F.sum("c").cast("bigint").alias("cells")
    )


@query("variable_values", "B9", "log_lines", """
SELECT event_id, length(message) > 40 AS message_varies, TRUE AS id_varies, FALSE AS severity_varies, TRUE AS time_varies FROM log_lines""")
def variable_values(t):
    return t.log_lines(numbered=False).select(
        "event_id", is_variable(F.col("message")).alias("message_varies"), is_variable(F.col("correlation_id")).alias("id_varies"),
        is_variable(F.col("severity")).alias("severity_varies"), is_variable(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("time_varies"),
    )


@query("file_catalogue", "A6 A7 A8 A9 B20 B22 B23 B25 D5", "log_lines", f"""
SELECT session_id, path, count(*) AS line_count, CAST(sum(length(content) + 1) AS BIGINT) AS size, {SERVICE_SQL} AS service,
  CASE WHEN path LIKE '%rails%' THEN 'rails' WHEN path LIKE '%workhorse%' THEN 'workhorse' WHEN path LIKE '%sidekiq%' THEN 'sidekiq' WHEN path LIKE '%gitaly%' THEN 'gitaly' ELSE 'postgresql' END AS component,
  CASE WHEN path LIKE '%sidekiq%' THEN 'Sidekiq Current' WHEN path LIKE '%gitaly%' THEN 'Gitaly Main' WHEN path LIKE '%postgresql%' THEN 'PostgreSQL' END AS log_type,
  CASE WHEN path LIKE '%sidekiq%' OR path LIKE '%gitaly%' THEN 'json' WHEN path LIKE '%postgresql%' THEN 'syslog' ELSE 'unknown' END AS format,
  CASE WHEN path LIKE '%json%' THEN 'json_log' ELSE 'log' END AS file_type,
  path LIKE '%sidekiq/current' OR path LIKE '%gitaly/current' AS is_suitable,
  CASE WHEN path LIKE '%gitaly%' THEN 'gitaly' WHEN path LIKE '%postgresql%' THEN 'postgresql' WHEN path LIKE '%sidekiq%' THEN 'sidekiq' WHEN path LIKE '%workhorse%' THEN 'workhorse' ELSE 'unknown' END AS node
FROM log_lines WHERE session_id IN ('node0', 'node2') GROUP BY session_id, path""")
def file_catalogue(t):
    files = search.select_files(file_catalog(t), sessions=["node0", "node2"], path_parts=["VAR/log"])
    return files.where(is_log_file(F.col("path"))).withColumn("node", node_of(F.col("path")))


@query("catalogue_services", "B21", "log_lines", """
SELECT path, CASE WHEN path LIKE '%production_json.log' THEN 'gitlab-rails' WHEN path LIKE '%workhorse%' THEN 'gitlab-workhorse'
  WHEN path LIKE '%sidekiq%' THEN 'sidekiq' WHEN path LIKE '%gitaly%' THEN 'gitaly' ELSE 'postgresql' END AS service, count(*) AS lines FROM log_lines GROUP BY 1, 2""")
def catalogue_services(t):
    files = t.log_lines(numbered=False).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    return files.withColumn("service", service_of(F.col("path"), "catalog"))


@query("service_filter", "C12 D11 H1", "log_lines", f"SELECT event_id, {SERVICE_SQL} AS service FROM log_lines WHERE {SERVICE_SQL} IN ('rails', 'sidekiq', 'gitaly', 'postgresql')")
def service_filter(t):
    files = p.service_is(file_catalog(t), ["rails:production_json,side*", "gitaly:curr*"])
    lines = t.log_lines(numbered=False)
    other = search.drop_files(lines, p.service_is(file_catalog(t), ["rails", "sidekiq", "gitaly", "workhorse"]))
    rows = search.union_hits(search.keep_files(lines, files), other)
    return search.with_file_info(rows, file_catalog(t), "service").select("event_id", "service")


@query("simple_text_search", "C16 G1", "log_lines", """
SELECT session_id, path, line_no, message FROM log_lines WHERE contains(lower(content), 'user 1') AND regexp_matches(lower(content), 'error|fail|exception')
  AND path LIKE '%postgresql%' ORDER BY session_id, path, line_no LIMIT 200""")
def simple_text_search(t):
    rows = t.log_lines().withColumn("service", service_of(F.col("path")))
    return search.simple_search(rows, "User 1", service="postgres", severity="error", limit=200).select("session_id", "path", "line_no", "message")


@query("grep_steps", "C17", "log_lines", HIT + "regexp_matches(content, '(?i)completed') AND NOT contains(content, 'for user 1') AND contains(lower(content), '\"status\":404')")
def grep_steps(t):
    steps = [search.GrepStep("completed"), search.GrepStep("for user 1", inverse=True, ignore_case=False, is_regex=False), search.GrepStep('"STATUS":404', is_regex=False)]
    return search.grep_pipeline(t.log_lines(numbered=False), steps).select("event_id", "session_id", "path", "status", "severity")


@query("smart_search_buckets", "C18", "log_lines", """
SELECT session_id, bucket, count(*) AS n FROM (SELECT session_id, CASE WHEN regexp_matches(lower(content), 'panic|fatal|critical') THEN 'critical' WHEN regexp_matches(lower(content), 'error|fail') THEN 'error'
  WHEN contains(lower(content), 'warn') THEN 'warning' ELSE 'other' END AS bucket FROM log_lines WHERE regexp_matches(lower(content), 'connection|connect|refused|lost')) x GROUP BY 1, 2""")
def smart_search_buckets(t):
    return search.smart_search(t.log_lines(numbered=False), "Connection trouble").groupBy("session_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("hits_in_time_range", "C19 B19", "log_lines", """
SELECT event_id FROM log_lines WHERE status >= 500 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-02 00:00:00' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-04 00:00:00'""")
def hits_in_time_range(t):
    from ..functions.text import event_ts
    rows = with_fields(t.log_lines(numbered=False).drop("ts")).where(p.gte("status", 500))
    rows = rows.withColumn("ts", event_ts([field("timestamp"), field("time")], F.col("content")))
    ts = lambda s: F.lit(s).cast("timestamp")
    return search.between_times(rows, ts("2024-01-02 00:00:00"), ts("2024-01-04 00:00:00")).select("event_id")


@query("hits_with_context", "F1", "log_lines", """
WITH w AS (SELECT session_id, path, line_no, status, k, content, array_to_string(list(content) OVER (PARTITION BY session_id, path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|') AS before_text,
  array_to_string(list(content) OVER (PARTITION BY session_id, path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|') AS after_text FROM log_lines)
SELECT session_id, path, line_no, md5(content) AS content_hash, coalesce(before_text, '') AS before_text, coalesce(after_text, '') AS after_text FROM w WHERE status >= 500""")
def hits_with_context(t):
    rows = search.with_context(t.stored_lines("status"), 2, F.col("status") >= 500)
    return rows.select("session_id", "path", "line_no", F.md5("content").alias("content_hash"), F.concat_ws("|", "context_before").alias("before_text"), F.concat_ws("|", "context_after").alias("after_text"))


@query("id_text_trace", "D7", "log_lines", """
WITH w AS (SELECT *, list(line_no) OVER (PARTITION BY session_id, path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM log_lines)
SELECT session_id, path, count(*) AS hits, CAST(sum(len(around)) AS BIGINT) AS shown FROM w WHERE contains(lower(content), 'user 17 ') GROUP BY 1, 2""")
def id_text_trace(t):
    rows = search.trace_text(t.stored_lines(), "user 17 ")
    return rows.groupBy("session_id", "path").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.size("context_before") + F.size("context_after") + 1).cast("bigint").alias("shown")
    )


@query("first_hits", "G1", "log_lines", "SELECT session_id, path, line_no FROM log_lines WHERE status >= 500 ORDER BY session_id, path, line_no LIMIT 100")
def first_hits(t):
    rows = with_fields(t.lines()).where(p.gte("status", 500))
    return search.limit_hits(rows, 100).select("session_id", "path", "line_no")


@query("hits_sorted_by_field", "G2", "log_lines", """
SELECT session_id, path, line_no, dur_ms FROM log_lines WHERE status >= 500 ORDER BY dur_ms DESC, session_id, path, line_no LIMIT 50""")
def hits_sorted_by_field(t):
    rows = with_fields(t.log_lines()).where(p.gte("status", 500))
    return search.sort_hits(rows, "duration_ms", asc=False).limit(50).select("session_id", "path", "line_no", "dur_ms")


@query("line_range", "A11", "log_lines", "SELECT line_no, md5(content) AS h FROM log_lines WHERE session_id = 'node1' AND path = 'var/log/gitaly/current' AND line_no >= 10 AND line_no < 60")
def line_range(t):
    return search.slice_lines(t.lines(), "node1", "var/log/gitaly/current", 10, 60).select("line_no", F.md5("content").alias("h"))


@query("file_line_metadata", "A12", "log_lines", """
SELECT session_id, path, count(*) AS total_lines, CAST(sum(length(content) + 1) AS BIGINT) AS size, count(*) AS json_lines, 8 AS field_count,
  'correlation_id,ctx,duration_ms,message,meta.user,severity,status,time' AS fields, TRUE AS is_json, 1.0 AS json_ratio FROM log_lines GROUP BY 1, 2""")
def file_line_metadata(t):
    rows = profile.file_metadata(t.log_lines(numbered=False).select("session_id", "path", "content"))
    return rows.withColumn("fields", F.concat_ws(",", "detected_fields")).drop("detected_fields")


@query("discovered_fields", "E9 G8", "log_lines", """
WITH f AS (SELECT 'severity' AS field, severity AS value FROM log_lines UNION ALL SELECT 'status', CAST(status AS STRING) FROM log_lines UNION ALL SELECT 'ctx.k', CAST(k AS STRING) FROM log_lines
  UNION ALL SELECT 'meta.user', concat('u', CAST(user_id AS STRING)) FROM log_lines UNION ALL SELECT 'duration_ms', CAST(dur_ms AS STRING) FROM log_lines
  UNION ALL SELECT 'message', message FROM log_lines UNION ALL SELECT 'correlation_id', correlation_id FROM log_lines UNION ALL SELECT 'time', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM log_lines),
c AS (SELECT field, value, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rk FROM c),
s AS (SELECT field, string_agg(value, '|' ORDER BY rk) AS samples FROM r WHERE rk <= 10 GROUP BY 1), t AS (SELECT field, count(*) AS n FROM f GROUP BY 1)
SELECT field, CASE WHEN field IN ('status', 'ctx.k', 'duration_ms') THEN 'number' ELSE 'string' END AS type, n AS count, TRUE AS is_common, samples FROM t JOIN s USING (field)
UNION ALL SELECT 'ctx', 'object', (SELECT count(*) FROM log_lines), TRUE, ''""")
def discovered_fields(t):
    rows = profile.discover_fields(t.log_lines(numbered=False).select("session_id", "path", "content"), tasks=t.tasks("events"))
    return rows.withColumn("samples", F.coalesce(F.concat_ws("|", "sample_values"), F.lit(""))).drop("sample_values")


@query("field_profiles", "E10", "log_lines", """
WITH f AS (SELECT session_id, path, unnest([
  struct_pack(field := 'time', type := 'string', v := substring(CAST(ts AS STRING), 1, 19)), struct_pack(field := 'severity', type := 'string', v := severity), struct_pack(field := 'status', type := 'number', v := CAST(status AS STRING)),
  struct_pack(field := 'duration_ms', type := 'number', v := CAST(dur_ms AS STRING)), struct_pack(field := 'correlation_id', type := 'string', v := correlation_id), struct_pack(field := 'meta.user', type := 'string', v := concat('u', CAST(user_id AS STRING))),
  struct_pack(field := 'ctx', type := 'object', v := concat('{"k":', CAST(k AS STRING), '}')), struct_pack(field := 'ctx.k', type := 'number', v := CAST(k AS STRING)), struct_pack(field := 'message', type := 'string', v := message)]) AS x FROM log_lines),
c AS (SELECT session_id, path, x.field AS field, x.type AS type, x.v AS v, count(*) AS n FROM f GROUP BY 1, 2, 3, 4, 5)
SELECT session_id, path, field, CAST(sum(n) AS BIGINT) AS count, type, FALSE AS nullable, count(*) AS distinct_values, array_to_string(list(v ORDER BY v)[1:20], '|') AS samples FROM c GROUP BY 1, 2, 3, 5""")
def field_profiles(t):
    rows = profile.field_profile(t.log_lines(numbered=False).select("session_id", "path", "content"), tasks=t.tasks("events"))
    return rows.withColumn("samples", F.concat_ws("|", "samples"))


@query("viewer_level_counts", "E27", "log_lines", """
SELECT session_id, path, count(*) AS total, count(*) FILTER (severity IN ('ERROR','FATAL')) AS error, count(*) FILTER (severity = 'WARN') AS warning,
  count(*) FILTER (severity = 'INFO') AS info FROM log_lines GROUP BY 1, 2""")
def viewer_level_counts(t):
    return profile.level_counts(t.log_lines(numbered=False).select("session_id", "path", "content"))


@query("lines_per_file", "E28", "log_lines", """
SELECT session_id, path, count(*) AS line_count, CAST(sum(count(*)) OVER (PARTITION BY session_id) AS BIGINT) AS session_lines FROM log_lines GROUP BY 1, 2""")
def lines_per_file(t):
    return profile.line_counts(t.log_lines(numbered=False))


@query("sessions", "E29", "log_lines", """
SELECT session_id, count(DISTINCT path) AS files, CAST(sum(length(content) + 1) AS BIGINT) AS bytes, 'gitaly,postgresql,rails,sidekiq,workhorse' AS components FROM log_lines GROUP BY 1""")
def sessions(t):
    return profile.session_catalog(file_catalog(t)).withColumn("components", F.concat_ws(",", "components"))


@query("components", "E7", "log_lines", """
SELECT component, count(DISTINCT session_id || path) AS file_count, count(DISTINCT session_id) AS session_count, string_agg(DISTINCT path, ',') AS files FROM log_lines GROUP BY 1""")
def components(t):
    rows = profile.component_catalog(file_catalog(t))
    return rows.withColumn("files", F.concat_ws(",", "sample_files")).drop("sample_files")


@query("log_types", "E8", "log_lines", """
SELECT CASE component WHEN 'sidekiq' THEN 'Sidekiq Current' WHEN 'gitaly' THEN 'Gitaly Main' WHEN 'postgresql' THEN 'PostgreSQL' WHEN 'rails' THEN 'Rails - production_json.log' ELSE 'Workhorse - current' END AS name,
  component, CASE component WHEN 'sidekiq' THEN 'json' WHEN 'gitaly' THEN 'json' WHEN 'postgresql' THEN 'syslog' ELSE 'unknown' END AS format,
  count(DISTINCT session_id || path) AS file_count, count(DISTINCT session_id) AS session_count, string_agg(DISTINCT path, ',') AS files FROM log_lines GROUP BY component""")
def log_types(t):
    rows = profile.log_type_catalog(file_catalog(t))
    return rows.withColumn("files", F.concat_ws(",", "sample_files")).drop("sample_files")


@query("suggested_filters", "O3", "log_lines", """
WITH c AS (SELECT severity AS v, count(*) AS n FROM log_lines GROUP BY 1), b AS (SELECT v FROM c WHERE regexp_matches(lower(v), 'error|fail|critical|warning') ORDER BY n DESC, v LIMIT 1)
SELECT 1 AS rank, 'Severity: errors' AS name, 'severity' AS field, ':' AS operator, v AS value FROM b
UNION ALL SELECT 2, 'Requests that failed on the server', 'status', '>=', '500' UNION ALL SELECT 3, 'Requests refused as wrong', 'status', '400..499', NULL
UNION ALL SELECT 8, 'Without debug lines', 'level', '!=', 'debug' UNION ALL SELECT 9, 'Everything of rails', 'service', ':', 'rails:*' UNION ALL SELECT 10, 'Everything of the workers', 'service', ':', '*worker*'""")
def suggested_filters(t):
    return profile.suggest_filters(profile.discover_fields(t.log_lines(numbered=False).select("session_id", "path", "content"), tasks=t.tasks("events")))


@query("distinct_sessions", "H2", "log_lines", "SELECT DISTINCT correlation_id FROM log_lines WHERE status >= 500")
def distinct_sessions(t):
    return search.distinct_values(t.log_lines(numbered=False).where("status >= 500"), "correlation_id")
