"""Queries: parsing by format, metadata, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import clusters, search
from .queries_search import file_catalog
from .registry import query

# templates that the derived messages must end up in
TEMPLATE = """CASE WHEN component = 'sidekiq' THEN concat('Worker', CAST(k % 4 AS STRING), ' done in <*> <*>')
  WHEN component = 'postgresql' AND k % 3 = 0 THEN 'could not connect to server: connection refused after <*> <*>' WHEN component = 'postgresql' AND k % 3 = 1 THEN 'deadlock detected in process <ID>'
  WHEN component = 'postgresql' THEN 'canceling statement due to lock timeout, user <*>' ELSE concat('Completed ', event_type, ' for user <*> in <*> <*>') END"""
T = f"t AS (SELECT *, {TEMPLATE.replace('event_type', chr(39) + 'X' + chr(39))} AS template0 FROM log_lines), t2 AS (SELECT *, replace(template0, 'X', CASE component WHEN 'rails' THEN 'view' WHEN 'workhorse' THEN 'click' ELSE 'purchase' END) AS template FROM t)"


def lines_json(t):
    """JSON for every component: PostgreSQL lines are stored under a path without a syslog type."""
    path = F.when(F.col("path").contains("postgresql"), "var/log/postgresql/events.json").otherwise(F.col("path"))
    return t.log_lines().withColumn("path", path).select("session_id", "path", "line_no", "content")


def assigned(t):
    return clusters.assign_clusters(parse.parse_lines(lines_json(t)))


@query("parsed_lines", "B7 B8", "log_lines", """
SELECT session_id, CASE WHEN component = 'postgresql' THEN 'var/log/postgresql/events.json' ELSE path END AS path, line_no, component, TRUE AS is_json, severity, CAST(NULL AS STRING) AS exception_class, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
 regexp_replace(message, '\\b[0-9]{6,}\\b', '<ID>', 'g') AS message, concat('u', CAST(user_id AS STRING)) AS user_name, CAST(status AS DOUBLE) AS status FROM log_lines""")
def parsed_lines(t):
    rows = parse.parse_lines(lines_json(t))
    return rows.select("session_id", "path", "line_no", "component", "is_json", "severity", "exception_class", "ts", "message", F.col("meta.user").alias("user_name"), F.col("meta.status").alias("status"))


@query("syslog_lines", "B10", "log_lines", """
SELECT line_no, session_id, 'syslog' AS format, concat(CASE WHEN k % 2 = 0 THEN 'retry: ' ELSE '' END, severity) AS message, CAST(NULL AS STRING) AS severity FROM log_lines""")
def syslog_lines(t):
    text = F.concat(F.lit("host: proc: "), F.when(F.col("k") % 2 == 0, "retry: ").otherwise(""), F.col("severity"))
    rows = t.log_lines().select("session_id", F.lit("var/log/postgresql/current").alias("path"), "line_no", text.alias("content"))
    return parse.parse_lines(rows).select("line_no", "session_id", "format", "message", "severity")


@query("nginx_and_plain_lines", "B11 B12", "log_lines", """
SELECT session_id, component, coalesce(CASE WHEN component <> 'nginx' THEN CASE WHEN s = 'FATAL' THEN 'CRITICAL' WHEN s = 'WARN' THEN 'WARNING' ELSE s END END, 'none') AS severity, count(*) AS n, max(message) AS last FROM (
 SELECT session_id, CASE WHEN component = 'rails' THEN 'rails' ELSE 'nginx' END AS component, severity AS s, regexp_replace(concat(severity, ' ', message), '\\b[0-9]{6,}\\b', '<ID>', 'g') AS message FROM log_lines) x GROUP BY 1, 2, 3""")
def nginx_and_plain_lines(t):
    path = F.when(F.col("component") == "rails", "var/log/rails/production.txt").otherwise("var/log/nginx/access.log")
    rows = t.log_lines(numbered=False)
    rows = rows.select("session_id", path.alias("path"), F.lit(1).alias("line_no"), F.concat_ws(" ", "severity", "message").alias("content"))
    out = parse.parse_lines(rows).withColumn("severity", F.coalesce("severity", F.lit("none")))
    return out.groupBy("session_id", "component", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("message").alias("last"))


def domain_lines(t):
    """Lines with domain metadata, nested for half of the rows and as dotted keys for the other."""
    k, text = F.col("k"), F.col("k").cast("string")
    dotted = F.col("k") % 2 == 0
    job = F.concat(F.lit('{"class":"Worker'), (k % 3).cast("string"), F.lit('","jid":"j'), text, F.lit('","queue":"q","job_status":"'), F.when(k % 5 == 0, "fail").otherwise("done"), F.lit('","duration_s":'), F.col("k").cast("string"), F.lit(',"meta.feature_category":"ci","message":"m"}'))
    code = F.when(k % 4 == 0, "Unavailable").otherwise("OK")
    rpc = F.when(dotted, F.concat(F.lit('{"grpc.method":"Find'), (k % 3).cast("string"), F.lit('","grpc.service":"svc","grpc.code":"'), code, F.lit('","msg":"x"}'))).otherwise(
        F.concat(F.lit('{"grpc":{"method":"Find'), (k % 3).cast("string"), F.lit('","service":"svc","code":"'), code, F.lit('"},"msg":"x"}')))
    web = F.concat(F.lit('{"controller":"C'), (k % 3).cast("string"), F.lit('","action":"a","status":'), F.col("status").cast("string"), F.lit(',"db_duration_s":'), (k % 4).cast("string"), F.lit('}'))
    rows = t.log_lines().where("component IN ('sidekiq', 'gitaly', 'rails')")
    content = F.when(F.col("component") == "sidekiq", job).when(F.col("component") == "gitaly", rpc).otherwise(web)
    return rows.withColumn("content", content).select("session_id", "path", "line_no", "content")


DOMAIN = """d AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'fail' ELSE 'done' END AS job, CASE WHEN k % 4 = 0 THEN 'Unavailable' ELSE 'OK' END AS code, CAST(k % 3 AS STRING) AS v FROM log_lines WHERE component IN ('sidekiq', 'gitaly', 'rails'))"""


@query("semantic_templates", "B26 B27 B28", "log_lines", f"""
WITH {DOMAIN} SELECT component, CASE component WHEN 'sidekiq' THEN concat('Worker', v, ' [', job, '] (ci)') WHEN 'gitaly' THEN concat('Find', v, CASE WHEN code <> 'OK' THEN concat(' → ', code) ELSE '' END, ' (svc)')
  ELSE concat('C', v, '#a [', CAST(status AS STRING), ']') END AS message,
 CASE component WHEN 'sidekiq' THEN concat('sidekiq_', CASE WHEN job = 'fail' THEN 'fail' WHEN k > 60 THEN 'slow' ELSE job END, ':Worker', v) WHEN 'gitaly' THEN CASE WHEN code <> 'OK' THEN concat('grpc_error:svc.Find', v, ':', code) ELSE concat('grpc_ok:svc.Find', v) END
  ELSE concat(CASE WHEN status >= 500 THEN 'rails_5xx' WHEN status >= 400 THEN 'rails_4xx' ELSE 'rails_ok' END, ':C', v, '#a') END AS semantic_key, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def semantic_templates(t):
    rows = parse.parse_lines(domain_lines(t))
    rows = rows.withColumn("semantic_key", parse.semantic_key(F.col("message"), "meta", F.col("component")))
    return rows.groupBy("component", "message", "semantic_key").agg(F.count(F.lit(1)).alias("n"))


@query("investigation_hints", "B30", "log_lines", f"""
WITH {DOMAIN} SELECT component, hint, count(*) AS n FROM (
 SELECT component, concat('Follow job j', CAST(k AS STRING), ' through all logs') AS hint FROM d WHERE component = 'sidekiq' AND job = 'fail' UNION ALL SELECT component, 'Look at the backlog of job queue q' FROM d WHERE component = 'sidekiq' AND job = 'fail' UNION ALL
 SELECT component, 'Owner area of the job: ci' FROM d WHERE component = 'sidekiq' AND job = 'fail' UNION ALL SELECT component, 'The repository service did not answer: is it running?' FROM d WHERE component = 'gitaly' AND code = 'Unavailable' UNION ALL
 SELECT component, 'Test the route from the caller to the repository service' FROM d WHERE component = 'gitaly' AND code = 'Unavailable' UNION ALL
 SELECT component, 'The database took 3.0 s of the request' FROM d WHERE component = 'rails' AND k % 4 = 3 UNION ALL SELECT component, 'Look up the plan of the slowest statement' FROM d WHERE component = 'rails' AND k % 4 = 3) x GROUP BY 1, 2""")
def investigation_hints(t):
    rows = parse.parse_lines(domain_lines(t)).select("component", F.explode(parse.hints("meta", F.col("component"))).alias("hint"))
    return rows.groupBy("component", "hint").agg(F.count(F.lit(1)).alias("n"))


@query("known_issues", "B29", "log_lines", """
SELECT CASE WHEN contains(message, 'connection refused') THEN 'gitaly_unavailable' WHEN contains(message, 'deadlock') THEN 'pg_deadlock' ELSE 'none' END AS issue,
 CASE WHEN contains(message, 'connection refused') THEN 'critical' WHEN contains(message, 'deadlock') THEN 'warning' ELSE 'none' END AS severity, count(*) AS n FROM log_lines GROUP BY 1, 2""")
def known_issues(t):
    rows = t.log_lines(numbered=False).select(parse.known_issue(F.col("message")).alias("i"))
    none = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit("none")).alias(c)
    return rows.groupBy(none("issue"), none("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("masked_tokens", "J2", "text_lines", """
SELECT session_id, count(*) AS lines, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(len(list_filter(w, lambda x: contains(x, 'JID-') OR regexp_matches(x, '^[a-f0-9]{32,}$') OR regexp_matches(x, '^\\([0-9]+\\):?$') OR suffix(x, 'ms') OR suffix(x, 'sec')
  OR regexp_matches(x, '^[a-fA-F0-9]{8,}$') OR regexp_matches(x, '^[a-fA-F0-9-]{36}$') OR regexp_matches(x, '^[0-9]+\\.?[0-9]*$') OR regexp_matches(x, '^[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') OR length(x) > 50
  OR (length(x) > 4 AND length(regexp_replace(x, '[^0-9]', '', 'g')) / length(x) > 0.7)))) AS BIGINT) AS masked FROM (SELECT session_id, list_filter(regexp_split_to_array(trim(content), '[ \\t\\r\\f]+'), lambda x: x <> '') AS w FROM text_lines) y GROUP BY 1""")
def masked_tokens(t):
    tokens = clusters.mask_tokens(F.col("content"))
    rows = t.text_lines().select("session_id", tokens.alias("w"))
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("w")).alias("words"), F.sum(F.size(F.filter("w", lambda x: x == "<*>"))).alias("masked")
    )


@query("cluster_templates", "J1 J6 J7 E5 J8", "log_lines", f"""
WITH {T} SELECT component, 'drain' AS algorithm, template, count(*) AS count, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id || path) AS files, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, CASE WHEN bool_or(severity = 'FATAL') THEN 'FATAL' WHEN bool_or(severity = 'ERROR') THEN 'ERROR' WHEN bool_or(severity = 'WARN') THEN 'WARN' ELSE 'INFO' END AS severity FROM t2 GROUP BY 1, 3""")
def cluster_templates(t):
    found = search_and_cluster(t)["clusters"]
    return found.select("component", "algorithm", "template", "count", "sessions", "files", "first_ts", "last_ts", "severity")


def search_and_cluster(t):
    return clusters.search_and_cluster(lines_json(t), None, [search.GrepStep('"severity"', is_regex=False)])


@query("clusters_by_priority", "G4 G5 F12", "log_lines", f"""
WITH {T}, c AS (SELECT component, template, count(*) AS count, CASE WHEN bool_or(severity = 'FATAL') THEN 100 WHEN bool_or(severity = 'ERROR') THEN 80 WHEN bool_or(severity = 'WARN') THEN 50 ELSE 20 END
  + CASE WHEN component = 'rails' AND min_by(status, (session_id, path, line_no)) >= 400 THEN 40 ELSE 0 END AS priority FROM t2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, count DESC, component, template) AS rank FROM c)
SELECT 'C' || lpad(CAST(rank AS STRING), 4, '0') AS cluster_id, rank, component, template, count, priority FROM r""")
def clusters_by_priority(t):
    return search_and_cluster(t)["clusters"].select("cluster_id", "rank", "component", "template", "count", F.col("priority").cast("bigint").alias("priority"))


@query("cluster_run_statistics", "E6", "log_lines", """
SELECT 'session_id' AS part, session_id AS value, count(*) AS count FROM log_lines GROUP BY 2 UNION ALL SELECT 'component', component, count(*) FROM log_lines GROUP BY 2
UNION ALL SELECT 'severity', severity, count(*) FROM log_lines GROUP BY 2 UNION ALL SELECT 'algorithm', 'drain', count(*) FROM log_lines""")
def cluster_run_statistics(t):
    rows = clusters.with_strategy(parse.parse_lines(lines_json(t)))
    return clusters.run_stats(rows)


@query("cluster_files", "E5 D8", "log_lines", f"""
WITH {T} SELECT session_id, CASE WHEN component = 'postgresql' THEN 'var/log/postgresql/events.json' ELSE path END AS path, count(*) AS count FROM t2 WHERE template LIKE 'deadlock%' GROUP BY 1, 2""")
def cluster_files(t):
    member = clusters.cluster_lines(assigned(t), "postgresql", "drain", "deadlock detected in process <ID>")
    return clusters.cluster_counts(member, ["session_id", "path"]).select("session_id", "path", "count")


@query("merged_clusters", "D10", "log_lines", f"""
WITH {DOMAIN} SELECT component, CASE component WHEN 'sidekiq' THEN concat('Worker', v, ' ', job) WHEN 'gitaly' THEN concat('Find', v, ' ', code) ELSE concat('drain', chr(2), 'C', v, '#a [', CAST(status AS STRING), ']') END AS merged, count(*) AS count FROM d GROUP BY 1, 2""")
def merged_clusters(t):
    rows = parse.parse_lines(domain_lines(t))
    groups = rows.groupBy("component", F.lit("drain").alias("algorithm"), F.col("message").alias("template"), F.struct("meta.worker_class", "meta.job_status", "meta.grpc_method", "meta.grpc_code", "meta.state_from", "meta.state_to").alias("meta")).agg(F.count(F.lit(1)).alias("count"))
    merged = clusters.merge_semantic(groups)
    return merged.select("component", F.replace("semantic_key", F.lit("\x01"), F.lit(" ")).alias("merged"), "count")


@query("template_instances", "D9", "log_lines", f"""
WITH {T}, p AS (SELECT DISTINCT template, session_id, path FROM t2)
SELECT template, l.session_id, l.path, l.line_no FROM p JOIN log_lines l ON p.session_id = l.session_id AND p.path = l.path
WHERE contains(l.content, split_part(template, ' ', 1)) OR contains(l.content, split_part(template, ' ', 2)) OR contains(l.content, split_part(template, ' ', 3))""")
def template_instances(t):
    rows = clusters.with_strategy(parse.parse_lines(lines_json(t)))
    found = rows.join(clusters.templates(rows), ["component", "algorithm", "text"])
    stored = F.when(F.col("component") == "postgresql", "var/log/postgresql/current").otherwise(F.col("path"))
    patterns = found.select(F.col("template").alias("pattern_id"), "template", "session_id", stored.alias("path")).distinct()
    lines = t.log_lines().select("session_id", "path", "line_no", "content")
    return clusters.pattern_instances(patterns, lines).select(F.col("pattern_id").alias("template"), "session_id", "path", "line_no")


@query("free_text_templates", "J3", "log_lines", """
WITH RECURSIVE texts AS MATERIALIZED (SELECT DISTINCT component, message AS text, list_filter(regexp_split_to_array(trim(message), '\\s+'), lambda x: x <> '') AS w FROM log_lines),
named AS MATERIALIZED (SELECT *, md5(concat_ws(chr(1), 'lenma', component, len(w), array_to_string(list_sort(list_distinct(w)), ' '))) AS id FROM texts),
sets AS MATERIALIZED (SELECT DISTINCT id, component, list_sort(list_distinct(w)) AS s, len(w) AS n FROM named),
rounds AS (SELECT 0 AS k, id, component, s, n FROM sets UNION ALL
 SELECT k + 1, r.id, r.component, r.s, r.n FROM rounds r, (SELECT min(id) AS id, arg_min(component, id) AS component, arg_min(s, id) AS s, arg_min(n, id) AS n FROM rounds) l
 WHERE r.id <> l.id AND NOT (r.component = l.component AND abs(r.n - l.n) <= 5 AND len(list_intersect(r.s, l.s)) / len(list_distinct(list_concat(r.s, l.s))) >= 0.5)),
leaders AS MATERIALIZED (SELECT s.* FROM sets s JOIN (SELECT min(id) AS id FROM rounds GROUP BY k) USING (id)),
scored AS (SELECT s.id, l.id AS leader, len(list_intersect(s.s, l.s)) / len(list_distinct(list_concat(s.s, l.s))) AS share FROM sets s JOIN leaders l ON s.component = l.component AND abs(s.n - l.n) <= 5),
chosen AS MATERIALIZED (SELECT id, leader FROM scored WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY id <> leader AND id IN (SELECT id FROM leaders), share DESC, leader) = 1),
places AS (SELECT leader, pos, CASE WHEN min(x) = max(x) THEN min(x) ELSE '<*>' END AS x FROM (SELECT leader, unnest(w) AS x, unnest(range(0, len(w))) AS pos FROM named JOIN chosen USING (id)) p GROUP BY 1, 2),
merged AS (SELECT leader, string_agg(x, ' ' ORDER BY pos) AS template FROM places JOIN (SELECT leader, min(len(w)) AS n FROM named JOIN chosen USING (id) GROUP BY 1) m USING (leader) WHERE pos < n GROUP BY 1)
SELECT component, text, template FROM named JOIN chosen USING (id) JOIN merged USING (leader)""")
def free_text_templates(t):
    return clusters.lenma(t.log_lines().select("component", "message", "session_id", "path", "line_no"))


KEYWORD = " AND ".join([
    "length(x) > 3", "regexp_full_match(x, '\\pL+')", f"x NOT IN ({', '.join(repr(w) for w in clusters.STOP_WORDS)})",
])


@query("keyword_templates", "J4", "text_lines", f"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT component, content AS text, min((session_id, path, line_no)) AS first, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: {KEYWORD}))) AS s FROM text_lines GROUP BY 1, 2),
named AS MATERIALIZED (SELECT *, CASE WHEN len(s) > 0 THEN md5(concat_ws(chr(1), 'semantic', component, array_to_string(s, ' '))) END AS id FROM texts),
sets AS MATERIALIZED (SELECT DISTINCT id, component, s, len(s) AS n FROM named WHERE id IS NOT NULL),
words AS MATERIALIZED (SELECT id, component, n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*)) AS share FROM words a JOIN words b ON a.component = b.component AND a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.4),
rounds AS (SELECT 0 AS k, id, 'open' AS state FROM sets UNION ALL
 SELECT k + 1, r.id, CASE WHEN state <> 'open' THEN state WHEN led THEN 'member' WHEN coalesce(waits, FALSE) THEN 'open' ELSE 'leader' END FROM rounds r
 LEFT JOIN (SELECT b AS id, bool_or(p.state = 'leader') AS led, bool_or(p.state = 'open') AS waits FROM links JOIN rounds p ON p.id = a WHERE a < b GROUP BY 1) e ON e.id = r.id WHERE EXISTS (SELECT 1 FROM rounds WHERE state = 'open')),
leaders AS MATERIALIZED (SELECT id FROM rounds WHERE state = 'leader' AND k = (SELECT max(k) FROM rounds)),
chosen AS MATERIALIZED (SELECT id, id AS leader FROM leaders UNION ALL SELECT a, b FROM links WHERE b IN (SELECT id FROM leaders) AND a NOT IN (SELECT id FROM leaders) QUALIFY row_number() OVER (PARTITION BY a ORDER BY share DESC, b) = 1),
firsts AS (SELECT leader, arg_min(text, first) AS template FROM named JOIN chosen USING (id) GROUP BY 1)
SELECT component, text, coalesce(template, '') AS template FROM named LEFT JOIN chosen USING (id) LEFT JOIN firsts USING (leader)""")
def keyword_templates(t):
    rows = t.text_lines().select("component", F.col("content").alias("message"), "session_id", "path", "line_no")
    return clusters.keyword_clusters(rows)


@query("exception_classes", "J5", "request_log", """
SELECT 'rails' AS component, concat('Error', CAST(status AS STRING)) AS exception_class, count(*) AS count FROM request_log WHERE status >= 400 GROUP BY 2""")
def exception_classes(t):
    body = F.concat(F.lit('{"exception":{"class":"Error'), F.col("status").cast("string"), F.lit('"},"message":"m"}'))
    rows = t.request_log().where("status >= 400").select("session_id", F.lit("var/log/rails/exceptions_json.log").alias("path"), F.lit(1).alias("line_no"), body.alias("content"))
    return clusters.exception_clusters(parse.parse_lines(rows))
