"""Queries: host outputs, Kubernetes, triage. Host outputs are texts whose figures come from the supplier table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import hosts, kube, triage
from .queries_search import SERVICE_SQL, file_catalog
from .registry import query


def output(t, command, sql):
    """One output per supplier: `sql` builds the text from s_suppkey (k) and whole account balance (b)."""
    rows = t.read("supplier").select(F.col("s_suppkey").alias("k"), F.abs(F.floor("s_acctbal")).cast("bigint").alias("b"))
    return rows.selectExpr("concat('node', k) AS session_id", f"'{command}' AS command", f"{sql} AS content")


B = "s AS (SELECT s_suppkey AS k, CAST(abs(floor(s_acctbal)) AS BIGINT) AS b, 'node' || CAST(s_suppkey AS STRING) AS session_id FROM supplier)"

TOP = """concat('top - 10:00:00 up 3 days,  4:05,  2 users,  load average: ', k % 13, '.50, 1.25, 0.75\\n',
 'Tasks: ', 200 + k, ' total,   1 running, 198 sleeping,   0 stopped,  ', k % 15, ' zombie\\n%Cpu(s): ', b % 60, '.5 us,  2.0 sy,  0.0 ni, ', 90 - b % 60, '.0 id, ', k % 40, '.0 wa,  0.0 hi,  0.3 si,  0.0 st\\n',
 'MiB Mem :  16000.0 total,   ', b % 9000, '.0 free,   7000.0 used,   1000.0 buff/cache\\nMiB Swap:   2048.0 total,   2048.0 free,      0.0 used.  ', b % 9000 + 500, '.0 avail Mem \\n\\n',
 '    PID USER      PR  NI    VIRT    RES    SHR S  %CPU  %MEM     TIME+ COMMAND\\n  ', 100 + k, ' git       20   0  9.1g   1.2g  12345 S  ', k % 90, '.5   7.5   1:23.45 puma: worker 1\\n  ', 900 + k, ' root      20   0  1000m   512m   2345 R  12.0  ', k % 30, '.0   0:01.00 gitaly\\n')"""
VMSTAT = """concat('procs -----------memory---------- ---swap-- -----io---- -system-- ------cpu-----\\n r  b   swpd   free   buff  cache   si   so    bi    bo   in   cs us sy id wa st\\n 1  0  0  1000  10  100  0  0  5  5  100  200  1  1 98  0  0\\n',
 ' 2  0  0  ', b, '  10  100  ', k % 3, '  0  5  5  100  200  10  5 ', b % 100, '  ', k % 50, '  0\\n 4  1  0  500  10  100  0  0  5  5  100  200  10  5 60  4\\n')"""
IOSTAT = """concat('Linux\\n\\nDevice:  rrqm/s wrqm/s r/s w/s rkB/s wkB/s avgrq-sz avgqu-sz await r_await w_await svctm %util\\nsda 0.1 0.2 3.0 4.0 5.0 6.0 7.0 0.5 ', b % 50, '.5 1.0 2.0 0.3 ', b % 100, '.0\\nsdb 0.1 0.2 3.0 4.0 5.0 6.0 7.0 0.5 1.5 1.0 2.0 0.3 10.0\\n\\nDevice:  tps kB_read/s kB_wrtn/s kB_read kB_wrtn\\nsda ', k % 7, '.0 1.0 2.0 3 4\\n')"""
DF = """concat('Filesystem     Type      Size  Used Avail Use% Mounted on\\n/dev/sda1      ext4      100G  ', b % 100, 'G   5G  ', b % 100, '% /\\ntmpfs          tmpfs     7.8G     0  7.8G   0% /dev/shm\\n/dev/mapper/very-long-volume-name\\n               xfs       2T    1T   1T  ', 85 + k % 10, '% /var/opt data\\n')"""
NETSTAT = """concat('Proto Recv-Q Send-Q Local Address Foreign Address State\\ntcp 0 0 0.0.0.0:', 8000 + k % 5, ' 0.0.0.0:* LISTEN\\n', repeat('tcp 0 0 10.0.0.1:80 10.0.0.2:99 CLOSE_WAIT\\n', cast(100 + k % 2 AS int)), 'udp 0 0 0.0.0.0:68 0.0.0.0:*\\ntcp 0 0 a b ESTABLISHED\\n')"""
PS = """concat('USER       PID %CPU %MEM    VSZ   RSS TTY      STAT START   TIME COMMAND\\ngit        ', 100 + k, '  ', k % 100, '.0  5.0  100  200 ?        Ss   10:00   0:01 puma: master process\\nroot       2  0.0  ', k % 40, '.0    0     0 ?        Z    10:00   0:00 defunct\\n')"""
UPTIME = """concat(' 10:00:00 up ', CASE WHEN k % 2 = 0 THEN concat(k % 30 + 2, ' days,  4:05') ELSE concat(k % 12, ':30') END, ',  ', k % 5 + 2, ' users,  load average: ', k % 9, '.25, 1.50, 0.75\\n')"""


@query("host_memory", "M5 M1", "host_outputs", """
SELECT session_id, 16000 AS total_mb, u AS used_mb, 16000 - u AS available_mb, TRUE AS percents_agree, (16000 - u) / 16000.0 * 100 < 9.95 AS memory_pressure, k % 3 AS swap_used_mb, k % 3 > 0 AS swap_in_use
FROM (SELECT session_id, CAST(regexp_extract(content, 'Mem:  16000 ([0-9]+) ', 1) AS BIGINT) AS u, CAST(substring(session_id, 5) AS BIGINT) AS k FROM host_outputs) x""")
def host_memory(t):
    rows = hosts.parse_free(t.host_outputs())
    near = lambda shown, part: F.abs(F.col(shown) - F.col(part) / F.col("total_mb") * 100) < 0.0501
    agree = near("used_percent", "used_mb") & near("available_percent", "available_mb")
    return rows.select("session_id", "total_mb", "used_mb", "available_mb", agree.alias("percents_agree"), "memory_pressure", "swap_used_mb", "swap_in_use")


@query("host_command_files", "M1", "host_outputs", """
SELECT session_id, 'free_m' AS command, CASE WHEN CAST(substring(session_id, 5) AS BIGINT) % 2 = 0 THEN 'free_m' ELSE 'sos_commands/free_m' END AS path FROM host_outputs""")
def host_command_files(t):
    even = F.substring("session_id", 5, 20).cast("bigint") % 2 == 0
    files = t.host_outputs().select("session_id", F.explode(F.when(even, F.array(F.lit("deep/er/free_m.txt"), F.lit("free_m"))).otherwise(F.array(F.lit("a/free_m"), F.lit("sos_commands/free_m")))).alias("path"))
    return hosts.find_commands(files)


@query("host_top", "M2", "", f"""
WITH {B} SELECT session_id, k % 13 + 0.5 AS load_1min, 200 + k AS tasks_total, k % 15 AS tasks_zombie, CAST(90 - b % 60 AS DOUBLE) AS cpu_idle, CAST(k % 40 AS DOUBLE) AS cpu_iowait, 16384000 AS mem_total_kb, (b % 9000) * 1024 AS mem_free_kb, (b % 9000 + 500) * 1024 AS mem_available_kb, 2097152 AS swap_total_kb FROM s""")
def host_top(t):
    headers, _ = hosts.parse_top(output(t, "top_cpu", TOP))
    return headers.select("session_id", "load_1min", "tasks_total", "tasks_zombie", "cpu_idle", "cpu_iowait", "mem_total_kb", "mem_free_kb", "mem_available_kb", "swap_total_kb")


@query("host_top_processes", "M2 G7", "", f"""
WITH {B}, x AS (SELECT session_id, 100 + k AS pid, 'git' AS "user", k % 90 + 0.5 AS cpu, 7.5 AS mem, 'puma: worker 1' AS command_line FROM s UNION ALL SELECT session_id, 900 + k, 'root', 12.0, CAST(k % 30 AS DOUBLE), 'gitaly' FROM s)
SELECT session_id, pid, "user", cpu, mem, command_line FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cpu DESC, pid) AS r FROM x) y WHERE r <= 1""")
def host_top_processes(t):
    _, processes = hosts.parse_top(output(t, "top_cpu", TOP))
    return hosts.top_processes(processes, "cpu", 1).select("session_id", "pid", "user", "cpu", "mem", "command_line")


@query("host_vmstat", "M3 E30", "", f"""
WITH {B}, x AS (SELECT session_id, k % 3 AS si, b % 100 AS id, k % 50 AS wa FROM s UNION ALL SELECT session_id, 0, 60, 4 FROM s)
SELECT session_id, count(*) AS samples, round(avg(si), 2) AS avg_si, round(avg(id), 2) AS avg_id, round(avg(wa), 2) AS avg_wa, max(si) AS max_si, max(id) AS max_id, max(wa) AS max_wa FROM x GROUP BY 1""")
def host_vmstat(t):
    samples, _ = hosts.parse_vmstat(output(t, "vmstat", VMSTAT))
    return hosts.sample_averages(samples, ["session_id"], ["si", "id", "wa"])


@query("host_vmstat_problems", "M3", "", f"""
WITH {B} SELECT session_id, 1 AS sample_no, 'swapping' AS issue, concat('si=', CAST(k % 3 AS STRING), ', so=0') AS details FROM s WHERE k % 3 > 0 UNION ALL SELECT session_id, 1, 'high_io_wait', concat('wa=', CAST(k % 50 AS STRING), '%') FROM s WHERE k % 50 > 30
UNION ALL SELECT session_id, 1, 'low_idle', concat('idle=', CAST(b % 100 AS STRING), '%') FROM s WHERE b % 100 < 10""")
def host_vmstat_problems(t):
    return hosts.parse_vmstat(output(t, "vmstat", VMSTAT))[1].select("session_id", "sample_no", "issue", "details")


@query("host_iostat", "M4 E30", "", f"""
WITH {B} SELECT session_id, 'sda' AS device, 1 AS samples, CAST(b % 100 AS DOUBLE) AS avg_util, b % 50 + 0.5 AS avg_await, b % 100 > 90 AS high_util FROM s UNION ALL SELECT session_id, 'sdb', 1, 10.0, 1.5, FALSE FROM s""")
def host_iostat(t):
    rows = hosts.parse_iostat(output(t, "iostat", IOSTAT))
    found = hosts.sample_averages(rows.where("extended").withColumn("high", F.col("high_util").cast("int")), ["session_id", "device"], ["util", "await", "high"])
    return found.select("session_id", "device", "samples", "avg_util", "avg_await", (F.col("max_high") > 0).alias("high_util"))


@query("host_iostat_basic", "M4", "", f"WITH {B} SELECT session_id, 'sda' AS device, CAST(k % 7 AS DOUBLE) AS tps, 4.0 AS kb_wrtn FROM s")
def host_iostat_basic(t):
    return hosts.parse_iostat(output(t, "iostat", IOSTAT)).where("not extended").select("session_id", "device", "tps", F.col("kB_wrtn").alias("kb_wrtn"))


@query("host_filesystems", "M6 F13", "", f"""
WITH {B} SELECT session_id, '/dev/sda1' AS filesystem, 'ext4' AS type, '100G' AS size, b % 100 AS use_percent, '/' AS mount, b % 100 > 90 AS is_critical FROM s UNION ALL SELECT session_id, 'tmpfs', 'tmpfs', '7.8G', 0, '/dev/shm', FALSE FROM s
UNION ALL SELECT session_id, '/dev/mapper/very-long-volume-name', 'xfs', '2T', 85 + k % 10, '/var/opt data', 85 + k % 10 > 90 FROM s""")
def host_filesystems(t):
    return hosts.parse_df(output(t, "df_hT", DF))[0].select("session_id", "filesystem", "type", "size", "use_percent", "mount", "is_critical")


@query("host_disk_totals", "M6", "", f"""
WITH {B} SELECT session_id, 2148.0 AS total_gb, CAST(1024 + b % 100 AS DOUBLE) AS used_gb, CAST(1124 - b % 100 AS DOUBLE) AS available_gb, round((1024 + b % 100) / 2148.0 * 100, 1) AS use_percent FROM s""")
def host_disk_totals(t):
    return hosts.parse_df(output(t, "df_hT", DF))[1].select("session_id", "total_gb", "used_gb", "available_gb", "use_percent")


@query("host_connections", "M7", "", f"""
WITH {B} SELECT session_id, 'tcp' AS protocol, 'LISTEN' AS state, 1 AS count, CAST(NULL AS STRING) AS issue FROM s UNION ALL SELECT session_id, 'tcp', 'CLOSE_WAIT', 100 + k % 2, CASE WHEN k % 2 = 1 THEN 'Many sockets wait to be closed' END FROM s
UNION ALL SELECT session_id, 'udp', NULL, 1, NULL FROM s UNION ALL SELECT session_id, 'tcp', 'ESTABLISHED', 1, NULL FROM s""")
def host_connections(t):
    return hosts.parse_netstat(output(t, "netstat", NETSTAT)).drop("command")


@query("host_listening_ports", "M7 H2", "", f"WITH {B} SELECT session_id, CAST(8000 + k % 5 AS STRING) AS port FROM s")
def host_listening_ports(t):
    return hosts.listening_ports(output(t, "netstat", NETSTAT)).select("session_id", "port")


@query("host_processes", "M8", "", f"""
WITH {B} SELECT session_id, 'git' AS "user", 'S' AS state, CAST(k % 100 AS DOUBLE) AS cpu, 5.0 AS mem, 'puma: master process' AS command_line, k % 100 > 50 AS high_cpu, FALSE AS high_mem, FALSE AS zombie FROM s
UNION ALL SELECT session_id, 'root', 'Z', 0.0, CAST(k % 40 AS DOUBLE), 'defunct', FALSE, k % 40 > 20, TRUE FROM s""")
def host_processes(t):
    return hosts.parse_ps(output(t, "ps", PS)).select("session_id", "user", "state", "cpu", "mem", "command_line", "high_cpu", "high_mem", "zombie")


@query("host_process_states", "M8", "", f"WITH {B} SELECT session_id, x.state AS state, 1 AS count FROM s CROSS JOIN (SELECT unnest(['S', 'Z']) AS state) x")
def host_process_states(t):
    return hosts.ps_counts(hosts.parse_ps(output(t, "ps", PS)), "state").select("session_id", "state", "count")


@query("host_uptime", "M9", "", f"""
WITH {B} SELECT session_id, k % 9 + 0.25 AS load_1min, CAST(CASE WHEN k % 2 = 0 THEN k % 30 + 2 END AS INT) AS uptime_days, CAST(CASE WHEN k % 2 = 0 THEN 4 ELSE k % 12 END AS INT) AS uptime_hours, CAST(CASE WHEN k % 2 = 0 THEN 5 ELSE 30 END AS INT) AS uptime_minutes, CAST(k % 5 + 2 AS INT) AS users FROM s""")
def host_uptime(t):
    return hosts.parse_uptime(output(t, "uptime", UPTIME)).select("session_id", "load_1min", "uptime_days", "uptime_hours", "uptime_minutes", "users")


@query("host_generic_outputs", "M10", "", """
SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END AS line_count, length(text) AS size, len(regexp_extract_all(text, '[0-9]+\\.?[0-9]*')) AS numbers,
 array_to_string(list_filter(['error', 'fail', 'critical', 'warning', 'abort', 'panic'], lambda w: contains(lower(text), w)), ',') AS issues FROM documents""")
def host_generic_outputs(t):
    rows = hosts.parse_generic(t.read("documents").select(F.col("doc_id").alias("session_id"), F.lit("any").alias("command"), F.col("text").alias("content")))
    return rows.select(F.col("session_id").alias("doc_id"), "line_count", "size", "numbers", F.concat_ws(",", "potential_issues").alias("issues"))


HEALTH = f"""{B}, m AS (SELECT session_id, 'load' AS metric, CAST(k % 13 + 0.5 AS DOUBLE) AS value, 4 AS w, 8 AS c FROM s UNION ALL SELECT session_id, 'cpu', CAST(10 + b % 60 AS DOUBLE), 80, 90 FROM s UNION ALL SELECT session_id, 'iowait', CAST(k % 40 AS DOUBLE), 15, 30 FROM s
 UNION ALL SELECT session_id, 'memory', round((1000 + (b * 7) % 15000) / 16000.0 * 100, 6), 80, 90 FROM s UNION ALL SELECT session_id, 'swap', CASE WHEN k % 3 > 0 THEN 1.0 ELSE 0.0 END, 0, 0 FROM s UNION ALL SELECT session_id, 'disk', CAST(b % 100 AS DOUBLE), 80, 90 FROM s),
r AS (SELECT *, CASE WHEN value > c THEN 2 WHEN value > w THEN 1 ELSE 0 END AS rank FROM m)"""


def parsed_hosts(t):
    top, _ = hosts.parse_top(output(t, "top_cpu", TOP))
    vmstat, _ = hosts.parse_vmstat(output(t, "vmstat", VMSTAT))
    return top, vmstat, hosts.parse_free(t.host_outputs()), hosts.parse_df(output(t, "df_hT", DF))[0]


@query("host_health", "M11", "", f"""
WITH {HEALTH} SELECT session_id, metric, value, CASE rank WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'good' END AS status, CASE max(rank) OVER (PARTITION BY session_id) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'good' END AS overall FROM r""")
def host_health(t):
    return hosts.host_health(*parsed_hosts(t)).withColumn("value", F.round("value", 6))


@query("host_alerts", "M12", "", f"""
WITH {B} SELECT session_id, 'critical' AS type, 'Memory is being swapped' AS alert FROM s WHERE k % 3 > 0 UNION ALL SELECT session_id, 'warning', concat(CAST(k % 15 AS STRING), ' processes left as zombies') FROM s WHERE k % 15 > 10
UNION ALL SELECT session_id, 'critical', concat('Load average at ', CAST(k % 13 AS STRING), '.50') FROM s WHERE k % 13 >= 10""")
def host_alerts(t):
    top, vmstat, _, _ = parsed_hosts(t)
    return hosts.host_alerts(top, vmstat)


@query("vmstat_problem_samples", "E30", "", f"""
WITH {B} SELECT session_id, 1 AS sample_no FROM s WHERE k % 3 > 0 OR k % 50 > 30 OR b % 100 < 20""")
def vmstat_problem_samples(t):
    samples, _ = hosts.parse_vmstat(output(t, "vmstat", VMSTAT))
    return hosts.vmstat_problem_samples(samples).select("session_id", "sample_no")


# Kubernetes ---------------------------------------------------------------------------------------

EVENTS = """e AS (SELECT session_id, line_no, trim(substring(content, 1, 12)) AS last_seen, trim(substring(content, 13, 10)) AS type, trim(substring(content, 23, 16)) AS reason, trim(substring(content, 39, 20)) AS object_name, substring(content, 59) AS message,
 CASE WHEN substring(content, 13, 7) = 'Warning' THEN 'warning' ELSE 'info' END AS severity FROM kube_events)"""


def events(t):
    lines = t.kube_events()
    header = "LAST SEEN   TYPE      REASON          OBJECT              MESSAGE"
    heads = lines.select("session_id").distinct().select("session_id", F.lit(1).cast("bigint").alias("line_no"), F.lit(header).alias("content"))
    return kube.parse_events(lines.unionByName(heads))


@query("kube_event_rows", "N4", "kube_events", f"WITH {EVENTS} SELECT * FROM e")
def kube_event_rows(t):
    return events(t).select("session_id", "line_no", "last_seen", "type", "reason", "object_name", "message", "severity")


@query("kube_event_search", "C14", "kube_events", f"""
WITH {EVENTS} SELECT session_id, line_no FROM e WHERE (type = 'Warning' AND reason <> 'Created' AND NOT contains(object_name, 'web-3')) OR contains(lower(message), 'urgent')""")
def kube_event_search(t):
    condition = p.any_of(
        p.all_of(p.eq("type", "warning"), p.neq("reason", "Created"), p.field_not_contains("object_name", "web-3")), p.contains("URGENT")
    )
    return kube.search(events(t), condition).select("session_id", "line_no")


@query("kube_event_reasons", "E31", "kube_events", f"""
WITH {EVENTS}, c AS (SELECT session_id, severity, reason, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT session_id, severity, CAST(sum(n) AS BIGINT) AS events, max_by(reason, n * 1000 + ascii(reason)) AS top_reason, max(n) AS top_count FROM c GROUP BY 1, 2""")
def kube_event_reasons(t):
    return kube.event_reasons(events(t))


@query("kube_raw_event_fields", "N5", "kube_events", f"""
WITH {EVENTS} SELECT session_id, line_no, type, CASE WHEN reason = 'FailedMount' THEN 'Failed' WHEN reason = 'Created' THEN 'Created' END AS reason, NULLIF(array_to_string(list_slice(list_filter(string_split(message, ' '), lambda x: x <> ''), 2, 9), ' '), '') AS message FROM e""")
def kube_raw_event_fields(t):
    return t.kube_events().select("session_id", "line_no", kube.event_fields(F.col("content")).alias("f")).select("session_id", "line_no", "f.*")


def kube_files(t):
    """A bundle per session of the log lines; node2 lacks the indicator files."""
    names = F.when(F.col("session_id") == "node2", F.array(F.lit("a_b.log"))).otherwise(F.array(*[F.lit(n) for n in ("kubeSOS.info", "get_pods", "events", "values.yaml", "web-1_webservice.log", "x_sidecar_previous.log")]))
    return t.log_lines(numbered=False).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", F.explode(names).alias("path"), "n")


@query("kube_bundles", "N1", "log_lines", """
SELECT session_id, CASE WHEN session_id = 'node2' THEN 0 ELSE 3 END AS indicators, session_id <> 'node2' AS is_kube FROM log_lines GROUP BY 1""")
def kube_bundles(t):
    return kube.is_kube_bundle(kube_files(t))


@query("kube_files", "N2 N3", "log_lines", """
SELECT session_id, path, category, component FROM (SELECT DISTINCT session_id FROM log_lines WHERE session_id <> 'node2') s CROSS JOIN (VALUES ('kubeSOS.info', 'commands', 'unknown'), ('get_pods', 'commands', 'pods'), ('events', 'events', 'unknown'),
 ('values.yaml', 'commands', 'unknown'), ('web-1_webservice.log', 'pod_logs', 'webservice'), ('x_sidecar_previous.log', 'pod_logs', 'sidecar')) v(path, category, component) UNION ALL SELECT DISTINCT session_id, 'a_b.log', 'pod_logs', 'b' FROM log_lines WHERE session_id = 'node2'""")
def kube_file_kinds(t):
    return kube_files(t).select("session_id", "path", kube.kube_category(F.col("path")).alias("category"), kube.kube_component(F.col("path")).alias("component"))


POD = """pod AS (SELECT *, CASE component WHEN 'rails' THEN 'webservice' ELSE component END AS pod_component, CASE WHEN severity IN ('ERROR', 'FATAL') THEN 'error' WHEN severity = 'WARN' THEN 'warning' ELSE 'info' END AS level FROM log_lines)"""


def pod_lines(t):
    name = F.concat(F.lit("pod-1_"), F.when(F.col("component") == "rails", "webservice").otherwise(F.col("component")), F.lit(".log"))
    return t.log_lines().select("session_id", name.alias("path"), "line_no", "content")


@query("pod_log_statistics", "E23 I8 I9", "log_lines", f"""
WITH {POD} SELECT session_id, concat('pod-1_', pod_component, '.log') AS path, pod_component AS component, 'json' AS format, count(*) AS total_lines, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM pod GROUP BY 1, 2, 3""")
def pod_log_statistics(t):
    return kube.pod_log_stats(pod_lines(t))


@query("pod_log_patterns", "E23 I8", "log_lines", """
SELECT session_id, CASE WHEN severity = 'WARN' THEN 'warning' WHEN contains(message, 'timeout') THEN 'timeout_error' WHEN contains(message, 'connection') THEN 'connection_error' ELSE 'generic_error' END AS pattern, count(*) AS count FROM log_lines WHERE severity IN ('ERROR', 'WARN') GROUP BY 1, 2""")
def pod_log_patterns(t):
    return kube.pod_log_patterns(pod_lines(t)).groupBy("session_id", "pattern").agg(F.sum("count").alias("count"))


@query("pod_components", "E24", "log_lines", f"""
WITH {POD} SELECT session_id, pod_component AS component, count(DISTINCT path) AS files, count(*) AS total_lines, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM pod GROUP BY 1, 2""")
def pod_components(t):
    return kube.component_stats(kube.pod_log_stats(pod_lines(t)))


@query("bundle_info", "N6", "", f"WITH {B} SELECT session_id, 'kube version' AS key, concat('v1.', CAST(k % 30 AS STRING)) AS value FROM s UNION ALL SELECT session_id, 'namespace', concat('ns', CAST(b % 5 AS STRING)) FROM s")
def bundle_info(t):
    return kube.parse_info(output(t, "info", "concat('Kube Version = [v1.', k % 30, ']\\nnoise\\nNamespace=[ns', b % 5, '] [x]\\n')"))


@query("pod_descriptions", "N7", "", f"WITH {B} SELECT session_id, 2 AS total_pods, CASE WHEN k % 12 > 5 THEN 1 ELSE 0 END AS high_restarts, k % 4 = 0 AS has_pending, k % 5 = 0 AS has_failed FROM s")
def pod_descriptions(t):
    text = "concat('Name: a\\n  Restart Count:  ', k % 12, '\\n', CASE WHEN k % 4 = 0 THEN 'Status: Pending' ELSE '' END, '\\n\\n\\nName: b\\nRestart Count: 2\\n', CASE WHEN k % 5 = 0 THEN 'Reason: CrashLoopBackOff' ELSE '' END, '\\n\\n\\n')"
    return kube.pod_health(output(t, "describe_pods", text))


@query("described_sections", "F5", "kube_events", """
SELECT session_id, line_no, concat('Sec', CAST((line_no - 1) - (line_no - 1) % 7 AS STRING)) AS section FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS line_no FROM kube_events) x""")
def described_sections(t):
    from ..operators.ordered import number_rows
    rows = number_rows(t.kube_events(), ["session_id"], ["line_no"], F.floor(F.col("line_no") / 4096), "n")
    text = F.when((F.col("n") - 1) % 7 == 0, F.concat(F.lit("Sec"), F.col("n") - 1, F.lit(": x"))).otherwise(F.concat(F.lit("  k: "), F.col("n")))
    lines = rows.select("session_id", F.lit("describe_pods").alias("path"), F.col("n").alias("line_no"), text.alias("content"))
    return kube.with_section(lines).select("session_id", "line_no", "section")


@query("wrapped_records", "F13", "kube_events", """
SELECT session_id, CAST(floor((n - 1) / 3) * 3 + 1 AS BIGINT) AS line_no, string_agg(CAST(n AS STRING), ' ' ORDER BY n) AS content FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n FROM kube_events) x GROUP BY 1, 2""")
def wrapped_records(t):
    from ..operators.ordered import number_rows
    rows = number_rows(t.kube_events(), ["session_id"], ["line_no"], F.floor(F.col("line_no") / 4096), "n")
    lines = rows.select("session_id", F.lit("df").alias("path"), F.col("n").alias("line_no"), F.concat(F.lit(" "), F.col("n")).alias("content"))
    return hosts.join_wrapped(lines, (F.col("line_no") - 1) % 3 == 0).select("session_id", "line_no", "content")


@query("kube_insights", "N8", "kube_events log_lines", f"""
WITH {EVENTS}, {POD}, c AS (SELECT session_id, pod_component, count(*) AS n, count(*) FILTER (level = 'error') AS errors FROM pod GROUP BY 1, 2)
SELECT session_id, 'warning' AS type, 'Many cluster warnings' AS title, CAST(count(*) AS DOUBLE) AS value FROM e WHERE severity = 'warning' GROUP BY 1 HAVING count(*) > 10
UNION ALL SELECT session_id, 'critical', concat('Errors stand out in ', pod_component), round(errors / n * 100, 2) FROM c WHERE errors / n > 0.01""")
def kube_insights(t):
    pods = kube.pod_health(output(t, "describe_pods", "'Name: a'"))
    return kube.kube_insights(events(t), kube.component_stats(kube.pod_log_stats(pod_lines(t))), pods)


# triage -------------------------------------------------------------------------------------------

TRIAGE = f"""tr AS (SELECT session_id, path, {SERVICE_SQL} AS service, CASE WHEN severity = 'FATAL' THEN 'CRITICAL' WHEN severity = 'ERROR' THEN 'ERRORS' WHEN regexp_matches(content, 'duration') AND TRY_CAST(regexp_extract(content, '([0-9]+)(?:ms|\\.?[0-9]*s)', 1) AS BIGINT) > 1000 THEN 'PERFORMANCE'
 WHEN regexp_matches(content, 'duration') THEN NULL WHEN severity = 'WARN' THEN 'WARNINGS' END AS category FROM log_lines WHERE regexp_matches(content, '(?i)ERROR|FAIL|WARN|timeout|slow|refused|unavailable|deadlock|duration.*[0-9]{{4,}}|5[0-9][0-9]'))"""


@query("triaged_lines", "E25", "log_lines", f"WITH {TRIAGE} SELECT session_id, path, service, category, count(*) AS lines FROM tr WHERE category IS NOT NULL GROUP BY 1, 2, 3, 4")
def triaged_lines(t):
    return triage.triage(t.log_lines(numbered=False).select("session_id", "path", "content"), file_catalog(t))


@query("service_triage", "O1", "log_lines", f"""
WITH {TRIAGE}, c AS (SELECT session_id, service, count(*) FILTER (category = 'CRITICAL') AS critical, count(*) FILTER (category = 'ERRORS') AS errors, 0 AS timeouts, count(DISTINCT path) AS files FROM tr WHERE category IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN errors > 10 THEN 'DEGRADED' WHEN timeouts > 5 THEN 'WARNING' ELSE 'GOOD' END AS health FROM c""")
def service_triage(t):
    return triage.service_triage(triage.triage(t.log_lines(numbered=False).select("session_id", "path", "content"), file_catalog(t)))


@query("fleet_health", "O2", "log_lines", f"""
WITH n AS (SELECT session_id, unnest(['postgresql','sidekiq','gitaly','rails','redis','nginx','registry','pages','prometheus']) AS service FROM (SELECT DISTINCT session_id FROM log_lines) x),
c AS (SELECT session_id, {SERVICE_SQL} AS service, count(*) FILTER (severity = 'FATAL') AS critical, count(*) FILTER (severity = 'ERROR') AS errors FROM log_lines GROUP BY 1, 2)
SELECT n.session_id, n.service, CASE WHEN c.service IS NULL THEN 'MISSING' WHEN critical > 0 THEN 'CRITICAL' WHEN errors > 5 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM n LEFT JOIN c ON n.session_id = c.session_id AND n.service = c.service""")
def fleet_health(t):
    files = file_catalog(t)
    return triage.fleet_health(triage.triage(t.log_lines(numbered=False).select("session_id", "path", "content"), files, quick=True), files)


@query("deep_dive", "E26", "log_lines", """
WITH m AS (SELECT 'postgresql' AS service, 'connection_failures' AS category FROM log_lines WHERE contains(message, 'could not connect') UNION ALL SELECT 'postgresql', 'deadlocks_locks' FROM log_lines WHERE contains(message, 'deadlock') OR contains(message, 'lock timeout'))
SELECT service, category, count(*) AS lines, CAST(CASE WHEN service IS NULL THEN 3 WHEN category IS NULL THEN 1 ELSE 0 END AS BIGINT) AS level FROM m GROUP BY ROLLUP (service, category)""")
def deep_dive(t):
    return triage.deep_dive(t.log_lines(numbered=False).select("session_id", "path", "content"), file_catalog(t))


@query("deep_dive_top", "E26", "log_lines", """
SELECT 'postgresql' AS service, CASE WHEN contains(message, 'could not connect') THEN 'connection_failures' ELSE 'deadlocks_locks' END AS category, count(*) AS lines FROM log_lines WHERE status >= 500 GROUP BY 2""")
def deep_dive_top(t):
    return triage.deep_dive_top(triage.deep_dive(t.log_lines(numbered=False).select("session_id", "path", "content"), file_catalog(t))).drop("level")
