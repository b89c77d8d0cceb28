"""Triage of services: categories per file, deep dive by rules, health verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.error_rules import alternation, sql_text
from ..functions.fields import compute_once
from ..session import cut_lineage

# Services of the fleet health table.
HEALTH_SERVICES = "postgresql sidekiq gitaly rails redis nginx registry pages prometheus".split()

# Deep-dive rules, one per line: service, category, pattern. This project's own; pass another table to replace it.
DEEP_DIVE_TEXT = r"""
postgresql connection_failures could not connect to server|too many clients|remaining connection slots|no pg_hba\.conf entry|PG::ConnectionBad
postgresql deadlocks_locks deadlock detected|lock timeout|waiting for .*lock|could not serialize access
postgresql critical_errors PANIC:|FATAL:|PG::DiskFull|PG::OutOfMemory
postgresql slow_queries duration: [1-9]\d{3,}\.\d+ ms|temporary file.*size [1-9]\d{7,}
postgresql statement_errors duplicate key value|violates .*constraint|invalid input syntax|PG::QueryCanceled
postgresql replication replication slot.*does not exist|standby.*disconnected|timeline.*diverged
postgresql performance checkpoints are occurring too frequently|autovacuum:.*[1-9]\d{4,}
sidekiq critical_failures Sidekiq.*Shutdown|(?:worker|processor|manager).*died
sidekiq job_failures Job raised exception|retries_exhausted|moved to dead|"job_status":"fail"
sidekiq performance "duration(?:_s)?":\d{5,}|stuck jobs|job timeout exceeded
sidekiq memory memory_?killer|memory.*exceeded|Cannot allocate memory
sidekiq redis_issues Redis::(?:TimeoutError|CannotConnectError)|Redis connection lost
sidekiq queues queue.*(?:stuck|backlog)|heartbeat.*failed
gitaly grpc_errors rpc error:\s*code\s*=\s*\w+|GRPC::\w+|transport is closing
gitaly connection_failures dialing failed|failed to dial|no healthy .*nodes
gitaly replication_failures replication.*failed|voting.*failed|metadata.*inconsistent
gitaly timeouts deadline exceeded|context canceled
gitaly git_errors fatal:|pack-objects.*died|repository.*corrupt
rails exceptions ActionController::\w+Error|NoMethodError|NameError|"exception\.class"
rails database ActiveRecord::\w+|PG::\w+
rails http_errors "status":5\d{2}|500 Internal Server Error
rails timeouts Rack::Timeout|Timeout::Error|execution expired
rails memory NoMemoryError|memory.*exceeded
redis connection_failures Connection refused|Redis::CannotConnectError|Connection timed out
redis memory OOM command not allowed|maxmemory
redis persistence MISCONF|Can't save in background
redis replication MASTER.*(?:down|SYNC)|READONLY
nginx upstream upstream timed out|no live upstreams|connect\(\) failed
nginx http_errors "\s5\d{2}\s|50[234] (?:Bad Gateway|Service Unavailable|Gateway Time-?out)
nginx ssl SSL_do_handshake|certificate.*(?:expired|error)
nginx limits worker_connections are not enough|too many open files
kubernetes pods CrashLoopBackOff|ImagePullBackOff|OOMKilled|Evicted
kubernetes scheduling FailedScheduling|Insufficient (?:cpu|memory)
kubernetes probes (?:Liveness|Readiness) probe failed
geo sync sync.*failed|checksum mismatch|verification.*failed
geo replication replication.*lag|secondary.*behind
puma workers worker.*(?:died|killed|timeout)|out of workers
system kernel kernel panic|segfault|I/O error|oom-killer
registry storage blob unknown|manifest unknown|storage.*error
registry auth unauthorized|denied: access forbidden
prometheus scrape scrape.*fail|context deadline exceeded
prometheus storage TSDB.*(?:error|corrupt)|compaction failed
workhorse gateway badgateway|Bad Gateway|gateway timeout
workhorse uploads upload.*(?:failed|error)
"""


def deep_dive_rules(spark) -> DataFrame:
    rows = [tuple(line.split(" ", 2)) for line in DEEP_DIVE_TEXT.strip().split("\n")]
    return spark.createDataFrame(rows, "service string, category string, pattern string")


def is_triaged(content: Column, quick: bool = False) -> Column:
    """Lines that are looked at: alarming words; full mode adds slowness, warnings and 5xx."""
    # Words of lines that are looked at.
    quick_words = r"PANIC|FATAL|ERROR|FAIL|timeout|refused|unavailable|OOM|deadlock"
    full_words = r"ERROR|FAIL|WARN|timeout|slow|refused|unavailable|deadlock|duration.*[0-9]{4,}|5[0-9][0-9]"
    return content.rlike("(?i)" + (quick_words if quick else full_words))


def triage_category(content: Column) -> Column:
    """CRITICAL, ERRORS, TIMEOUTS, PERFORMANCE (more than 1000 logged), WARNINGS or null."""
    # Words of each category, in order.
    low = F.lower(content)
    slow = low.rlike("slow|duration|elapsed")
    number = F.regexp_extract(content, r"(\d+)(?:ms|\.?\d*s)", 1).try_cast("bigint")
    return (
        F.when(low.rlike("panic|fatal|critical|oom|crash"), "CRITICAL").when(low.rlike("error|fail|exception"), "ERRORS")
        .when(low.rlike("timeout|deadlock|refused"), "TIMEOUTS").when(slow, F.when(number > 1000, "PERFORMANCE"))
        .when(low.contains("warn"), "WARNINGS")
    )


def triage(lines: DataFrame, files: DataFrame, quick: bool = False) -> DataFrame:
    """Lines per (session, service, category, file), every file and every line counted."""
    rows = lines.where(is_triaged(F.col("content"), quick)).withColumn("category", triage_category(F.col("content")))
    counts = rows.where("category is not null").groupBy("session_id", "path", "category").agg(F.count(F.lit(1)).alias("lines"))
    return counts.join(files.select("session_id", "path", "service"), ["session_id", "path"])


def service_triage(triaged: DataFrame) -> DataFrame:
    """Per session and service: critical, error and timeout lines and a verdict."""
    n = lambda c: F.sum(F.when(F.col("category") == c, F.col("lines")).otherwise(0))
    per = triaged.groupBy("session_id", "service").agg(
        n("CRITICAL").alias("critical"), n("ERRORS").alias("errors"), n("TIMEOUTS").alias("timeouts"), F.countDistinct("path").alias("files")
    )
    verdict = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("errors") > 10, "DEGRADED").when(F.col("timeouts") > 5, "WARNING").otherwise("GOOD")
    return per.withColumn("health", verdict)


def fleet_health(triaged: DataFrame, files: DataFrame) -> DataFrame:
    """Every session against the nine services: CRITICAL, WARNING above five error lines, HEALTHY, or MISSING without files."""
    spark = triaged.sparkSession
    services = F.explode(F.array(*[F.lit(s) for s in HEALTH_SERVICES])).alias("service")
    wanted = files.select("session_id").distinct().select("session_id", services)
    present = files.groupBy("session_id", "service").agg(F.count(F.lit(1)).alias("files"))
    found = service_triage(triaged).select("session_id", "service", "critical", "errors")
    rows = wanted.join(present, ["session_id", "service"], "left").join(found, ["session_id", "service"], "left")
    status = F.when(F.col("files").isNull(), "MISSING").when(F.col("critical") > 0, "CRITICAL").when(F.col("errors") > 5, "WARNING").otherwise("HEALTHY")
    return rows.select("session_id", "service", status.alias("status"))


def is_geo_file(path: Column) -> Column:
    """Logs of replication between sites, which the catalogue counts as their host's service."""
    return F.lower(path).rlike(r"(^|/)geo[-_/.]|[-_]geo[-_/.]|/geo(_\w+)?\.log")


def deep_dive(lines: DataFrame, files: DataFrame, rules: DataFrame | None = None, most: int = 500_000) -> DataFrame:
    """Lines per (service, category) with subtotals: every line against the rules of its file's service.

    The rules are a small reference table and become literal patterns, compiled once per task; a service's rules
    run on its own lines only. A line may fall into several categories. Lines stay where they are, so that a long file is not one
    task's work: the list of files is broadcast if it has `most` rows or fewer, and joined as any table beyond.
    """
    spark = lines.sparkSession
    by_service: dict[str, list] = {}
    for r in (deep_dive_rules(spark) if rules is None else rules).collect():
        by_service.setdefault(r.service, []).append((r.category, r.pattern))
    whens = []
    for service, rows in sorted(by_service.items()):
        every = sql_text(alternation([p for _, p in rows]))
        cells = ", ".join(f"CASE WHEN rlike(content, {sql_text('(?i)' + p)}) THEN {sql_text(c)} END" for c, p in rows)
        whens.append(f"WHEN {sql_text(service)} THEN CASE WHEN rlike(content, {every}) THEN array_distinct(array_compact(array({cells}))) END")
    categories = F.expr(f"CASE service {' '.join(whens)} END")
    named = cut_lineage(files.select("session_id", "path", F.when(is_geo_file(F.col("path")), "geo").otherwise(F.col("service")).alias("service")))
    found = lines.join(F.broadcast(named) if named.count() <= most else named, ["session_id", "path"])
    found = compute_once(found, _c=categories).select("service", F.explode("_c").alias("category"))
    return found.rollup("service", "category").agg(F.count(F.lit(1)).alias("lines"), F.grouping_id().alias("level"))


def deep_dive_top(dive: DataFrame, k: int = 10) -> DataFrame:
    """Largest categories over all services."""
    return dive.where("level = 0").orderBy(F.desc("lines"), "service", "category").limit(k)
