"""Severity and error class of a line."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .error_rules import alternation, found, sql_text
from .fields import field

# ---- fixed values: words and patterns per class, matched as written ------------------------------

CRITICAL_WORDS = [
    "CRITICAL", "critical", "PANIC", "panic", "EMERGENCY", "emergency", "FATAL", "fatal", "SEGFAULT", "segfault",
    "Segmentation fault", "kernel panic", "KERNEL PANIC", "OOM", "Out of memory", "OUT OF MEMORY", "oom-killer",
    "OOM killer", "stack overflow", "STACK OVERFLOW", "deadlock", "DEADLOCK", "data corruption", "DATA CORRUPTION",
]
ERROR_WORDS = [
    "ERROR", "error", "Error", "ERR", "FAIL", "fail", "Fail", "FAILED", "failed", "Failed", "FAILURE", "failure",
    "Failure", "EXCEPTION", "exception", "Exception", "Traceback", "traceback", "TRACEBACK", "abort", "ABORT", "Abort",
    "refused", "REFUSED", "denied", "DENIED", "timeout", "TIMEOUT", "Timeout", "timed out", "TIMED OUT",
    "connection refused", "CONNECTION REFUSED", "cannot connect", "CANNOT CONNECT", "unreachable", "UNREACHABLE",
    "not found", "NOT FOUND", "invalid", "INVALID", "corrupt", "CORRUPT", "permission denied", "PERMISSION DENIED",
    "access denied", "ACCESS DENIED", "unauthorized", "UNAUTHORIZED",
]
WARNING_WORDS = [
    "WARN", "warn", "Warn", "WARNING", "warning", "Warning", "deprecated", "DEPRECATED", "Deprecated", "slow", "SLOW",
    "degraded", "DEGRADED", "retry", "RETRY", "retrying", "RETRYING", "high load", "HIGH LOAD", "low memory",
    "LOW MEMORY", "disk space", "DISK SPACE", "threshold", "THRESHOLD",
]
# component: patterns, then words (both without regard to case)
COMPONENT_RULES = {
    "sidekiq": (
        [r'"class":"[^"]+","error_class":"([^"]+)"', r'"error_message":"([^"]+)"', r"fail.*JobWrapper", r"dead.*JobWrapper",
         r"retry_count.*exceeded", r"Sidekiq::Shutdown", r"job_status.*fail", r"exceeded memory limit", r"RSS.*exceeded"],
        ["error_class", "error_message", "fail", "dead", "retry", "exceeded", "Shutdown", "timeout"]),
    "gitaly": (
        [r"code.*Aborted", r"code.*Canceled", r"code.*DeadlineExceeded", r"code.*Internal", r"code.*NotFound",
         r"code.*PermissionDenied", r"code.*ResourceExhausted", r"code.*Unavailable", r"code.*Unknown",
         r"repository.*not found", r"repository.*does not exist", r"git.*fatal", r"pack-objects.*died",
         r"repository.*corrupted", r"dial.*connection refused", r"context deadline exceeded", r"stream terminated"],
        ["error", "fatal", "failed", "Aborted", "Canceled", "DeadlineExceeded", "Unavailable", "refused", "corrupted"]),
    "praefect": (
        [r"replication.*failed", r"repository.*inconsistent", r"primary.*unavailable", r"secondary.*behind",
         r"quorum.*not reached", r"reconciliation.*failed"],
        ["error", "failed", "inconsistent", "unavailable", "behind", "quorum", "reconciliation"]),
    "postgresql": (
        [r"^ERROR:", r"^FATAL:", r"^PANIC:", r"LOG:.*ERROR", r"LOG:.*FATAL", r"deadlock detected", r"too many connections",
         r"connection refused", r"could not connect", r"out of shared memory", r"canceling statement",
         r"terminating connection", r"recovery conflict", r"lock timeout", r"statement timeout", r"duplicate key",
         r"foreign key constraint", r"relation.*does not exist", r"permission denied"],
        ["ERROR:", "FATAL:", "PANIC:", "deadlock", "too many connections", "connection refused", "out of memory",
         "timeout", "duplicate key"]),
    "patroni": (
        [r"ERROR.*patroni", r"failed to.*postgres", r"leader.*lost", r"failover.*triggered", r"timeline.*diverged",
         r"replication.*lag", r"standby.*behind", r"checkpoint.*timeout"],
        ["ERROR", "failed", "lost", "failover", "diverged", "lag", "timeout"]),
    "pgbouncer": (
        [r"ERROR.*pgbouncer", r"connection.*refused", r"server.*disconnected", r"client.*disconnected.*unexpectedly",
         r"login.*failed", r"pooler.*error", r"server_connect_timeout"],
        ["ERROR", "refused", "disconnected", "failed", "timeout"]),
    "redis": (
        [r"#.*Error", r"MISCONF", r"LOADING", r"BUSY", r"OOM", r"maxmemory", r"connection.*refused", r"connection.*reset",
         r"Connection timed out", r"master.*down", r"replica.*stale"],
        ["Error", "MISCONF", "OOM", "refused", "reset", "timeout", "down", "stale"]),
    "nginx": (
        [r"\s5\d{2}\s", r"upstream.*error", r"upstream.*timeout", r"upstream.*refused", r"connect\(\).*failed",
         r"no live upstreams", r"client.*closed.*connection", r"SSL.*error", r"certificate.*error"],
        ["error", "failed", "timeout", "refused", "upstream", "SSL"]),
    "puma": (
        [r"ERROR.*puma", r"worker.*died", r"worker.*timeout", r"worker.*killed", r"out of workers", r"backlog.*full",
         r"request.*timeout"],
        ["ERROR", "died", "timeout", "killed", "backlog"]),
    "workhorse": (
        [r"error.*workhorse", r"502 Bad Gateway", r"504 Gateway Timeout", r"upstream.*error", r"request.*canceled"],
        ["error", "Bad Gateway", "Gateway Timeout", "upstream", "canceled"]),
    "consul": (
        [r"\[ERR\]", r"\[ERROR\]", r"failed to sync", r"leader.*lost", r"no cluster leader", r"RPC.*failed",
         r"health check.*critical"],
        ["ERR", "ERROR", "failed", "lost", "critical"]),
    "geo": (
        [r"Geo::.*Error", r"Geo::.*Registry.*failed", r"sync.*failed", r"checksum.*mismatch",
         r"repository.*verification.*failed", r"file.*missing", r"replication.*lag"],
        ["Error", "failed", "mismatch", "missing", "lag"]),
    "registry": (
        [r"level.*error", r"error.*registry", r"blob.*unknown", r"manifest.*unknown", r"unauthorized", r"storage.*error"],
        ["error", "unknown", "unauthorized", "storage"]),
    "system": (
        [r"kernel:.*error", r"kernel:.*failed", r"segfault", r"oom-killer", r"Out of memory", r"hardware error",
         r"I/O error", r"disk.*error", r"EXT4-fs error", r"XFS.*error", r"BTRFS.*error", r"device.*offline",
         r"link.*down", r"connection tracking.*full", r"nf_conntrack.*full"],
        ["error", "failed", "segfault", "oom", "Out of memory", "I/O error", "disk", "offline", "down"]),
}
QUICK_SCAN = [
    r"\bERROR\b", r"\bFATAL\b", r"\bPANIC\b", r"\bCRITICAL\b", r"\bFAIL(?:ED|URE)?\b", r"\bEXCEPTION\b", r"\bTraceback\b",
    r'"severity"\s*:\s*"(?:ERROR|FATAL)"', r'"level"\s*:\s*"(?:error|fatal)"', r'"exception[._](?:class|message)"',
    r'"status"\s*:\s*5\d{2}', r"ERROR:", r"FATAL:", r"\[ERR(?:OR)?\]",
]
# component by a part of the path, in order
DETECT_BY_PATH = [
    ("sidekiq", ["sidekiq"]), ("gitaly", ["gitaly"]), ("praefect", ["praefect"]), ("postgresql", ["postgresql", "postgres"]),
    ("patroni", ["patroni"]), ("pgbouncer", ["pgbouncer"]), ("redis", ["redis"]), ("nginx", ["nginx"]), ("puma", ["puma"]),
    ("workhorse", ["workhorse", "gitlab-workhorse"]), ("consul", ["consul"]), ("geo", ["geo.log", "geo_"]),
    ("registry", ["registry"]), ("gitlab-rails", ["gitlab-rails", "production_json", "api_json", "application_json"]),
    ("system", ["syslog", "messages", "dmesg", "kern.log", "auth.log"]),
]

# ---- column functions ----------------------------------------------------------------------------


def word_severity(content: Column) -> Column:
    """critical, error, warning, info or debug, by the words of a line."""
    low = F.lower(content)
    return (
        F.when(low.rlike("fatal|panic|critical|emergency"), "critical")
        .when(low.rlike("error|fail|exception|traceback"), "error")
        .when(low.rlike("warn|deprecated"), "warning")
        .when(low.rlike("info|notice"), "info").otherwise("debug")
    )


def _first_word(words: list[str], text: str, lower: bool = False) -> str:
    """The first of the words that a text holds, else null. The list is a literal and the test a lambda: code of constant size,
    where a CASE over a few hundred words outgrows what the JVM compiles."""
    listed = ", ".join(sql_text(w) for w in dict.fromkeys(words))
    return f"get(filter(array({listed}), w -> contains({text}, {'lower(w)' if lower else 'w'})), 0)"


def class_steps(content: str = "content", component: str = "component", low: str = "_low") -> dict[str, str]:
    """Steps of line classification, as SQL by column: what matched among critical words, the rules of the component, general error
    words and warnings. Each is tested only if those before it are null."""
    branches = []
    for name, (patterns, words) in COMPONENT_RULES.items():
        tests = [f"CASE WHEN {found(p, content, low)} THEN {sql_text(p)} END" for p in patterns]
        branches.append(f"WHEN {sql_text(name)} THEN coalesce({', '.join([*tests, _first_word(words, low, True)])})")
    listed = f"{component} IN ({', '.join(sql_text(n) for n in COMPONENT_RULES)})"
    # a component without rules of its own is searched for the general words without regard to case
    ours = f"CASE {component} {' '.join(branches)} ELSE {_first_word(ERROR_WORDS, low, True)} END"
    return {
        "_critical": _first_word(CRITICAL_WORDS, content),
        "_ours": f"CASE WHEN _critical IS NULL THEN {ours} END",
        "_general": f"CASE WHEN _critical IS NULL AND _ours IS NULL AND {listed} THEN {_first_word(ERROR_WORDS, content)} END",
        "_warning": f"CASE WHEN coalesce(_critical, _ours, _general) IS NULL THEN {_first_word(WARNING_WORDS, content)} END",
    }


def class_of(component: str = "component") -> list[Column]:
    """is_error, severity, matched and category from the columns of class_steps."""
    error = F.coalesce("_critical", "_ours", "_general").isNotNull()
    severity = F.when(F.col("_critical").isNotNull(), "critical").when(error, "error").when(F.col("_warning").isNotNull(), "warning")
    category = (
        F.when(F.col("_critical").isNotNull(), "critical_error").when(F.col("_ours").isNotNull(), F.concat(F.col(component), F.lit("_error")))
        .when(F.col("_general").isNotNull(), "generic_error").when(F.col("_warning").isNotNull(), "warning")
    )
    matched = F.coalesce("_critical", "_ours", "_general", "_warning")
    return [error.alias("is_error"), severity.alias("severity"), matched.alias("matched"), category.alias("category")]


def classify_json(fields: Column | str = "fields") -> Column:
    """Struct (is_error, severity, category) of a JSON line: severity, exception keys, HTTP status, job status."""
    severity = F.lower(F.coalesce(field("severity", fields), field("level", fields), F.lit("")))
    status_text = F.coalesce(field("status", fields), field("status_code", fields))
    status = status_text.try_cast("int")
    raised = F.coalesce(*[field(n, fields) for n in ("exception.class", "exception_class", "error_class", "backtrace")]).isNotNull()
    job = F.coalesce(field("job_status", fields), field("status", fields))

    def verdict(is_error, level, category):
        return F.struct(F.lit(is_error).alias("is_error"), F.lit(level).cast("string").alias("severity"), F.lit(category).cast("string").alias("category"))

    return (
        F.when(severity.isin("fatal", "panic", "emergency"), verdict(True, "critical", "json_fatal"))
        .when(severity == "error", verdict(True, "error", "json_error"))
        .when(severity.isin("warn", "warning"), verdict(False, "warning", "json_warning"))
        .when(raised, verdict(True, "error", "exception"))
        .when((status >= 500) & (status < 600), verdict(True, "error", "http_5xx"))
        .when(status.isin(401, 403, 429), verdict(False, "warning", "http_auth_error"))
        .when(job == "fail", verdict(True, "error", "job_failure"))
        .otherwise(verdict(False, None, None))
    )


def quick_error(content: Column) -> Column:
    return content.rlike(alternation(QUICK_SCAN))


def component_by_path(path: Column) -> Column:
    p = F.lower(path)
    return F.coalesce(*[F.when(p.rlike("|".join(re.escape(w) for w in words)), name) for name, words in DETECT_BY_PATH])


def classify_pod_line(content: Column, is_json: Column, fields: Column | str = "fields") -> Column:
    """Struct (severity, pattern) of a container log line: JSON severity and exceptions, then word families."""
    low = F.lower(content)
    level = F.lower(F.coalesce(*[field(n, fields) for n in ("severity", "level", "log_level")]))
    raised = F.coalesce(field("exception.class", fields), field("exception", fields)).isNotNull()
    by_json = F.when(is_json, F.when(raised, "error").when(level.rlike("error|fatal"), "error").when(level.contains("warn"), "warning"))
    bad = low.rlike("error|exception|failed")
    family = (
        F.when(low.contains("timeout"), "timeout_error").when(low.contains("connection"), "connection_error")
        .when(low.rlike("permission|denied"), "permission_error").when(low.rlike("memory|oom"), "memory_error")
        .otherwise("generic_error")
    )
    severity = F.when(bad, "error").when(low.contains("warn"), "warning").otherwise(F.coalesce(by_json, F.lit("info")))
    pattern = F.when(bad, family).when(low.contains("warn"), "warning").otherwise(F.when(is_json & raised, "exception"))
    blank = F.trim(content) == ""
    return F.struct(F.when(blank, "info").otherwise(severity).alias("severity"), F.when(~blank, pattern).alias("pattern"))
