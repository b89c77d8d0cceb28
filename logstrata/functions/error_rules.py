"""Fixed rule lists of the error jobs, and the pattern table.

The lists in the first part are fixed values: words and patterns that decide what counts as an error.
The pattern table in the second part is this project's own; any DataFrame with the same columns can
replace or extend it.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import any_substring, basename

# ---- fixed values --------------------------------------------------------------------------------

FALSE_POSITIVES = r"""
sh:\s+line\s+\d+:\s+\w+:\s+command not found
bash:\s+line\s+\d+:\s+\w+:\s+command not found
:\s+command not found
command not found
chpst:\s+fatal:\s+unknown user/group
fatal:\s+unknown user/group
unknown user/group:\s+gitlab-\w+
SUCCESS:\s+node\s+is\s+healthy
"grpc\.code":"OK"
"level":"info"
"level":"debug"
"level":"trace"
"severity":"info"
"severity":"debug"
"severity":"INFO"
"severity":"DEBUG"
level=info
level=debug
INFO\s+--
DEBUG\s+--
"status":"completed"
"status":"success"
"state":"finished"
"state":"completed"
completed_at":"\d{4}
succeeded_at":"\d{4}
systemd\[\d+\]:\s+Started\s+
systemd\[\d+\]:\s+Starting\s+
systemd\[\d+\]:\s+Stopped\s+
systemd\[\d+\]:\s+Stopping\s+
\.service:\s+Succeeded
\.service:\s+Deactivated\s+successfully
^\s*#
^\s*$
^-+$
^=+$
^\s*\d+\s+root\s+\d+\s+\d+
^Filesystem\s+Type\s+Size
^Device:\s+rrqm/s
^\w+\.\w+\s*=\s*[\d\w]+$
^[a-z\-]+\.target\s+\w+$
^\s*inet\s+\d+\.\d+\.\d+\.\d+
^total\s+used\s+free
t\.integer.*timeout.*default:
t\.index.*failed.*where:
t\.string.*error.*default:
t\.boolean.*expired.*default:
add_column.*timeout
add_column.*error
add_column.*failed
create_table.*errors
create_table.*failures
remove_column.*error
add_index.*failed
--timeout\s+\d+
--error-.*\s+
--retry\s+\d+
--failed-.*
/bin/.*--.*timeout
/usr/bin/.*--.*error
GET\s+/health
GET\s+/metrics
GET\s+/-/.*health
GET\s+/-/readiness
GET\s+/-/liveness
POST\s+/api/v4/internal/check
Shutting down gracefully
Graceful shutdown
Received TERM signal
Stopping workers
terminate.*administrator command.*gitlab-ctl
will cause.*future versions
deprecated.*will be removed
DEPRECATION WARNING
is deprecated and will
""".strip("\n").split("\n")

WORKER_CLASSES = r"""
"class":"[^"]*(?:Timeout|Error|Failed|Failure|Retry|Dead|Shutdown|Crashed|Exception|Expire|Expired)Worker"
"worker":"[^"]*(?:Timeout|Error|Failed|Failure|Retry|Dead|Shutdown|Crashed|Exception)Worker"
VerificationTimeoutWorker
SyncTimeoutCronWorker
RetryWorker
DeadJobWorker
FailureWorker
ErrorTrackingWorker
ExceptionWorker
ExpireJobCacheWorker
ExpirePipelineCacheWorker
StuckCiJobsWorker
FailedPipelineWorker
TimeoutWorker
CleanupContainerExpirationPolicyWorker
DeleteExpiredJobArtifactsWorker
TimeoutPendingStatusCheckResponsesWorker
TimeoutOrphanedJobArtifactFilesWorker
ExpireBuildArtifactsWorker
Geo::[^"]*(?:Timeout|Verification|Sync|Retry|Failed)(?:Worker|CronWorker)
Ci::[^"]*(?:Timeout|Failed|Retry|Stuck)Worker
ComplianceManagement::[^"]*TimeoutWorker
""".strip("\n").split("\n")

MONITORING = """
grafana-agent prometheus mimir loki tempo otel-collector otelopscol telegraf datadog new-relic elastic-agent fluentbit
fluentd vector filebeat metricbeat heartbeat node-exporter blackbox-exporter alertmanager
""".split()
SCHEMA_FILES = "schema.rb structure.sql ar_schema_dump_result db_schema schema_dump database_structure migrations migrate".split()
SYSTEM_INFO_FILES = """
top_res df_hT iostat sysctl_a ip_address hostname ntpq systemctl_unit_files rpm_verify sar_tcp sar_network sar_memory
sar_cpu netstat ss ip_route iptables ifconfig mount lsblk free vmstat mpstat ps_aux ps_ef lsof ulimit limits.conf ps
nfsstat uptime w who last
""".split()
SYSTEM_INFO_PARTS = "top_ df_ iostat sar_ ps_ ps".split()
CONFIG_FILES = """
sshd_config ssh_config gitlab.rb database.yml resque.yml cable.yml settings.yml secrets.yml unicorn.rb puma.rb nginx.conf
""".split()
CONFIG_SUFFIXES = ".conf .config .cfg .ini .yaml .yml".split()

# components whose patterns apply to a file, by a part of its path
RELEVANCE = {
    "sidekiq": ["Sidekiq", "Rails", "Redis"], "gitaly": ["Praefect/Gitaly", "Git/Shell"], "praefect": ["Praefect/Gitaly"],
    "postgresql": ["PostgreSQL"], "postgres": ["PostgreSQL"], "redis": ["Redis"], "nginx": ["Nginx", "Network"],
    "workhorse": ["Workhorse", "Rails", "Network"], "gitlab-rails": ["Rails", "Auth", "Geo"],
    "puma": ["Puma/Workhorse", "Rails"], "production": ["Rails"], "api_json": ["Rails"], "application": ["Rails"],
    "docker": ["Docker/Containerd"], "containerd": ["Docker/Containerd"],
    "container": ["Docker/Containerd", "Kubernetes/Helm"], "cri-o": ["Docker/Containerd"], "kube": ["Kubernetes/Helm"],
    "k8s": ["Kubernetes/Helm"], "helm": ["Kubernetes/Helm"], "ingress": ["Kubernetes/Helm"], "pod": ["Kubernetes/Helm"],
    "deployment": ["Kubernetes/Helm"],
}
ALWAYS_RELEVANT = ["System/OS", "Network", "Generic", "SSL/Certificates"]

# ---- pattern table -------------------------------------------------------------------------------

# One line per family: component | category; then `id severity priority pattern` rows.
PATTERN_TEXT = r"""
= Praefect/Gitaly | infrastructure
gitaly_no_healthy_node CRITICAL 90 no\s+healthy\s+(?:gitaly\s+)?nodes?
gitaly_primary_lost CRITICAL 90 primary.*(?:unreachable|unavailable)
gitaly_data_loss CRITICAL 95 GRPC::DataLoss|code\s*=\s*DataLoss
gitaly_dial_refused ERROR 80 (?:failed\s+to\s+dial|dialing\s+failed).*connection\s+refused
gitaly_dial_failed ERROR 70 failed\s+to\s+dial(?!.*will\s+retry)
gitaly_unavailable ERROR 75 code\s*=\s*Unavailable|GRPC::Unavailable
gitaly_deadline ERROR 75 (?:context\s+)?deadline\s+exceeded(?!.*retrying)
gitaly_rpc_internal ERROR 70 code\s*=\s*Internal|GRPC::Internal
gitaly_rpc_denied ERROR 70 code\s*=\s*PermissionDenied
gitaly_rpc_exhausted ERROR 70 code\s*=\s*ResourceExhausted
gitaly_rpc_error ERROR 50 rpc\s+error.*desc\s*=
gitaly_replication ERROR 65 replication.*failed
gitaly_voting ERROR 65 voting.*failed
gitaly_health_check ERROR 65 health\s+check.*failed
gitaly_metadata WARNING 40 metadata.*inconsistent
gitaly_failover WARNING 40 failover.*triggered
= Git/Shell | application
git_corrupt_object CRITICAL 90 (?:object|packfile|repository).*corrupt
git_fatal ERROR 70 fatal:\s+(?!unknown\s+user)
git_pack_died ERROR 75 pack-objects.*died
git_hook_declined ERROR 60 (?:pre-receive|update)\s+hook\s+declined
git_remote_hung ERROR 65 remote\s+end\s+hung\s+up
git_missing_repo ERROR 60 repository.*(?:not\s+found|does\s+not\s+exist)
= PostgreSQL | database
postgres_panic CRITICAL 95 PANIC:
postgres_too_many_connections CRITICAL 90 too\s+many\s+(?:connections|clients)
postgres_shared_memory CRITICAL 90 out\s+of\s+shared\s+memory
postgres_disk_full CRITICAL 90 no\s+space\s+left\s+on\s+device
postgres_wal_corrupt CRITICAL 92 invalid\s+(?:page|record|checkpoint)
postgres_connect_refused ERROR 80 could\s+not\s+connect\s+to\s+server.*refused
postgres_connect_failed ERROR 75 could\s+not\s+connect\s+to\s+server
postgres_deadlock ERROR 85 deadlock\s+detected
postgres_lock_timeout ERROR 80 canceling\s+statement\s+due\s+to\s+lock\s+timeout
postgres_statement_timeout ERROR 80 canceling\s+statement\s+due\s+to\s+statement\s+timeout
postgres_recovery_conflict ERROR 75 conflict\s+with\s+recovery
postgres_terminated ERROR 60 terminating\s+connection
postgres_duplicate_key ERROR 60 duplicate\s+key\s+value
postgres_foreign_key ERROR 60 violates\s+foreign\s+key
postgres_not_null ERROR 60 violates\s+not-null
postgres_no_relation ERROR 60 relation.*does\s+not\s+exist
postgres_denied ERROR 60 permission\s+denied\s+for
postgres_auth ERROR 65 password\s+authentication\s+failed
postgres_fatal ERROR 50 \bFATAL:
postgres_error ERROR 40 \bERROR:
postgres_replication_slot WARNING 40 replication\s+slot.*(?:inactive|missing)
postgres_checkpoint WARNING 30 checkpoints\s+are\s+occurring\s+too\s+frequently
= Redis | infrastructure
redis_oom CRITICAL 90 OOM\s+command\s+not\s+allowed
redis_misconf CRITICAL 90 MISCONF
redis_loading ERROR 60 LOADING\s+Redis
redis_readonly ERROR 70 READONLY\s+You\s+can
redis_master_down ERROR 75 master.*(?:down|unreachable)
redis_timeout ERROR 65 redis.*timed?\s*out
redis_refused ERROR 70 redis.*connection\s+refused
redis_noauth ERROR 65 NOAUTH|WRONGPASS
redis_fork WARNING 40 can't\s+save\s+in\s+background
= Sidekiq | jobs
sidekiq_shutdown ERROR 70 Sidekiq::Shutdown
sidekiq_memory ERROR 75 (?:RSS|memory).*exceeded
sidekiq_job_fail ERROR 65 "job_status"\s*:\s*"fail"
sidekiq_dead ERROR 65 (?:dead|exhausted).*retr
sidekiq_error_class ERROR 60 "error_class"\s*:\s*"[^"]+"
sidekiq_error_message ERROR 55 "error_message"\s*:\s*"[^"]+"
sidekiq_deduplicated WARNING 20 job_status.*deferred
= Rails | application
rails_no_memory CRITICAL 90 NoMemoryError
rails_statement ERROR 75 ActiveRecord::StatementInvalid
rails_record_missing ERROR 50 ActiveRecord::RecordNotFound
rails_connection ERROR 75 ActiveRecord::Connection
rails_no_method ERROR 60 NoMethodError
rails_routing ERROR 50 ActionController::RoutingError
rails_exception ERROR 55 "exception\.class"\s*:\s*"[^"]+"
rails_5xx ERROR 50 "status"\s*:\s*5\d\d\b
rails_query_cancelled ERROR 70 PG::QueryCanceled
rails_timeout ERROR 60 Rack::Timeout
= Auth | security
auth_ldap ERROR 60 LDAP.*(?:error|fail)
auth_saml ERROR 60 SAML.*(?:error|invalid)
auth_denied WARNING 40 (?:authentication|authorization).*fail
= Geo | replication
geo_checksum ERROR 70 checksum.*mismatch
geo_sync ERROR 60 sync.*failed
geo_verification ERROR 60 verification.*failed
geo_lag WARNING 40 replication.*lag
= Nginx | web
nginx_no_upstream CRITICAL 85 no\s+live\s+upstreams
nginx_upstream_timeout ERROR 70 upstream\s+timed\s+out
nginx_upstream_refused ERROR 70 connect\(\)\s+failed.*refused
nginx_upstream_closed ERROR 60 upstream\s+prematurely\s+closed
nginx_bad_gateway ERROR 60 502\s+Bad\s+Gateway
= Workhorse | web
workhorse_bad_gateway ERROR 60 badgateway|Bad\s+Gateway
workhorse_canceled WARNING 30 request\s+canceled
= Puma/Workhorse | web
puma_worker_killed ERROR 65 worker.*(?:killed|died|terminated)
puma_backlog WARNING 40 backlog.*full
= Kubernetes/Helm | orchestration
kube_oom_killed CRITICAL 90 OOMKilled
kube_crash_loop CRITICAL 85 CrashLoopBackOff
kube_image_pull ERROR 65 ImagePullBackOff|ErrImagePull
kube_failed_mount ERROR 60 FailedMount
kube_failed_schedule ERROR 60 FailedScheduling
kube_probe ERROR 50 (?:readiness|liveness)\s+probe\s+failed
kube_evicted WARNING 40 \bEvicted\b
kube_helm ERROR 60 helm.*(?:error|failed)
= Docker/Containerd | orchestration
container_daemon ERROR 60 Error\s+response\s+from\s+daemon
container_runtime ERROR 60 (?:runc|containerd).*(?:error|failed)
= SSL/Certificates | security
ssl_expired CRITICAL 85 certificate\s+(?:has\s+)?expired
ssl_verify ERROR 70 certificate\s+verify\s+failed
ssl_unknown_ca ERROR 65 (?:unknown|self[- ]signed)\s+(?:ca|certificate)
ssl_handshake ERROR 60 (?:SSL|TLS).*handshake.*(?:fail|error)
= Network | infrastructure
network_no_route ERROR 60 no\s+route\s+to\s+host
network_unreachable ERROR 60 network\s+is\s+unreachable
network_dns ERROR 60 (?:could\s+not\s+resolve|no\s+such)\s+host
network_refused ERROR 45 connection\s+refused
network_reset ERROR 45 connection\s+reset\s+by\s+peer
network_timed_out ERROR 40 connection\s+timed\s+out
= System/OS | system
system_kernel_panic CRITICAL 99 kernel\s+panic
system_oom CRITICAL 95 oom-killer|Out\s+of\s+memory
system_segfault CRITICAL 90 segfault|segmentation\s+fault
system_io ERROR 75 I/O\s+error
system_filesystem ERROR 75 (?:EXT4-fs|XFS|BTRFS).*error
system_open_files ERROR 65 too\s+many\s+open\s+files
= Generic | generic
generic_java_exception ERROR 35 Exception\s+in\s+thread
generic_python_trace ERROR 35 Traceback\s+\(most\s+recent
generic_go_panic CRITICAL 96 ^panic:
generic_json_fatal ERROR 20 "(?:severity|level)"\s*:\s*"fatal"
generic_json_error ERROR 15 "(?:severity|level)"\s*:\s*"error"
generic_error_word ERROR 5 \b(?:ERROR|FATAL|CRITICAL)\b
"""

PATTERN_SCHEMA = (
    "id string, pattern string, component string, category string, severity string, description string, "
    "multiline boolean, priority int"
)


def pattern_rows() -> list[tuple]:
    rows, component, category = [], "", ""
    for line in PATTERN_TEXT.strip().split("\n"):
        if line.startswith("="):
            component, category = (part.strip() for part in line[1:].split("|"))
            continue
        pid, severity, priority, pattern = line.split(" ", 3)
        rows.append((pid, pattern, component, category, severity, pid.replace("_", " ").capitalize(), False, int(priority)))
    return rows


def error_patterns(spark: SparkSession) -> DataFrame:
    """The pattern table. Add rows with `unionByName`; nothing else has to change."""
    return spark.createDataFrame(pattern_rows(), PATTERN_SCHEMA)


# ---- column functions ----------------------------------------------------------------------------


def alternation(patterns: list[str], flags: str = "(?i)") -> str:
    return flags + "|".join(f"(?:{p})" for p in patterns)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


PLAIN = r"[\w\s\":=/-]+"  # patterns that are just text


def any_word(words, low: str) -> str:
    return "(" + " OR ".join(f"contains({low}, {sql_text(w)})" for w in sorted(words)) + ")"


def found(pattern: str, content: str, low: str) -> str:
    """SQL test for a pattern, without regard to case, in a line whose lower case is `low`.

    A plain word is a substring test. Otherwise the words every match must hold are looked for first, which
    is far cheaper than running the expression. The long rule lists are built as SQL text because that is
    one call into the JVM instead of thousands.
    """
    if re.fullmatch(PLAIN, pattern):
        return f"contains({low}, {sql_text(pattern.lower())})"
    words = required_words(pattern)
    test = f"rlike({content}, {sql_text('(?i)' + pattern)})"
    return test if words is None else f"({any_word(words, low)} AND {test})"


def is_false_positive(content: str = "content", low: str | None = None) -> Column:
    """Known harmless line, or a worker class with an alarming name unless a real error is logged with it."""
    low = low or f"lower({content})"
    # plain words first: they are cheap and settle most lines
    listed = sorted(FALSE_POSITIVES, key=lambda p: not re.fullmatch(PLAIN, p))
    harmless = " OR ".join(found(p, content, low) for p in listed)
    workers = " OR ".join(found(p, content, low) for p in WORKER_CLASSES)
    level = " OR ".join(f"contains({content}, {sql_text(w)})" for w in ('"severity":"ERROR"', '"level":"error"'))
    named = " OR ".join(f"contains({content}, {sql_text(w)})" for w in ('"exception":"', 'error":"'))
    return F.expr(f"{harmless} OR (contains({low}, 'worker') AND ({workers}) AND NOT (({level}) AND ({named})))")


def monitoring_source(content: str = "content") -> Column:
    """Name of the monitoring service a line comes from, or null."""
    low = f"lower({content})"
    whens = " ".join(
        f"WHEN contains({low}, {sql_text(n)}) AND (contains({low}, {sql_text(n + ':')}) OR contains({content}, {sql_text('caller=' + n)})"
        f" OR contains({content}, {sql_text('agent=' + n)})) THEN {sql_text(n)}"
        for n in MONITORING
    )
    return F.expr(f"CASE {whens} END")


def unscannable(path: Column) -> Column:
    """Schema dumps, host outputs and configuration: no errors are looked for in them."""
    name = basename(path)
    low = F.lower(name)
    schema = any_substring(low, SCHEMA_FILES)
    host = name.isin(SYSTEM_INFO_FILES) | any_substring(name, SYSTEM_INFO_PARTS)
    config = name.isin(CONFIG_FILES) | (
        name.rlike("(?:" + "|".join(re.escape(s) for s in CONFIG_SUFFIXES) + ")$") & ~path.contains("/log/")
    )
    return schema | host | config


def scannable_files(files: DataFrame) -> DataFrame:
    """Files left after the excluded ones are taken out."""
    skip = files.where(unscannable(F.col("path"))).select("session_id", "path")
    return files.join(skip, ["session_id", "path"], "left_anti")


def relevant_components(path: Column) -> Column:
    """Pattern components that apply to a file, as an array."""
    p = F.lower(path)
    parts = [
        F.when(p.contains(word), F.array(*[F.lit(c) for c in components])).otherwise(F.array().cast("array<string>"))
        for word, components in RELEVANCE.items()
    ]
    return F.array_distinct(F.concat(F.array(*[F.lit(c) for c in ALWAYS_RELEVANT]), *parts))


def required_words(pattern: str) -> frozenset[str] | None:
    """Words of which every match of the pattern contains at least one; None if there are none of 4+ letters, or if the pattern is
    one that only the JVM reads."""

    def best(sets):
        sets = [s for s in sets if s]
        return max(sets, key=lambda s: min(len(w) for w in s), default=None)

    def of(items):
        sets, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is sre.LITERAL and (chr(arg).isalnum() or chr(arg) in "_:"):
                run += chr(arg).lower()
                continue
            if len(run) >= 4:
                sets.append(frozenset([run]))
            run = ""
            if op is sre.SUBPATTERN:
                sets.append(of(arg[3]))
            elif op is sre.BRANCH:
                branches = [of(b) for b in arg[1]]
                sets.append(frozenset().union(*branches) if all(branches) else None)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                sets.append(of(arg[2]))
        return best(sets)

    try:
        return of(sre_parser.parse(pattern))
    except re.error:
        return None


def gate_words(patterns: list[str]) -> list[str] | None:
    """Few words such that a line matched by any pattern holds one of them; None if some pattern allows no word."""
    needs = [required_words(p) for p in patterns]
    if any(n is None for n in needs):
        return None
    words: list[str] = []
    # sets with one member first; then a word already chosen often serves the rest
    for need in sorted(needs, key=len):
        missing = [w for w in sorted(need) if not any(chosen in w for chosen in words)]
        words += missing
    return [w for w in words if not any(o != w and o in w for o in words)]


def candidate_line(patterns: list[str], content: str = "content", low: str | None = None) -> Column:
    """Cheap gate before the patterns: holds a word some pattern needs."""
    words = gate_words(patterns)
    gate = "true" if words is None else any_word(words, low or f"lower({content})")
    return F.expr(gate)


def first_pattern(patterns: list[tuple[str, str | None]], content: str, low: str, relevant: str, chunk: int = 40) -> Column:
    """Position of the first (pattern, component) that a line matches; the component, if given, must be relevant.

    Each pattern is a literal, so it is compiled once per task; the chain stops at the first hit. Chunks keep
    the generated methods small however many rows the table has.
    """

    def test(pattern, component):
        hit = found(pattern, content, low)
        return hit if component is None else f"array_contains({relevant}, {sql_text(component)}) AND {hit}"

    cases = []
    for start in range(0, len(patterns), chunk):
        whens = " ".join(f"WHEN {test(*row)} THEN {i}" for i, row in enumerate(patterns[start : start + chunk], start))
        cases.append(f"CASE {whens} END")
    return F.expr(f"coalesce({', '.join(cases)})" if len(cases) > 1 else cases[0])
