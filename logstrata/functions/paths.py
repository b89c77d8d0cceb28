"""What a path says about a file: service, component, log type, file type, node."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: names as they occur in collected bundles ------------------------------------------

# service by first word of `<word>_<container>.log`
CONTAINER_LOGS = {
    "webservice": "webservice", "sidekiq": "sidekiq", "gitaly": "gitaly", "migrations": "migrations",
    "toolbox": "toolbox", "kas": "kas", "registry": "registry", "gitlab-shell": "shell",
    "gitlab-exporter": "exporter", "gitlab-runner": "runner", "artifactory": "artifactory", "minio": "minio",
    "xray": "xray", "grafana-agent": "monitoring", "toolchain-api": "toolchain",
}
APPLICATION_LOGS = """
production_json.log production.log api_json.log application_json.log application.log integrations_json.log
kubernetes.log git_json.log audit_json.log importer.log exporter.log features_json.log ci_resource_groups_json.log
auth.log auth_json.log graphql_json.log migrations.log web_hooks.log elasticsearch.log exceptions_json.log
service_measurement.log geo.log update_mirror_service_json.log llm.log database_load_balancing.log clickhouse.log
zoekt.log repocheck.log sidekiq_client.log epic_work_item_sync.log secret_push_protection.log active_context.log
performance_bar_json.log backup_json.log product_usage_data.log
""".split()
WEB_LOGS = """
gitlab_access.log gitlab_error.log gitlab_pages_access.log gitlab_pages_error.log gitlab_registry_access.log
gitlab_registry_error.log
""".split()
SYSTEM_LOGS = ["syslog", "messages", "dmesg", "mail.log"]
HOST_FILES = """
gitlab_status gitlab_geo_status gitlab_migrations version-manifest.txt version-manifest.json gitlabsos.log
schema_dump_result ar_schema_dump_result ps top_cpu top_res df_ht free_m meminfo cpuinfo mount uptime date hostname
uname lscpu lsblk netstat ifconfig ip_address iostat iotop mpstat pidstat vmstat sar_dev sar_tcp sockstat nfsstat
nfsiostat ulimit sysctl_a dmesg systemctl_unit_files systemd_detect_virt getenforce sestatus fstab os-release
limits.conf sshd_config config pressure_cpu.txt pressure_io.txt pressure_mem.txt gitlab_geo_migrations
gitlab_system_status ntpq timedatectl user_uid collation_diagnostics btmp_size license_info rpm_verify gitaly_check
gitaly_internal_api_check zoekt_info taggings_duplicates gitlab_geo_check elastic_info non_analyzed_tables
running_swappiness tainted p_ci_build_tags_duplicates df_inodes
""".split()
# service by a directory of the path, in order
SERVICE_DIRECTORIES = [
    ("/registry/", "registry"), ("/gitlab-pages/", "pages"), ("/postgresql/", "postgresql"), ("/postgres/", "postgresql"),
    ("/redis/", "redis"), ("/prometheus/", "prometheus"), ("/alertmanager/", "alertmanager"), ("/grafana/", "grafana"),
    ("/mailroom/", "mailroom"), ("/patroni/", "patroni"), ("/pgbouncer/", "pgbouncer"), ("/praefect/", "praefect"),
    ("/gitlab-kas/", "kas"), ("/sentinel/", "sentinel"), ("/lets-encrypt/", "letsencrypt"),
    ("/mattermost/", "mattermost"), ("/gitlab-exporter/", "gitlab-exporter"), ("/logrotate/", "logrotate"),
    ("/crond/", "crond"),
]
# directories that name the service of a file called `current`
CURRENT_PARENTS = """
sidekiq gitaly workhorse redis postgresql nginx registry prometheus alertmanager grafana gitlab-shell gitlab-pages
gitlab-kas praefect patroni pgbouncer sentinel mailroom mattermost gitlab-exporter logrotate crond
""".split()
KUBE_FILES = """
events all_events describe_pods describe_nodes describe_deployments get_pods get_services get_endpoints top_pods
top_nodes describe_pv describe_pvc
""".split()
# component by a substring of the path, in order
COMPONENT_WORDS = [
    ("gitlab-rails", "rails"), ("gitlab-workhorse", "workhorse"), ("gitlab-exporter", "rails"), ("sidekiq", "sidekiq"),
    ("gitaly", "gitaly"), ("praefect", "praefect"), ("postgresql", "postgresql"), ("postgres", "postgresql"),
    ("patroni", "postgresql"), ("pgbouncer", "postgresql"), ("redis-sentinel", "redis"), ("redis", "redis"),
    ("nginx", "nginx"), ("puma", "rails"), ("unicorn", "rails"), ("workhorse", "workhorse"), ("registry", "registry"),
    ("consul", "consul"), ("geo", "geo"), ("pages", "pages"), ("rails", "rails"),
]
# directories that name the service of a file called `current` or `state`
CATALOG_PARENTS = [
    (["sidekiq", "gitlab-sidekiq"], "sidekiq"), (["postgresql", "postgres"], "postgresql"),
    (["redis", "gitlab-redis"], "redis"), (["puma", "gitlab-puma"], "puma"),
    (["gitlab-workhorse", "workhorse"], "gitlab-workhorse"), (["registry", "gitlab-registry"], "registry"),
    (["gitaly", "gitlab-gitaly"], "gitaly"), (["gitlab-shell"], "gitlab-shell"), (["nginx", "gitlab-nginx"], "nginx"),
    (["node-exporter", "gitlab-node-exporter"], "node-exporter"),
    (["postgres-exporter", "gitlab-postgres-exporter"], "postgres-exporter"),
    (["redis-exporter", "gitlab-redis-exporter"], "redis-exporter"),
    (["pgbouncer-exporter", "gitlab-pgbouncer-exporter"], "pgbouncer-exporter"),
    (["logrotate", "gitlab-logrotate"], "logrotate"), (["prometheus", "gitlab-prometheus"], "prometheus"),
    (["grafana", "gitlab-grafana"], "grafana"), (["alertmanager", "gitlab-alertmanager"], "alertmanager"),
]
# catalogue service by a part of the file name, in order
CATALOG_NAMES = [
    ("gitlab-rails", """production_json.log production.log api_json.log application_json.log exceptions_json.log
        auth_json.log audit_json.log backup_json.log graphql_json.log integrations_json.log web_hooks.log
        sidekiq_client.log database_health_status.log database_load_balancing.log elasticsearch.log
        event_collection.log product_usage_data.log gitlab-rails-db-migrate"""),
    ("sidekiq", "sidekiq"), ("gitaly", "gitaly"), ("gitlab-shell", "gitlab-shell gitlab_shell"),
    ("nginx", "nginx access.log error.log gitlab_access.log gitlab_error.log puma_stderr.log puma_stdout.log"),
    ("postgresql", "postgresql postgres"), ("redis", "redis"),
    ("system", "messages syslog auth.log secure mail.log dmesg"),
    ("system", """cpuinfo meminfo mount fstab os-release limits.conf sshd_config df_ free_ iostat vmstat mpstat netstat
        ifconfig ip_address hostname uname uptime lscpu lsblk ps top_ sar_ pidstat sockstat ulimit sysctl systemctl
        systemd timedatectl getenforce sestatus btmp_size user_uid date iotop ntpq nfsstat nfsiostat tainted swappiness
        pressure_"""),
    ("gitlab-config", "gitlab_status gitlab_system_status gitaly_check gitaly_internal_api_check gitlab.rb gitlabsos.log"),
    ("database", "schema_dump ar_schema_dump gitlab_migrations non_analyzed_tables"), ("search", "elastic_info zoekt_info"),
    ("license", "license_info"), ("version", "version-manifest manifest"),
    ("config", ".conf .config .yml .yaml .rb"), ("package-management", "rpm_verify"),
]
NODE_WORDS = """
praefect gitaly postgresql postgres redis sidekiq workhorse nginx puma gitlab-rails gitlab-shell registry pages kas
""".split()
SUITABLE = """
gitlab-rails/production_json.log gitlab-rails/production.log gitlab-rails/api_json.log
gitlab-rails/application_json.log gitlab-rails/exceptions_json.log gitlab-rails/auth.log sidekiq/current sidekiq/*.log
gitaly/current gitaly/*.log gitlab-workhorse/current gitlab-workhorse/*.log gitlab-shell/gitlab-shell.log
gitlab-pages/*.log registry/*.log nginx/gitlab_access.log nginx/gitlab_error.log nginx/error.log nginx/access.log
postgresql/*.log redis/*.log patroni/*.log messages syslog auth.log secure containers/*.log docker/*.log
kubernetes/*.log
""".split()
STATIC = """
proc/* etc/* *.conf *.config *.yml *.yaml *_dump *_info *_check *_status df_* ps_* iostat* netstat* lsof* uname* dmesg*
migrations schema
""".split()
LOG_PARENTS = """
sidekiq gitaly praefect postgresql postgres redis nginx consul patroni gitlab-rails gitlab-workhorse registry puma
gitlab-exporter logrotate reconfigure unicorn
""".split()
LOG_DIRECTORIES = "gitlab-rails gitlab-workhorse sidekiq gitaly praefect postgresql nginx redis puma".split()
LOG_NAMES = "current messages syslog access error debug info warn warning stderr stdout".split()

# log types: name, format, globs below any directory, component, message fields, key fields
LOG_TYPES = [
    ("Rails Production", "plain", "gitlab-rails/production.log*", "rails", "", ""),
    ("Rails Production JSON", "json", "gitlab-rails/production_json.log*", "rails", "message", "controller action status method path"),
    ("Rails API JSON", "json", "gitlab-rails/api_json.log*", "rails", "message", "method path status"),
    ("Rails Application", "plain", "gitlab-rails/application.log*", "rails", "", ""),
    ("Rails Application JSON", "json", "gitlab-rails/application_json.log*", "rails", "message", ""),
    ("Rails Auth", "plain", "gitlab-rails/auth.log*", "rails", "", ""),
    ("Rails Auth JSON", "json", "gitlab-rails/auth_json.log*", "rails", "message", ""),
    ("Rails Integrations", "json", "gitlab-rails/integrations_json.log*", "rails", "message", ""),
    ("Rails GraphQL", "json", "gitlab-rails/graphql_json.log*", "rails", "message", ""),
    ("Rails Exceptions", "json", "gitlab-rails/exceptions_json.log*", "rails", "exception.message message", ""),
    ("Rails Audit", "json", "gitlab-rails/audit_json.log*", "rails", "message", ""),
    ("Geo Replication", "json", "gitlab-rails/geo.log*", "geo", "message exception.message", ""),
    ("Rails LLM", "json", "gitlab-rails/llm.log*", "rails", "message", ""),
    ("Rails Migrations", "plain", "gitlab-rails/migrations.log*", "rails", "", ""),
    ("Rails Mail Room", "json", "gitlab-rails/mail_room_json.log*", "rails", "message", ""),
    ("Rails Web Hooks", "plain", "gitlab-rails/web_hooks.log*", "rails", "", ""),
    ("Rails ClickHouse", "plain", "gitlab-rails/clickhouse.log*", "rails", "", ""),
    ("Sidekiq Main", "plain", "sidekiq.log*", "sidekiq", "", ""),
    ("Sidekiq Current", "json", "sidekiq/current sidekiq/current.*.log", "sidekiq", "message exception.message", "class queue job_status jid"),
    ("Sidekiq Exporter", "plain", "sidekiq_exporter.log*", "sidekiq", "", ""),
    ("Cron Jobs", "plain", "cron.log*", "sidekiq", "", ""),
    ("Gitaly Main", "json", "gitaly/current gitaly/current.*.log", "gitaly", "msg message error", "grpc.method grpc.service grpc.code"),
    ("Gitaly Log", "plain", "gitaly.log*", "gitaly", "", ""),
    ("Praefect Main", "json", "praefect/current praefect/current.*.log", "praefect", "msg message error", "grpc.method grpc.service grpc.code"),
    ("GitLab Workhorse", "json", "gitlab-workhorse.log*", "workhorse", "message msg", ""),
    ("GitLab Shell", "plain", "gitlab-shell.log*", "shell", "", ""),
    ("GitLab KAS", "json", "gitlab-kas.log*", "kas", "message msg", ""),
    ("GitLab Pages", "plain", "gitlab-pages.log*", "pages", "", ""),
    ("GitLab Pages Daemon", "plain", "gitlab-pages-daemon.log*", "pages", "", ""),
    ("Registry", "json", "registry.log*", "registry", "message msg", ""),
    ("PostgreSQL", "syslog", "postgresql/current postgresql/postgresql.log*", "postgresql", "", ""),
    ("PostgreSQL Log", "plain", "postgresql.log*", "postgresql", "", ""),
    ("Patroni", "plain", "patroni.log*", "postgresql", "", ""),
    ("Redis", "syslog", "redis.log* redis/current redis/*.log", "redis", "", ""),
    ("Puma", "plain", "puma.log*", "rails", "", ""),
    ("Puma Stderr", "plain", "puma_stderr.log*", "rails", "", ""),
    ("Puma Stdout", "plain", "puma_stdout.log*", "rails", "", ""),
    ("NGINX Access", "nginx", "nginx-access.log* nginx/access.log*", "nginx", "", ""),
    ("NGINX Errors", "nginx", "nginx-error.log* nginx/error.log* nginx/gitlab_error.log*", "nginx", "", ""),
    ("DB Migrations", "plain", "gitlab-rails-db-migrate*.log", "rails", "", ""),
]

# ---- helpers ---------------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def any_substring(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def suffix(name: Column) -> Column:
    """Extension with its dot; a leading dot is not an extension."""
    return F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)


def ordered(rules: list[tuple[Column, str | Column]], otherwise) -> Column:
    """First rule that holds."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def glob_regex(glob: str) -> str:
    """A glob below any directory: `*` stays within one path part."""
    return r"(?:^|/)" + re.escape(glob).replace(r"\*", "[^/]*") + "$"


# ---- services and components -----------------------------------------------------------------------


def service_of(path: Column, flavour: str = "search") -> Column:
    """Service of a file. `catalog` gives the coarser catalogue names (config, database, license ...)."""
    return _catalog_service(path) if flavour == "catalog" else _search_service(path)


def _search_service(path: Column) -> Column:
    p = F.lower(path)
    name = basename(p)
    word = F.substring_index(name, "_", 1)
    container = F.coalesce(*[F.when(word == k, v) for k, v in CONTAINER_LOGS.items()])
    is_container = name.contains("_") & name.endswith(".log") & container.isNotNull()
    dirs = F.filter(F.split(p, "/"), lambda part: part.isin(CURRENT_PARENTS))
    nearest = F.get(dirs, F.size(dirs) - 1)
    rules = [
        (is_container, container),
        (name.isin(KUBE_FILES), "kubernetes"),
        (name.isin(APPLICATION_LOGS), "rails"),
        (p.contains("gitlab-shell"), "shell"),
        (p.contains("/gitaly/") | (name == "gitaly_hooks.log"), "gitaly"),
        (p.contains("workhorse"), "workhorse"),
        (name.isin("puma_stdout.log", "puma_stderr.log") | p.contains("/puma/"), "puma"),
        ((p.contains("/sidekiq/") & (name == "current")) | (name == "sidekiq.log"), "sidekiq"),
        (p.contains("/nginx/") | name.isin(WEB_LOGS), "nginx"),
        (p.contains("/registry/"), "registry"),
        (p.contains("/gitlab-pages/") | name.contains("pages"), "pages"),
    ]
    rules += [
        ((p.contains(d) | name.contains("mail_room_json.log")) if s == "mailroom" else p.contains(d), s)
        for d, s in SERVICE_DIRECTORIES if s not in ("registry", "pages")
    ]
    rules += [
        (name.isin(SYSTEM_LOGS), "system"),
        (p.contains("/reconfigure/"), "reconfigure"),
        (name.isin(HOST_FILES), "sos-metadata"),
        (name == "current", F.coalesce(F.replace(nearest, F.lit("gitlab-"), F.lit("")), F.lit("system"))),
    ]
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").otherwise(ordered(rules, "unknown"))


def _catalog_service(path: Column) -> Column:
    p = F.lower(path)
    name = basename(p)
    known = {d: s for directories, s in CATALOG_PARENTS for d in directories}
    dirs = F.filter(F.split(p, "/"), lambda x: x.isin(list(known)))
    nearest = F.get(dirs, F.size(dirs) - 1)
    parent = F.coalesce(*[F.when(nearest == d, s) for d, s in known.items()], F.lit("logs"))
    rules = [(name.isin("current", "state"), parent)]
    for service, words in CATALOG_NAMES:
        test = any_substring(name, words.split())
        rules.append((test & ~name.contains("client") if service == "sidekiq" else test, service))
    return ordered(rules, "other")


def component_of(path: Column) -> Column:
    """Component of a log file, from the most specific word of its path."""
    p = F.lower(path)
    name = basename(p)
    first_dir = F.regexp_extract(p, r"/var/log/([^/]+)/", 1)
    below = F.when(first_dir == "gitlab", "rails").when(first_dir.isin("postgresql", "postgres"), "postgresql").when(
        first_dir.isin("nginx", "redis"), first_dir
    ).otherwise("system")
    rules = [(p.contains(word), component) for word, component in COMPONENT_WORDS]
    rules += [
        (name.contains("production") & name.contains("json"), "rails"),
        (name.contains("exception") | name.contains("api"), "rails"),
        (any_substring(p, ["/var/log/messages", "/var/log/syslog", "/var/log/mail", "dmesg", "cadvisor", "falcon-sensor", "sssd"]), "system"),
        (p.contains("/var/log/"), below),
    ]
    return ordered(rules, "unknown")


def node_of(path: Column) -> Column:
    p = F.lower(path)
    return ordered([(p.contains(w), w) for w in NODE_WORDS], "unknown")


# ---- log types ---------------------------------------------------------------------------------------


def log_types(spark: SparkSession) -> DataFrame:
    """The log type registry as a table; the row order is the match order."""
    rows = [
        (rank, name, fmt, "|".join(glob_regex(g) for g in globs.split()), component, messages.split(), keys.split())
        for rank, (name, fmt, globs, component, messages, keys) in enumerate(LOG_TYPES)
    ]
    return spark.createDataFrame(
        rows,
        "rank int, log_type string, format string, pattern string, type_component string, "
        "message_fields array<string>, key_fields array<string>",
    )


def log_type_of(path: Column) -> Column:
    """Struct (log_type, format, component, message_fields, key_fields) of a path; null when no type matches."""
    p = F.lower(path)

    def info(name, fmt, component, messages, keys):
        return F.struct(
            F.lit(name).alias("log_type"), F.lit(fmt).alias("format"), F.lit(component).alias("component"),
            F.array(*[F.lit(m) for m in messages.split()]).cast("array<string>").alias("message_fields"),
            F.array(*[F.lit(k) for k in keys.split()]).cast("array<string>").alias("key_fields"),
        )

    rules = [
        (p.rlike("|".join(glob_regex(g) for g in globs.split())), info(name, fmt, component, messages, keys))
        for name, fmt, globs, component, messages, keys in LOG_TYPES
    ]
    return ordered(rules, F.lit(None))


# ---- kinds of files ----------------------------------------------------------------------------------


def file_type(path: Column) -> Column:
    p = F.lower(path)
    name = basename(p)
    ext = suffix(name)
    return ordered(
        [
            (ext.isin(".conf", ".config", ".yml", ".yaml", ".rb"), "config"),
            (any_substring(name, ["_dump", "_info", "_check", "_status", "iostat", "df_", "ps_"]), "command_output"),
            (p.contains("/proc/"), "proc"),
            (name.contains("json") & name.contains(".log"), "json_log"),
            (ext.isin(".log", ".txt") | name.isin("current", "messages", "syslog"), "log"),
        ],
        "other",
    )


def _patterns(globs: list[str]) -> str:
    return "|".join(g.replace("*", ".*") for g in globs)


def suitable(path: Column) -> Column:
    """Whether a file goes into the analysis: an expected log, and not a static file.

    A dot in these patterns stands for any character.
    """
    p = F.lower(path)
    return p.rlike(_patterns(SUITABLE)) & ~p.rlike(_patterns(STATIC))


def is_log_file(path: Column) -> Column:
    p = F.lower(path)
    name = basename(p)
    ext = suffix(name)
    plain = ext.isin("", ".log", ".txt", ".json")
    return (
        (p.contains("/var/log/") & ~ext.isin(".gz", ".bz2", ".xz", ".zip", ".tar"))
        | ext.isin(".log", ".txt", ".json")
        | name.contains("log")
        | name.isin(LOG_NAMES)
        | (parent_name(p).isin(LOG_PARENTS) & plain)
        | (F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(d) for d in LOG_DIRECTORIES])) & plain)
    )
