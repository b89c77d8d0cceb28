"""Event types and the probability that one event caused another."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import field

# ---- fixed values --------------------------------------------------------------------------------

# probability by (component of cause, component of effect); any other pair has DEFAULT_LINK
COMPONENT_LINKS = {
    ("rails", "sidekiq"): 0.9, ("rails", "gitaly"): 0.8, ("rails", "postgresql"): 0.7, ("sidekiq", "gitaly"): 0.9,
    ("sidekiq", "postgresql"): 0.8, ("gitaly", "postgresql"): 0.9, ("workhorse", "gitaly"): 0.9,
    ("workhorse", "rails"): 0.8, ("nginx", "rails"): 0.9, ("nginx", "workhorse"): 0.9,
}
DEFAULT_LINK = 0.1
# probability by (type of cause, type of effect); any other pair has none
TYPE_LINKS = {
    ("request_start", "controller_action"): 0.95, ("controller_action", "job_enqueue"): 0.9,
    ("job_enqueue", "job_start"): 0.95, ("job_start", "rpc_call"): 0.9, ("rpc_call", "query_execute"): 0.9,
    ("query_execute", "query_complete"): 0.95, ("query_error", "rpc_error"): 0.9, ("rpc_error", "job_fail"): 0.9,
    ("job_fail", "error"): 0.85,
}
# probability by the identifier two events share, strongest first
SHARED_IDS = {"job_id": 0.95, "request_id": 0.9, "user_id": 0.3, "project_id": 0.2}
WEIGHTS = {"time": 0.3, "component": 0.3, "type": 0.2, "shared": 0.2}
DECAY_S = 30.0
# component pairs whose neighbouring events are causal within 60 s
CAUSAL_CHAINS = [
    ("rails", "sidekiq"), ("rails", "gitaly"), ("sidekiq", "gitaly"), ("sidekiq", "postgresql"), ("gitaly", "postgresql"),
    ("workhorse", "gitaly"), ("workhorse", "rails"),
]
CHAIN_MS = 60_000
HORIZON_MS = 300_000
MIN_CONFIDENCE = 0.5

# ---- as columns ----------------------------------------------------------------------------------


def _lookup(a: Column, b: Column, table: dict, default: float) -> Column:
    out = None
    for (x, y), p in table.items():
        test = (a == x) & (b == y)
        out = F.when(test, p) if out is None else out.when(test, p)
    return out.otherwise(default)


def _same(a: str, b: str, name: str) -> Column:
    x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def shared_id(a: str, b: str) -> Column:
    out = None
    for name, p in SHARED_IDS.items():
        test = _same(a, b, name)
        out = F.when(test, p) if out is None else out.when(test, p)
    return out.otherwise(0.0)


def causality(a: str, b: str) -> Column:
    """Probability that row `a` caused row `b` (aliases): closeness in time, components, types, shared ids.

    0 when b comes first or more than five minutes later.
    """
    dt = F.col(f"{b}.t_ms") - F.col(f"{a}.t_ms")
    p = (
        F.exp(-(dt / 1000.0) / DECAY_S) * WEIGHTS["time"]
        + _lookup(F.col(f"{a}.component"), F.col(f"{b}.component"), COMPONENT_LINKS, DEFAULT_LINK) * WEIGHTS["component"]
        + _lookup(F.col(f"{a}.event_type"), F.col(f"{b}.event_type"), TYPE_LINKS, 0.0) * WEIGHTS["type"]
        + shared_id(a, b) * WEIGHTS["shared"]
    )
    return F.when((dt < 0) | (dt > HORIZON_MS), 0.0).otherwise(F.least(p, F.lit(1.0)))


def is_causal(a: str, b: str) -> Column:
    """Whether two neighbouring events are causal: a known component chain within a minute, or a shared job or request."""
    dt = F.col(f"{b}.t_ms") - F.col(f"{a}.t_ms")
    chain = None
    for x, y in CAUSAL_CHAINS:
        test = (F.col(f"{a}.component") == x) & (F.col(f"{b}.component") == y)
        chain = test if chain is None else chain | test
    near = F.coalesce((dt >= 0) & (dt <= CHAIN_MS), F.lit(False))
    return (chain & near) | _same(a, b, "job_id") | _same(a, b, "request_id")


# ---- the same in plain Python, for the per-id recurrences --------------------------------------------


def causal_pair(a: tuple, b: tuple) -> bool:
    """`is_causal` for (component, t_ms, job_id, request_id) tuples."""
    if (a[0], b[0]) in CAUSAL_CHAINS and a[1] is not None and b[1] is not None and 0 <= b[1] - a[1] <= CHAIN_MS:
        return True
    return bool((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]))


@lru_cache(maxsize=None)
def reach_ms(ca: str, ta: str, cb: str, tb: str, shared: str | None) -> int:
    """Largest delay in ms at which an event of the first kind still causes one of the second; -1 for never.

    Probability falls with the delay, so this one number replaces the test of every pair.
    """
    rest = (
        COMPONENT_LINKS.get((ca, cb), DEFAULT_LINK) * WEIGHTS["component"]
        + TYPE_LINKS.get((ta, tb), 0.0) * WEIGHTS["type"]
        + SHARED_IDS.get(shared, 0.0) * WEIGHTS["shared"]
    )

    def holds(ms: int) -> bool:
        return math.exp(-(ms / 1000.0) / DECAY_S) * WEIGHTS["time"] + rest > MIN_CONFIDENCE

    if not holds(0):
        return -1
    low, high = 0, HORIZON_MS
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if holds(mid) else (low, mid - 1)
    return low


# ---- event types -----------------------------------------------------------------------------------


def classify_event(component: Column, severity: Column, message: Column, fields: Column | str | None = None) -> Column:
    """Event type of a line, by its component, message and fields."""
    m = F.lower(message)
    none = F.lit(None).cast("string")
    get = (lambda name: field(name, fields)) if fields is not None else (lambda name: none)
    job, code, method = get("job_status"), get("grpc.code"), get("grpc.method")
    bad = severity.isin("ERROR", "FATAL", "CRITICAL")
    bad2 = severity.isin("ERROR", "FATAL")
    rails = (
        F.when(m.contains("started") & m.rlike("get|post|put|delete|patch"), "request_start")
        .when(m.contains("completed") & m.contains("status"), "request_end")
        .when(m.contains("processing by"), "controller_action").when(bad, "error")
    )
    sidekiq = (
        F.when(job == "start", "job_start").when(job == "done", "job_end").when(job == "fail", "job_fail")
        .when(m.contains("enqueue"), "job_enqueue").when(bad2, "error")
    )
    gitaly = F.when(code == "OK", "rpc_success").when(code != "", "rpc_error").when(method != "", "rpc_call").when(bad2, "error")
    postgresql = (
        F.when(m.rlike("execute|statement"), "query_execute").when(m.contains("duration"), "query_complete")
        .when(m.contains("error") | (severity == "ERROR"), "query_error")
    )
    own = (
        F.when(component == "rails", rails).when(component == "sidekiq", sidekiq).when(component == "gitaly", gitaly)
        .when(component == "postgresql", postgresql)
    )
    return F.coalesce(own, F.when(bad, "error").when(severity == "WARNING", "warning").otherwise("generic"))


def event_details(message: Column) -> Column:
    """Struct (http_method, http_status, controller, action, logged_ms) found in a message."""
    m = F.lower(message)
    verb = F.coalesce(*[F.when(m.contains(v.lower()), v) for v in ("GET", "POST", "PUT", "DELETE", "PATCH")])
    by = r"(?i)processing by ([^#]+)#(\w+)"
    none_if_empty = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        F.when(m.contains("started"), verb).alias("http_method"),
        F.regexp_extract(m, r"status[:\s]+(\d{3})", 1).try_cast("int").alias("http_status"),
        none_if_empty(F.regexp_extract(message, by, 1)).alias("controller"),
        none_if_empty(F.regexp_extract(message, by, 2)).alias("action"),
        F.regexp_extract(m, r"duration[:\s]+([\d.]+)\s*ms", 1).try_cast("double").alias("logged_ms"),
    )


def component_or_guess(component: Column, message: Column, fields: Column | str = "fields") -> Column:
    """Component of an event; an unknown one is guessed from its fields, then from words of the message."""
    m = F.lower(message)
    has = lambda *names: F.coalesce(*[field(n, fields) for n in names]).isNotNull()
    guess = (
        F.when(has("component"), field("component", fields)).when(has("class", "jid"), "sidekiq")
        .when(has("grpc.method", "grpc.service"), "gitaly").when(has("controller", "action"), "rails")
        .when(m.rlike("sidekiq|worker"), "sidekiq").when(m.rlike("gitaly|grpc"), "gitaly").when(m.contains("sql"), "postgresql")
        .when(m.contains("postgres"), "postgresql").when(m.contains("redis"), "redis").when(m.contains("nginx"), "nginx")
        .when(m.rlike("controller|action"), "rails").otherwise("unknown")
    )
    return F.when(F.coalesce(component, F.lit("unknown")) == "unknown", guess).otherwise(component)
