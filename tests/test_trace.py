import random

import pytest
from pyspark.sql import functions as F

from logstrata.functions.causality import (
    COMPONENT_LINKS, DECAY_S, DEFAULT_LINK, HORIZON_MS, SHARED_IDS, TYPE_LINKS, causal_pair, reach_ms,
)
from logstrata.operators import trace

COMPONENTS = ["rails", "sidekiq", "gitaly", "postgresql", "workhorse", "nginx", "redis"]
TYPES = ["request_start", "controller_action", "job_enqueue", "job_start", "rpc_call", "query_execute", "query_error", "rpc_error", "generic"]


def make(seed, n_hot=160, n_ids=25):
    import math  # noqa: F401

    rng = random.Random(seed)
    rows = []

    def event(cid, i, t):
        pick = lambda xs: rng.choice(xs)
        rows.append((cid, f"{cid}:{i:04d}", t, pick(COMPONENTS), pick(TYPES), pick(["INFO", "ERROR", "WARNING"]), "m",
                     pick([None, "j1", "j2"]), pick([None, None, "r1"]), pick(["u1", "u2", None]), pick(["p1", None]), float(rng.randint(0, 900))))

    t = 0
    for i in range(n_hot):
        t += rng.choice([0, 100, 1500, 4000, 20000])
        event("hot", i, t)
    for k in range(n_ids):
        t = 0
        for i in range(rng.randint(1, 8)):
            t += rng.choice([0, 900, 60_000, 60_001, 200_000, 300_000, 301_000])
            event(f"id{k:02d}", i, t)
    return rows


SCHEMA = "correlation_id string, event_key string, t_ms bigint, component string, event_type string, severity string, message string, job_id string, request_id string, user_id string, project_id string, dur_ms double"


def by_id(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def confidence(a, b):
    import math

    dt = b[2] - a[2]
    if dt < 0 or dt > HORIZON_MS:
        return 0.0
    shared = next((p for i, p in zip((7, 8, 9, 10), SHARED_IDS.values()) if a[i] and a[i] == b[i]), 0.0)
    return min(1.0, math.exp(-dt / 1000 / DECAY_S) * 0.3 + COMPONENT_LINKS.get((a[3], b[3]), DEFAULT_LINK) * 0.3 + TYPE_LINKS.get((a[4], b[4]), 0.0) * 0.2 + shared * 0.2)


def edges_of(events):
    return {(a[1], b[1]): confidence(a, b) for i, a in enumerate(events) for b in events[i + 1:] if confidence(a, b) > 0.5}


@pytest.mark.parametrize("busy", [2000, 3])
def test_edges(spark, busy):
    rows = make(1)
    expected = {}
    for events in by_id(rows).values():
        expected.update(edges_of(events))
    got = trace.causal_edges(spark.createDataFrame(rows, SCHEMA), busy=busy).collect()
    assert len(got) == len({(r.src, r.dst) for r in got})
    assert {(r.src, r.dst) for r in got} == set(expected)
    assert all(abs(expected[(r.src, r.dst)] - r.confidence) < 1e-9 for r in got)


def test_reach():
    assert reach_ms("redis", "x", "redis", "x", None) == -1
    assert reach_ms("sidekiq", "job_start", "gitaly", "rpc_call", "job_id") == HORIZON_MS


@pytest.mark.parametrize("pieces", [1, 6, 40])
def test_clocks(spark, pieces):
    rows = make(2)
    expected = {}
    for events in by_id(rows).values():
        clocks, prev = {}, None
        for e in events:
            small = (e[3], e[2], e[7], e[8])
            clock = clocks.get(e[3], 0) + 1
            if prev is not None and causal_pair(prev[0], small):
                clock = max(clock, prev[1]) + 1
            clocks[e[3]] = expected[e[1]] = clock
            prev = (small, clock)
    got = trace.causal_rank(trace.lamport(spark.createDataFrame(rows, SCHEMA).repartition(5), pieces)).collect()
    assert {r.event_key: r.lamport for r in got} == expected
    for cid, events in by_id(rows).items():
        order = sorted(events, key=lambda e: (expected[e[1]], e[2], e[1]))
        ranks = {r.event_key: r.causal_rank for r in got if r.correlation_id == cid}
        assert [ranks[e[1]] for e in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("segment", [100_000, 23])
def test_critical_path(spark, segment):
    rows = make(3)
    expected = {}
    for events in by_id(rows).values():
        edges = edges_of(events)
        early, late, depth = {}, {}, {}
        for e in events:
            causes = [c for c in events if (c[1], e[1]) in edges]
            early[e[1]] = max((early[c[1]] + c[11] for c in causes), default=0.0)
            depth[e[1]] = max((depth[c[1]] + 1 for c in causes), default=0)
        for e in reversed(events):
            effects = [c for c in events if (e[1], c[1]) in edges]
            late[e[1]] = min((late[c[1]] for c in effects), default=None)
            late[e[1]] = early[e[1]] if late[e[1]] is None else late[e[1]] - e[11]
        for e in events:
            expected[e[1]] = (early[e[1]], late[e[1]], depth[e[1]], abs(late[e[1]] - early[e[1]]) < 0.001)
    got = trace.critical_path(spark.createDataFrame(rows, SCHEMA), segment=segment)
    assert {r.event_key: (r.earliest_start, r.latest_start, r.depth, r.is_critical) for r in got.collect()} == expected
    positions = trace.topological_order(got).collect()
    place = {r.event_key: r.position for r in positions}
    for events in by_id(rows).values():
        assert all(place[a] < place[b] for a, b in edges_of(events))


def test_gaps_and_nulls(spark):
    rows = [("a", "a1", 0, "rails"), ("a", "a2", 60_000, "rails"), ("b", "b1", 0, "rails"), ("b", "b2", 60_001, "rails"), ("c", "c1", None, "rails"), ("c", "c2", 5, "rails")]
    df = trace.conform(spark.createDataFrame(rows, "correlation_id string, event_key string, t_ms bigint, component string"))
    got = {r.correlation_id: r.has_gap for r in trace.has_gap(df).collect()}
    assert got == {"a": False, "b": True, "c": False}
    clocks = {r.event_key: r.lamport for r in trace.lamport(df).collect()}
    assert (clocks["c2"], clocks["c1"]) == (1, 2)  # a missing time sorts last
    assert trace.critical_path(df).where("event_key = 'c1'").count() == 0


def test_chain_rollup(spark):
    rows = [("x", "1", 0, "rails", "request_start", "INFO"), ("x", "2", 10, "gitaly", "rpc_error", "ERROR"), ("x", "3", 20, "rails", "request_end", "INFO")]
    df = spark.createDataFrame(rows, "correlation_id string, event_key string, t_ms bigint, component string, event_type string, severity string")
    r = trace.trace_chains(df).first()
    assert (r.is_complete, r.failure_point, r.root_cause, r.error_count, r.total_ms) == (True, "2", "2", 1, 20)


def test_islands_against_brute_force(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for ident in ("hot", "b"):
        t, island = 0, 0
        for k in range(400 if ident == "hot" else 20):
            step = rng.choice([0, 1000, 299_999, 300_000, 300_001, 900_000]) if k else 0
            island += step > 300_000
            t += step
            rows.append((ident, f"{ident}{k}", t))
            want[f"{ident}{k}"] = island
    frame = spark.createDataFrame(rows, "correlation_id string, event_key string, t_ms bigint").repartition(5)
    assert {r.event_key: r._island for r in trace.with_islands(frame).collect()} == want and want["hot399"] > 50


def test_window_forgets_old_classes():
    window = trace._Window()
    for k in range(10_000):
        window.add(("rails", "x", "job_id", f"j{k}"), 1000 * k, float(k))
        assert len(window.lists) <= 302
    assert window.best(("rails", "x", "job_id", "j9999"), 0) == 9999.0 and window.best(("rails", "x", "job_id", "j5"), 0) is None


@pytest.mark.parametrize("whole", [10_000, 12, 0])
def test_chains_of_long_and_short_ids(spark, whole):
    """Ids that one task traces and ids that are cut have the same chains, also with null times, and none is left out."""
    rows = make(11, 40)
    rows = rows + [("late", "n1", None, *rows[0][3:]), ("late", "n2", 5, *rows[1][3:]), (None, "n3", 5, *rows[1][3:])]
    df = trace.conform(spark.createDataFrame(rows, SCHEMA).repartition(5))
    full = trace.causal_rank(trace.lamport(df)).join(trace.critical_path(df).select("correlation_id", "event_key", "earliest_start", "is_critical"), ["correlation_id", "event_key"], "left")
    path = full.groupBy("correlation_id").agg(F.count_if("is_critical").alias("critical_events"), F.max("earliest_start").alias("path_ms"))
    want = trace.chain_stats(df).join(trace.root_and_failure(full), "correlation_id").join(trace.is_complete(df), "correlation_id").join(path, "correlation_id")
    got = trace.trace_chains(df, whole)
    assert got.columns == want.columns and got.count() == len({r[0] for r in rows}) - 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_ids_are_not_cut_between_batches():
    import pyarrow as pa

    ids = ["a"] * 5 + ["b"] + ["c"] * 4 + ["d"] * 2
    for size in range(1, 13):
        batches = [pa.RecordBatch.from_pydict({"id": ids[k : k + size]}) for k in range(0, len(ids), size)] + [pa.RecordBatch.from_pydict({"id": pa.array([], "string")})]
        tables = [t["id"].to_pylist() for t in trace._whole_ids(batches)]
        assert sum(tables, []) == ids and all(tables) and not any({*x} & {*y} for k, x in enumerate(tables) for y in tables[:k])


def test_chains_shuffle_events_without_messages_once(spark):
    """Of the plan that makes the chains, one exchange is of events, and it has no messages."""
    text = trace.trace_chains(trace.conform(spark.createDataFrame([("a", "a1", 0, "rails", "m")], "correlation_id string, event_key string, t_ms bigint, component string, message string")))
    text = text._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1 and "Join" not in text and "message" not in text.split("RepartitionByExpression")[1].split("LogicalRDD")[0]
