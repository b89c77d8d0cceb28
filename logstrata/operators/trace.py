"""Request tracing: id index, events, causal edges, logical clocks, critical path, chain roll-up.

An event table has correlation_id, event_key, t_ms, component, event_type, severity, message, job_id,
request_id, user_id, project_id, dur_ms. Events of an id are ordered by (t_ms, event_key), nulls last.
A correlation id may own a large share of all rows, so no operator gathers an id in one task.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import deque
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.causality import (
    COMPONENT_LINKS, HORIZON_MS, MIN_CONFIDENCE, SHARED_IDS, TYPE_LINKS, causal_pair, causality,
    classify_event, component_or_guess, event_details, reach_ms,
)
from ..functions.fields import field
from ..functions.text import correlation_ids
from ..session import cut_lineage
from .ordered import number_rows, range_pieces

ID = "correlation_id"
ERRORS = ["ERROR", "FATAL", "CRITICAL"]
FAILED_TYPES = ["job_fail", "rpc_error", "query_error"]
EVENT_COLUMNS = """correlation_id event_key t_ms component event_type severity message job_id request_id user_id project_id dur_ms""".split()


def conform(events: DataFrame) -> DataFrame:
    """Event table with every canonical column; missing ids are null."""
    for name in EVENT_COLUMNS:
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("double" if name == "dur_ms" else "string"))
    return events


# index and events ---------------------------------------------------------------------------------


def build_id_index(lines: DataFrame) -> DataFrame:
    """One row per (id, line). Write it clustered by id (`write_id_index`) to look ids up by pruning."""
    marked = lines.where(F.col("content").contains("correlation_id") | F.col("content").contains("request_id"))
    ids = F.explode(correlation_ids(F.col("content"))).alias(ID)
    keep = [c for c in ("session_id", "path", "line_no", "component") if c in lines.columns]
    return marked.select(ids, *keep)


def write_id_index(index: DataFrame, path: str, pieces: int | None = None) -> None:
    """Index sorted by id in range partitions, so files have tight min/max; a hot id spreads over several files."""
    order = [F.col(c) for c in (ID, "session_id", "path", "line_no")]
    parted = index.repartitionByRange(pieces, *order) if pieces else index.repartitionByRange(*order)
    parted.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def events_for_ids(index: DataFrame, parsed: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Parsed lines of the wanted ids (all of them by default), one row per (id, line)."""
    wanted = index if ids is None else index.join(ids.select(ID).distinct(), ID, "left_semi")
    key = ["session_id", "path", "line_no"]
    return wanted.select(ID, *key).join(parsed, key)


def to_events(parsed: DataFrame) -> DataFrame:
    """Events of parsed lines with `correlation_id`, `fields`, `ts`, `severity`, `message`, `component`."""
    get = lambda name: field(name)
    seconds = F.coalesce(*[get(n).try_cast("double") for n in ("duration_s", "duration", "elapsed_time")])
    detail = event_details(F.col("message"))
    rows = parsed.withColumn("component", component_or_guess(F.col("component"), F.col("message"), "fields"))
    rows = rows.withColumn("_d", detail).withColumn("severity", F.coalesce("severity", F.lit("INFO")))
    text_id = F.concat_ws(":", "path", "line_no", ID)
    return rows.select(
        ID, F.substring(F.md5(text_id), 1, 16).alias("event_id"),
        F.concat_ws(":", "session_id", "path", "line_no").alias("event_key"), "session_id", "path", "line_no",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), "component", "severity", "message",
        classify_event(F.col("component"), F.col("severity"), F.col("message"), "fields").alias("event_type"),
        get("jid").alias("job_id"), get("request_id").alias("request_id"), get("user_id").alias("user_id"),
        get("project_id").alias("project_id"), get("class").alias("job_class"), get("grpc.method").alias("grpc_method"),
        get("grpc.code").alias("grpc_code"), "_d.http_method", "_d.http_status", "_d.controller", "_d.action",
        F.coalesce("_d.logged_ms", seconds * 1000).alias("dur_ms"),
    )


# causal edges -------------------------------------------------------------------------------------

PAIR_COLUMNS = ["event_key", "t_ms", "component", "event_type", "job_id", "request_id", "user_id", "project_id"]
# With no link between the types, a link between the components or a shared id is needed; the largest
# delay of each case follows from the weights.
ROUTES = {
    "type": HORIZON_MS,
    "component": max(reach_ms(a, "-", b, "-", s) for a, b in COMPONENT_LINKS for s in (None, "user_id", "project_id")) + 1,
    "job_near": max(reach_ms(a, "-", b, "-", "job_id") for a, b in COMPONENT_LINKS) + 1,
    "job_any": reach_ms("-", "-", "-", "-", "job_id") + 1,
    "request_near": max(reach_ms(a, "-", b, "-", "request_id") for a, b in COMPONENT_LINKS) + 1,
    "request_any": reach_ms("-", "-", "-", "-", "request_id") + 1,
}


def _next_of(value: Column, links) -> Column:
    """Array of what `value` can lead to."""
    out = F.array().cast("array<string>")
    for a in sorted({a for a, _ in links}):
        targets = sorted(b for x, b in links if x == a)
        out = F.when(value == a, F.array(*[F.lit(b) for b in targets])).otherwise(out)
    return out


def _routes(side: str) -> Column:
    """Join keys of an event as array<struct<route, value, slot>>.

    A pair can only qualify if its types are linked, or its components are, or it shares a job or request.
    Each way is a route with its own reach; causes and effects meet on (route, value, time slot of that reach).
    Causes are put in their own slot and the next.
    """
    cause = side == "cause"
    linked = _next_of(F.col("component"), COMPONENT_LINKS)
    types = _next_of(F.col("event_type"), TYPE_LINKS) if cause else F.array("event_type")
    comps = linked if cause else F.array("component")
    values = {"type": types, "component": comps}
    for name in ("job", "request"):
        ident = F.nullif(F.col(f"{name}_id"), F.lit(""))
        near = linked if cause else F.array("component")
        values[f"{name}_near"] = F.when(ident.isNotNull(), F.transform(near, lambda c: F.concat_ws("\x01", ident, c)))
        values[f"{name}_any"] = F.when(ident.isNotNull(), F.array(ident))
    out = []
    for route, reach in ROUTES.items():
        slot = F.floor(F.col("t_ms") / reach)
        slots = F.array(slot, slot + 1) if cause else F.array(slot)
        keys = F.flatten(F.transform(
            F.coalesce(values[route], F.array().cast("array<string>")),
            lambda v: F.transform(slots, lambda s: F.struct(F.lit(route).alias("route"), v.alias("value"), s.alias("slot"))),
        ))
        out.append(keys)
    return F.concat(*out)


def _route_of_pair(a: str, b: str) -> Column:
    """The one route a pair is taken from, so that no pair is found twice."""
    def linked(name, links):
        test = F.lit(False)
        for x, y in links:
            test = test | ((F.col(f"{a}.{name}") == x) & (F.col(f"{b}.{name}") == y))
        return F.coalesce(test, F.lit(False))

    same = lambda n: F.coalesce((F.col(f"{a}.{n}") == F.col(f"{b}.{n}")) & (F.col(f"{a}.{n}") != ""), F.lit(False))
    near = linked("component", COMPONENT_LINKS)
    return (
        F.when(linked("event_type", TYPE_LINKS), "type").when(same("job_id") & near, "job_near").when(same("job_id"), "job_any")
        .when(same("request_id") & near, "request_near").when(same("request_id"), "request_any").when(near, "component")
    )


def causal_edges(events: DataFrame, horizon_s: int = 300, min_conf: float = MIN_CONFIDENCE, busy: int = 256) -> DataFrame:
    """Edges (correlation_id, src, dst, confidence): pairs of one id in order, at most 300 s apart, above `min_conf`.

    Usual ids meet on (id, 300 s slot). Where a slot of an id holds more than `busy` events, its events meet
    on the routes instead, which enumerate hardly anything but edges. Both ways give the same edges.
    """
    horizon = horizon_s * 1000
    rows = conform(events).where("t_ms is not null").select(ID, *PAIR_COLUMNS)
    rows = rows.withColumn("_slot", F.floor(F.col("t_ms") / horizon))
    sizes = rows.groupBy(ID, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    around = Window.partitionBy(ID).orderBy("_slot").rangeBetween(-1, 1)
    sizes = sizes.withColumn("_busy", F.sum("_n").over(around) > busy)
    # an id is handled one way throughout, so that a pair of neighbouring slots is not split between the ways
    hot = sizes.where("_busy").select(ID).distinct()

    def ordered(a: str, b: str) -> Column:
        same_time = F.col(f"{a}.t_ms") == F.col(f"{b}.t_ms")
        dt = F.col(f"{b}.t_ms") - F.col(f"{a}.t_ms")
        return (dt >= 0) & (dt <= horizon) & (~same_time | (F.col(f"{a}.event_key") < F.col(f"{b}.event_key")))

    def edges(pairs: DataFrame) -> DataFrame:
        return (
            pairs.withColumn("confidence", causality("a", "b")).where(F.col("confidence") > min_conf)
            .select(F.col(f"a.{ID}").alias(ID), F.col("a.event_key").alias("src"), F.col("b.event_key").alias("dst"), "confidence")
        )

    usual = rows.join(hot, ID, "left_anti")
    a = usual.withColumn("_slot", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1))).alias("a")
    b = usual.alias("b")
    on = (F.col(f"a.{ID}") == F.col(f"b.{ID}")) & (F.col("a._slot") == F.col("b._slot")) & ordered("a", "b")
    plain = edges(a.join(b, on))

    crowded = rows.join(hot, ID, "left_semi")
    if min_conf < MIN_CONFIDENCE:  # the reach of the routes is worked out for 0.5
        a = crowded.withColumn("_slot", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1))).alias("a")
        return plain.unionByName(edges(a.join(crowded.alias("b"), on)))
    a = crowded.withColumn("_r", F.explode(_routes("cause"))).alias("a")
    b = crowded.withColumn("_r", F.explode(_routes("effect"))).alias("b")
    on = (F.col(f"a.{ID}") == F.col(f"b.{ID}")) & (F.col("a._r") == F.col("b._r")) & ordered("a", "b")
    met = a.join(b, on).where(_route_of_pair("a", "b") == F.col("a._r.route"))
    return plain.unionByName(edges(met))


# logical clocks -----------------------------------------------------------------------------------


def _step(clocks: dict, prev: tuple | None, event: tuple) -> None:
    """Advance the clock of the event's component; a causal predecessor lifts it above its own clock."""
    clock = clocks.get(event[0], 0) + 1
    if prev is not None and causal_pair(prev, event):
        clock = max(clock, clocks.get(prev[0], 0)) + 1
    clocks[event[0]] = clock


def _event_tuples(pdf):
    t = [None if v != v or v is None else int(v) for v in pdf["t_ms"]]
    return zip(pdf[ID], pdf["component"], t, pdf["job_id"], pdf["request_id"])


def _summarise(batches):
    """Per piece: first and last event of its (single selected) id and the effect of all but the first on the clocks.

    The effect is a max-plus matrix over components, so effects of consecutive pieces can be chained.
    """
    import pandas as pd

    first = prev = piece = ident = None
    effect: dict[str, dict[str, int]] = {}
    for pdf in batches:
        for (cid, *event), p in zip(_event_tuples(pdf), pdf["_piece"]):
            event = tuple(event)
            if first is None:
                first, piece, ident = event, int(p), cid
            else:
                own = effect.get(event[0], {event[0]: 0})
                if causal_pair(prev, event):
                    lifted = {c: w + 2 for c, w in own.items()}
                    for c, w in effect.get(prev[0], {prev[0]: 0}).items():
                        lifted[c] = max(lifted.get(c, -1), w + 1)
                    effect[event[0]] = lifted
                else:
                    effect[event[0]] = {c: w + 1 for c, w in own.items()}
            prev = event
    if first is not None:
        yield pd.DataFrame({"piece": [piece], "ident": [ident], "summary": [json.dumps([first, prev, effect])]})


def _carried(bounds: list, summaries: dict) -> dict:
    """Clocks and last event that each piece inherits for its first id; one small record per piece."""
    carry, state = {}, None
    for i, row in enumerate(bounds):
        if state is not None and state[0] == row.low:
            carry[row._piece] = state
        spans = i + 1 < len(bounds) and bounds[i + 1].low == row.high
        if not spans:
            state = None
            continue
        first, last, effect = summaries[row._piece]
        inherited = state if state is not None and row.low == row.high == state[0] else None
        clocks = dict(inherited[1]) if inherited else {}
        _step(clocks, inherited[2] if inherited else None, tuple(first))
        after = dict(clocks)
        for comp, terms in effect.items():
            after[comp] = max(clocks.get(c, 0) + w for c, w in terms.items())
        state = (row.high, after, tuple(last))
    return carry


def lamport(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """Events with `lamport`, the logical clock of each event within its id.

    Rows are range-partitioned by (id, time), which cuts long ids. Clocks of a piece depend on what came before
    only through a max-plus matrix, so pieces are summarised in parallel, the summaries chained, and the clocks
    written in one more parallel pass.
    """
    events = conform(events)
    order = [F.col(ID), F.col("t_ms").asc_nulls_last(), F.col("event_key")]
    parts = range_pieces(events, order, pieces)
    bounds = parts.groupBy("_piece").agg(F.min(ID).alias("low"), F.max(ID).alias("high")).orderBy("_piece").collect()
    spanning = {a._piece: a.high for a, b in zip(bounds, bounds[1:]) if a.high == b.low}
    carry = {}
    if spanning:
        cut = F.coalesce(*[F.when(F.col("_piece") == p, F.col(ID) == i) for p, i in spanning.items()], F.lit(False))
        found = parts.where(cut).select("_piece", ID, "component", "t_ms", "job_id", "request_id")
        rows = found.mapInPandas(_summarise, "piece int, ident string, summary string").collect()  # one per piece
        carry = _carried(bounds, {r.piece: json.loads(r.summary) for r in rows})

    def clocks_of(batches):
        ident, clocks, prev, opened = None, {}, None, False
        for pdf in batches:
            out = []
            for (cid, *event), p in zip(_event_tuples(pdf), pdf["_piece"]):
                event = tuple(event)
                if cid != ident:
                    clocks, prev = {}, None
                    inherited = None if opened else carry.get(int(p))
                    if inherited and inherited[0] == cid:
                        clocks, prev = dict(inherited[1]), inherited[2]
                    ident, opened = cid, True
                _step(clocks, prev, event)
                prev = event
                out.append(clocks[event[0]])
            yield pdf[[ID, "event_key"]].assign(lamport=out)

    slim = parts.select(ID, "event_key", "component", "t_ms", "job_id", "request_id", "_piece")
    clocks = slim.mapInPandas(clocks_of, f"{ID} string, event_key string, lamport bigint")
    return events.join(clocks, [ID, "event_key"])


def causal_rank(events: DataFrame) -> DataFrame:
    """Position of each event within its id by (lamport, time). A clock value occurs once per component, so
    buckets of clock values are bounded."""
    return number_rows(
        events, [ID], [F.col("lamport"), F.col("t_ms").asc_nulls_last(), F.col("event_key")], F.floor(F.col("lamport") / 4096), "causal_rank"
    )


# critical path --------------------------------------------------------------------------------------


class _Window:
    """Best value per class of recent events, by age: for any reach, the best value not older than that.

    Newer entries with an equal or better value drop older ones, so each list is sorted both ways. A class that got nothing within
    the horizon is dropped: what is kept is bounded by the events of one horizon.
    """

    def __init__(self):
        self.lists: dict[tuple, tuple[deque, deque]] = {}
        self.added: deque[tuple[int, tuple]] = deque()

    def add(self, key: tuple, when: int, value: float) -> None:
        times, values = self.lists.setdefault(key, (deque(), deque()))
        while values and values[-1] <= value:
            times.pop()
            values.pop()
        times.append(when)
        values.append(value)
        while times[0] < when - HORIZON_MS:
            times.popleft()
            values.popleft()
        self.added.append((when, key))
        while self.added[0][0] < when - HORIZON_MS:
            _, old = self.added.popleft()
            if old in self.lists and self.lists[old][0][-1] < when - HORIZON_MS:
                del self.lists[old]

    def best(self, key: tuple, since: int) -> float | None:
        found = self.lists.get(key)
        if not found:
            return None
        i = bisect_left(found[0], since)
        return found[1][i] if i < len(found[0]) else None


KINDS = [None, *SHARED_IDS]


@lru_cache(maxsize=None)
def _ways(forward: bool, a: tuple, b: tuple) -> tuple:
    """(shared identifier or None, reach) of the ways in which a class of events can cause (forward) or follow another."""
    reaches = ((kind, reach_ms(*(a + b if forward else b + a), kind)) for kind in KINDS)
    return tuple((kind, reach) for kind, reach in reaches if reach >= 0)


class _Pass:
    """Recurrence over the events of one id in time order (forward) or reverse (backward).

    Forward, an event takes the best end of its causes; backward, the earliest start of its effects, as the
    best of the negated values. `classes` are the (component, type) classes seen.
    """

    def __init__(self, forward: bool):
        self.forward, self.window, self.depths, self.classes = forward, _Window(), _Window(), set()

    def visit(self, comp, typ, ids, when):
        """(best value, greatest depth) over the neighbours of an event, or (None, None)."""
        value = depth = None
        for other in self.classes:
            for kind, reach in _ways(self.forward, other, (comp, typ)):
                ident = None if kind is None else ids[kind]
                if kind is not None and not ident:
                    continue
                key = (*other, kind, ident)
                v = self.window.best(key, when - reach)
                if v is not None:
                    value = v if value is None else max(value, v)
                    depth = max(depth or 0, self.depths.best(key, when - reach))
        return value, depth

    def add(self, comp, typ, ids, when, value, depth):
        self.classes.add((comp, typ))
        for kind in KINDS:
            ident = None if kind is None else ids[kind]
            if kind is None or ident:
                self.window.add((comp, typ, kind, ident), when, value)
                self.depths.add((comp, typ, kind, ident), when, depth)

    def take(self, comp, typ, ids, t, dur, es):
        """(value, depth) of the next event: its earliest start and depth, or its latest start, which is `es` without effects."""
        when = t if self.forward else -t
        value, depth = self.visit(comp, typ, ids, when)
        if self.forward:
            value, depth = (0.0, 0) if value is None else (max(value, 0.0), depth + 1)
            self.add(comp, typ, ids, when, value + dur, depth)
        else:
            value, depth = es if value is None else -value - dur, 0
            self.add(comp, typ, ids, when, -value, 0)
        return value, depth


def _recurrence(forward: bool):
    """mapInPandas body: rows sorted by id, island and time (or reverse); state rows (event_key null) restore what an
    earlier segment of the island left, and the last row of an unfinished segment yields its state."""

    def run(batches):
        import pickle

        import pandas as pd

        ident, state = None, None
        for pdf in batches:
            out = []
            names = ["event_key", "t_ms", "component", "event_type", "job_id", "request_id", "user_id", "project_id", "dur_ms", "es", "_more", "_state"]
            for cid, island, *row in zip(pdf[ID], pdf["_island"], *[pdf[n] for n in names]):
                key, t, comp, typ, job, req, user, project, dur, es, more, blob = row
                if (cid, island) != ident:
                    ident, state = (cid, island), _Pass(forward)
                if key is None:
                    state = pickle.loads(blob)
                    continue
                ids = {"job_id": job, "request_id": req, "user_id": user, "project_id": project}
                dur = 0.0 if dur is None or dur != dur else float(dur)
                result, depth = state.take(comp, typ, ids, int(t), dur, None if forward else float(es))
                out.append((cid, island, key, result, depth, pickle.dumps(state) if more else None))
            yield pd.DataFrame(out, columns=[ID, "_island", "event_key", "value", "depth", "state"])

    return run


RESULT = f"{ID} string, _island bigint, event_key string, value double, depth bigint, state binary"


def _run_waves(rows: DataFrame, forward: bool, waves: int) -> DataFrame:
    """Run a recurrence segment by segment: wave n holds the n-th segment of every island that has one.

    Islands of one segment, nearly all, finish in the first wave. State passes between waves through checkpointed
    rows. A segment has a bounded number of rows, so no task holds more of an id than that.
    """
    names = [ID, "_island", "event_key", "t_ms", "component", "event_type", "job_id", "request_id", "user_id", "project_id", "dur_ms", "es", "_more"]
    order = F.col("t_ms") if forward else F.col("t_ms").desc()
    tie = F.col("event_key") if forward else F.col("event_key").desc()
    done, state = None, None
    for wave in range(waves) if forward else reversed(range(waves)):
        more = F.col("_segment") < F.col("_segments") - 1 if forward else F.col("_segment") > 0
        edge = F.col("_edge_last" if forward else "_edge_first")
        part = rows.where(F.col("_segment") == wave).withColumn("_more", more & edge).select(*names).withColumn("_state", F.lit(None).cast("binary"))
        if state is not None:
            part = part.unionByName(state, allowMissingColumns=True)
        part = part.repartition(ID, "_island").sortWithinPartitions(ID, "_island", F.col("event_key").isNotNull(), order, tie)
        result = part.mapInPandas(_recurrence(forward), RESULT)
        if waves > 1:
            result = cut_lineage(result)
            state = result.where("state is not null").select(ID, "_island", F.col("state").alias("_state"))
        done = result if done is None else done.unionByName(result)
    return done.drop("state")


def with_islands(events: DataFrame) -> DataFrame:
    """Events with `_island`: stretches of an id's events between gaps that no cause reaches across.

    Events within a slot as long as the greatest reach have no such gap, so gaps show between the first and last times of
    neighbouring slots, and the window runs over slots.
    """
    slot = F.floor(F.col("t_ms") / HORIZON_MS)
    slots = events.groupBy(ID, slot.alias("_slot")).agg(F.min("t_ms").alias("_lo"), F.max("t_ms").alias("_hi"))
    own = Window.partitionBy(ID).orderBy("_slot")
    gap = F.coalesce(F.col("_lo") - F.lag("_hi").over(own) > HORIZON_MS, F.lit(False))
    slots = slots.select(ID, "_slot", gap.cast("bigint").alias("_gap")).select(ID, "_slot", F.sum("_gap").over(own).alias("_island"))
    return events.withColumn("_slot", slot).join(slots, [ID, "_slot"]).drop("_slot")


def critical_path(events: DataFrame, segment: int = 100_000) -> DataFrame:
    """Events with earliest_start, latest_start, is_critical and depth (edges before it on the longest way).

    Forward: latest end of the causes; backward: earliest start of the effects less the own duration; an event
    without effects starts latest when it starts earliest. Causes are those of `causal_edges`, found without
    building the edges: per class of events only the best value within reach matters. Islands of an id (see `with_islands`) are
    independent and run in parallel, however many one id has.
    """
    rows = conform(events).where("t_ms is not null").select(*[c for c in EVENT_COLUMNS if c not in ("severity", "message")])
    rows = with_islands(rows)
    island = [ID, "_island"]
    rows = number_rows(rows, island, ["t_ms", "event_key"], F.floor(F.col("t_ms") / 60_000), "_pos")
    sizes = rows.groupBy(*island).agg(F.max("_pos").alias("_count"))
    rows = rows.join(sizes, island).withColumn("_segment", F.floor((F.col("_pos") - 1) / segment))
    rows = rows.withColumn("_segments", F.ceil(F.col("_count") / segment)).withColumn("es", F.lit(None).cast("double"))
    rows = rows.withColumn("_edge_last", F.col("_pos") % segment == 0).withColumn("_edge_first", (F.col("_pos") - 1) % segment == 0)
    rows = cut_lineage(rows)
    waves = rows.agg(F.max("_segments").alias("n")).first().n or 1
    forward = _run_waves(rows, True, waves).select(ID, "event_key", F.col("value").alias("es"), "depth")
    rows = rows.drop("es").join(forward, [ID, "event_key"])
    if waves > 1:
        rows = cut_lineage(rows)
    backward = _run_waves(rows, False, waves).select(ID, "event_key", F.col("value").alias("latest_start"))
    slack = F.abs(F.col("latest_start") - F.col("earliest_start")) < 0.001
    return (
        rows.select(ID, "event_key", "t_ms", F.col("es").alias("earliest_start"), "depth")
        .join(backward, [ID, "event_key"]).withColumn("is_critical", slack)
    )


def topological_order(paths: DataFrame) -> DataFrame:
    """Position of each event in a topological order of its id: by depth, then time. Takes `critical_path` rows."""
    bucket = F.struct("depth", F.floor(F.col("t_ms") / 60_000).alias("minute"))
    return number_rows(paths, [ID], ["depth", "t_ms", "event_key"], bucket, "position")


# chains -------------------------------------------------------------------------------------------


def has_gap(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Per id: whether two consecutive events are more than `seconds` apart.

    Events are first reduced to the first and last time per slot of that length; only neighbouring slots
    can have a wide gap between them, so the window runs over slots.
    """
    width = seconds * 1000
    slots = events.where("t_ms is not null").groupBy(ID, F.floor(F.col("t_ms") / width).alias("_slot")).agg(
        F.min("t_ms").alias("_lo"), F.max("t_ms").alias("_hi")
    )
    before = F.lag("_hi").over(Window.partitionBy(ID).orderBy("_slot"))
    gaps = slots.withColumn("_gap", F.coalesce(F.col("_lo") - before > width, F.lit(False)))
    return gaps.groupBy(ID).agg(F.bool_or("_gap").alias("has_gap"))


def is_complete(events: DataFrame) -> DataFrame:
    """Per id: start seen, end seen, no gap above a minute, and all three."""
    ends = events.groupBy(ID).agg(*_ends())
    out = ends.join(has_gap(events), ID, "left").withColumn("has_gap", F.coalesce("has_gap", F.lit(False)))
    return out.withColumn("is_complete", COMPLETE())


def _ends() -> list[Column]:
    return [
        F.bool_or(F.col("event_type").isin("request_start", "job_enqueue")).alias("has_start"),
        F.bool_or(F.col("event_type").isin("request_end", "job_end", "job_fail")).alias("has_end"),
    ]


COMPLETE = lambda: F.col("has_start") & F.col("has_end") & ~F.col("has_gap")


def root_and_failure(events: DataFrame) -> DataFrame:
    """Per id: root cause (first error on the critical path, else first error) and failure point.

    `events` carries causal_rank, earliest_start and is_critical. All are min-by aggregates.
    """
    return events.groupBy(ID).agg(*_causes(F.col("causal_rank"))).select(ID, ROOT().alias("root_cause"), "failure_point")


ROOT = lambda: F.coalesce("_path_error", "_first_error")


def _causes(rank: Column) -> list[Column]:
    is_error = F.col("severity").isin(ERRORS)
    order = F.struct(rank, "event_key")
    on_path = F.struct("earliest_start", rank, "event_key")
    bad_type = F.col("event_type").isin("error", *FAILED_TYPES)
    failed = F.col("event_type").isin(FAILED_TYPES) | is_error
    return [
        F.min_by("event_key", F.when(F.col("is_critical") & bad_type, on_path)).alias("_path_error"),
        F.min_by("event_key", F.when(is_error, order)).alias("_first_error"),
        F.min_by("event_key", F.when(failed, order)).alias("failure_point"),
    ]


def chain_stats(events: DataFrame) -> DataFrame:
    """Per id: span, events, distinct users, projects and failed jobs, errors and warnings."""
    return conform(events).groupBy(ID).agg(*_stats())


def _stats() -> list[Column]:
    failed_job = F.when((F.col("event_type") == "job_fail") & F.col("job_id").isNotNull(), F.col("job_id"))
    return [
        F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"),
        (F.max("t_ms") - F.min("t_ms")).alias("total_ms"), F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("user_id").alias("users"), F.countDistinct("project_id").alias("projects"),
        F.countDistinct(failed_job).alias("failed_jobs"),
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        F.bool_or(F.col("severity").isin(ERRORS)).alias("has_errors"),
    ]


def chain_members(events: DataFrame, column: str) -> DataFrame:
    """The distinct users, projects or jobs of each id, one row each."""
    return events.where(F.col(column).isNotNull()).select(ID, column).distinct()


def chain_breakdown(events: DataFrame, by: str) -> DataFrame:
    """Events and time per id and component or severity."""
    return conform(events).groupBy(ID, by).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("dur_ms", F.lit(0))).cast("double").alias("time_ms")
    )


def time_share(breakdown: DataFrame, chains: DataFrame) -> DataFrame:
    """Share of the chain's duration spent per component, in percent."""
    share = F.when(F.col("total_ms") > 0, F.col("time_ms") * 100.0 / F.col("total_ms")).otherwise(0.0)
    return breakdown.join(chains.select(ID, "total_ms"), ID).withColumn("share_pct", share)


def id_catalog(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids by event count with their components (a closed, small set) and whether any event is an error."""
    per = events.groupBy(ID).agg(
        F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_set("component")).alias("components"),
        F.bool_or(F.col("severity").isin(ERRORS)).alias("has_errors"),
    )
    ordered = per.orderBy(F.desc("event_count"), ID)
    return ordered.limit(limit) if limit else ordered


#: Events of an id that one task traces at once, at most; rows of a task, about; buckets in which ids are counted.
WHOLE, TRACED_ROWS, ID_BUCKETS = 100_000, 150_000, 16_384
TRACED_IN = [ID, *[c for c in EVENT_COLUMNS if c not in (ID, "message")]]
TRACED = "lamport bigint, earliest_start double, is_critical boolean, _wide boolean"


def _whole_ids(batches):
    """Arrow tables of the rows of batches sorted by their first column, none of whose values is in two of them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, ident = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1].as_py()
        cut = pc.index(batch.column(0), last).as_py()
        if held and (cut or ident != last) or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        ident = last
    if held:
        yield pa.Table.from_batches(held)


def _traced(batches):
    """mapInArrow: events of whole ids, sorted by id and time, with their clock, earliest start, whether they are critical, and whether
    more than a minute passed since the event before."""
    import pyarrow as pa

    for table in _whole_ids(batches):
        names = ["t_ms", "component", "event_type", "job_id", "request_id", "user_id", "project_id", "dur_ms"]
        ids, events = table[ID].to_pylist(), list(zip(*[table[n].to_pylist() for n in names]))
        found, start = [], 0
        for end in range(1, len(ids) + 1):
            if end == len(ids) or ids[end] != ids[start]:
                found += _trace_id(events[start:end])
                start = end
        for name, kind, values in zip(TRACED.replace(",", "").split()[::2], (pa.int64(), pa.float64(), pa.bool_(), pa.bool_()), zip(*found)):
            table = table.append_column(name, pa.array(values, kind))
        yield from table.to_batches()


def _trace_id(events: list[tuple]) -> list[tuple]:
    """(clock, earliest start, critical, wide gap before) of the events of one id in order; those without a time are last, and have no
    place in paths."""
    clocks, prev, lamports, wide, timed = {}, None, [], [], []
    for t, comp, typ, job, request, user, project, dur in events:
        event = (comp, t, job, request)
        _step(clocks, prev, event)
        wide.append(prev is not None and t is not None and t - prev[1] > 60_000)
        lamports.append(clocks[comp])
        if t is not None:
            timed.append((comp, typ, {"job_id": job, "request_id": request, "user_id": user, "project_id": project}, t, 0.0 if dur is None or dur != dur else float(dur)))
        prev = event

    def walk(forward: bool, starts: list):
        state, before = _Pass(forward), None
        for event, es in zip(timed, starts) if forward else zip(reversed(timed), reversed(starts)):
            if before is not None and abs(event[3] - before) > HORIZON_MS:  # no cause reaches across
                state = _Pass(forward)
            before = event[3]
            yield state.take(*event, es)[0]

    early = list(walk(True, [None] * len(timed)))
    late = list(walk(False, early))[::-1]
    rest = len(events) - len(timed)
    return list(zip(lamports, early + [None] * rest, [abs(b - a) < 0.001 for a, b in zip(early, late)] + [None] * rest, wide))


def _roll_up(traced: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One row per id of events with clocks and paths; `gaps` has has_gap of the ids if `_wide` does not tell it."""
    order = F.struct("lamport", F.col("t_ms").isNull(), "t_ms")  # as causal_rank
    path = [F.count_if("is_critical").alias("critical_events"), F.max("earliest_start").alias("path_ms")]
    per = traced.groupBy(ID).agg(*_stats(), *_causes(order), *_ends(), F.bool_or("_wide").alias("has_gap"), *path)
    if gaps is not None:
        per = per.drop("has_gap").join(gaps, ID, "left").withColumn("has_gap", F.coalesce("has_gap", F.lit(False)))
    per = per.withColumn("root_cause", ROOT()).withColumn("is_complete", COMPLETE())
    stats = per.columns[: per.columns.index("_path_error")]
    return per.select(*stats, "root_cause", "failure_point", "has_start", "has_end", "has_gap", "is_complete", "critical_events", "path_ms")


def trace_chains(events: DataFrame, whole: int = WHOLE, rows: int = TRACED_ROWS, sizes_from: DataFrame | None = None) -> DataFrame:
    """One row per id: roll-up, root cause, failure point, completeness and the length of its critical path.

    Ids of up to `whole` events are shuffled once, without their messages, and traced by the task that sorts them. Ids of more events
    go through `lamport` and `critical_path`, which cut them. Events are counted by a hash of their id first, and ids only where one
    may be that long. `sizes_from` may be a narrower form of `events` to count from.
    """
    events = conform(events).where(F.col(ID).isNotNull()).select(*TRACED_IN)
    events = events.withColumns({"t_ms": F.col("t_ms").cast("bigint"), "dur_ms": F.col("dur_ms").cast("double")})
    bucket = F.pmod(F.xxhash64(ID), F.lit(ID_BUCKETS))
    ids = (events if sizes_from is None else sizes_from.where(F.col(ID).isNotNull())).select(ID)
    counts = {r.bucket: r.n for r in ids.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}
    crowded, small, large = [b for b, n in counts.items() if n > whole], events, None
    if crowded:
        sizes = ids.where(bucket.isin(crowded)).groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(sizes.where(F.col("n") > whole).select(ID))
        small = events.join(large, ID, "left_anti")
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-sum(counts.values()) // rows))
    placed = small.repartition(tasks, ID).sortWithinPartitions(ID, F.col("t_ms").asc_nulls_last(), "event_key")
    chains = _roll_up(placed.mapInArrow(_traced, f"{', '.join(f'{n} {t}' for n, t in placed.dtypes)}, {TRACED}"))
    if large is None or large.isEmpty():
        return chains
    cut = cut_lineage(events.join(large, ID, "left_semi"))
    paths = critical_path(cut).select(ID, "event_key", "earliest_start", "is_critical")
    return chains.unionByName(_roll_up(lamport(cut).join(paths, [ID, "event_key"], "left").withColumn("_wide", F.lit(False)), has_gap(cut)))
