"""Endpoint latency, top consumers, error statistics, comparison of sessions.

`requests` has one row per request: session_id, ts, endpoint, duration_ms, status and any of the
resource columns. Percentiles are exact, however many durations an endpoint has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import range_pieces

# Kinds of logs that carry request durations, by a part of the path.
LATENCY_LOGS = {
    "production_json": ["production_json.log", "production.json.log"],
    "api_json": ["api_json.log", "api.json.log"],
    "gitaly": ["gitaly/current", "gitaly.log"],
    "sidekiq": ["sidekiq/current", "sidekiq.log"],
    "praefect": ["praefect/current", "praefect.log"],
}
INTERVALS = {
    "1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "6h": "6 hours",
    "1d": "1 day",
}


def latency_files(files: DataFrame, min_size: int = 0) -> DataFrame:
    """Files with request durations and their kind, of `min_size` bytes or more."""
    kind = None
    for name, parts in LATENCY_LOGS.items():
        test = F.col("path").contains(parts[0]) | F.col("path").contains(parts[1])
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return files.where(F.col("size") >= min_size).withColumn("latency_type", kind).where("latency_type is not null")


def failed(status: Column) -> Column:
    """5xx, a failed job, or an RPC code other than OK."""
    text = status.cast("string")
    number = text.try_cast("int")
    return F.coalesce(F.when(number.isNotNull(), number >= 500).otherwise(~F.upper(text).isin("OK", "DONE", "START")), F.lit(False))


def endpoint_stats(requests: DataFrame, keys: list[str], interval: str | None = None) -> DataFrame:
    """count, rps, p99, p95, median, max, min, stddev, score and fail % per `keys` (and interval).

    Percentiles are values by rank, between two ranks in proportion. Counts by (keys, duration) are range-partitioned, so one endpoint
    may hold any share of them: a piece's rows get their ranks from running counts, and each rank asked for lies in one row. The
    standard deviation sums squares of differences from the mean.
    """
    if interval:
        start = F.window("ts", INTERVALS.get(interval, interval))["start"]
        requests = requests.withColumn("interval", start)
        keys = [*keys, "interval"]
    values = requests.groupBy(*keys, "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed(F.col("status"))).alias("fails"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    parts = range_pieces(values, [F.col(c) for c in (*keys, "duration_ms")])  # nulls come first
    known, d = F.when(F.col("duration_ms").isNotNull(), F.col("n")).otherwise(0), F.col("duration_ms").cast("double")
    per_piece = parts.groupBy("_piece", *keys).agg(
        F.sum("n").alias("count"), F.sum(known).alias("known"), F.sum(d * F.col("n")).alias("sum"), F.max("duration_ms").alias("max"), F.min("duration_ms").alias("min"),
        F.sum("fails").alias("fails"), F.min("first_ts").alias("first"), F.max("last_ts").alias("last"),
    )
    whole = Window.partitionBy(*keys)  # a row for each piece that a key reaches
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda f, c: f(c).over(whole).alias(c)
    per_piece = per_piece.select(
        F.col("_piece").alias("_p"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], F.coalesce(F.sum("known").over(before), F.lit(0)).alias("offset"),
        *[total(F.sum, c) for c in ("count", "known", "sum", "fails")], *[total(f, c) for f, c in ((F.max, "max"), (F.min, "min"), (F.min, "first"), (F.max, "last"))],
    )
    same = F.col("_piece") == F.col("_p")
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    local = Window.partitionBy("_piece", *keys).orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("_piece", *keys, "duration_ms", "n", known.alias("known_n")).withColumn("upto", F.sum("known_n").over(local)).join(per_piece, same)
    rows = rows.withColumn("upto", F.col("upto") + F.col("offset"))
    shares = {"p99": 0.99, "p95": 0.95, "median": 0.5}
    place = {name: F.lit(q) * (F.col("known") - 1) for name, q in shares.items()}
    at = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("known_n")), d))
    gap = d - F.col("sum") / F.col("known")
    stats = rows.groupBy(*keys).agg(
        *[at(F.floor(x)).alias(f"{name}_low") for name, x in place.items()], *[at(F.ceil(x)).alias(f"{name}_high") for name, x in place.items()],
        *[F.max(x - F.floor(x)).alias(f"{name}_part") for name, x in place.items()], F.sum(gap * gap * F.col("n")).alias("_squares"),
        *[F.first(c).alias(c) for c in ("count", "known", "fails", "max", "min", "first", "last")],
    )
    seconds = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6
    stats = stats.withColumns({name: F.col(f"{name}_low") * (1 - F.col(f"{name}_part")) + F.col(f"{name}_high") * F.col(f"{name}_part") for name in shares})
    return stats.select(
        *keys, "count", F.when(seconds > 0, F.col("count") / seconds).alias("rps"), *shares, "max", "min",
        F.sqrt(F.col("_squares") / F.col("known")).alias("stddev"), (F.col("count") * F.col("p99")).alias("score"),
        (F.col("fails") * 100.0 / F.col("count")).alias("fail_pct"),
    )


def stats_series(stats: DataFrame) -> DataFrame:
    return stats.orderBy("interval", F.desc("score"))


def top_endpoints(stats: DataFrame, metric: str, n: int = 50) -> DataFrame:
    return stats.orderBy(F.desc(metric), "endpoint").limit(n)


def filter_endpoints(stats: DataFrame, text: str) -> DataFrame:
    return stats.where(F.contains(F.lower("endpoint"), F.lit(text.lower())))


CONSUMED = """duration_ms db_ms redis_ms gitaly_ms rugged_ms queue_ms cpu_s mem_kb git_rss resp_bytes disk_r disk_w""".split()


def _consumed(requests: DataFrame) -> list[str]:
    return [c for c in CONSUMED if c in requests.columns]


def consumer_totals(requests: DataFrame) -> DataFrame:
    """One row: requests, failures and the sum of every resource."""
    return requests.agg(
        F.count(F.lit(1)).alias("count"), F.count_if(failed(F.col("status"))).alias("fails"),
        *[F.sum(c).alias(c) for c in _consumed(requests)],
    )


def top_consumers(requests: DataFrame, dim: str, sort_by: str = "duration_ms", limit: int = 10) -> DataFrame:
    """Largest consumers by path, project or user, each value with its share of the total in percent.

    The totals are a scalar subquery over the grouped rows. A client without a user counts as one.
    """
    key = F.coalesce(dim, "client") if dim == "user_name" and "client" in requests.columns else F.col(dim)
    metrics = ["count", "fails", *_consumed(requests)]
    per = requests.groupBy(key.alias(dim)).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(failed(F.col("status"))).alias("fails"),
        *[F.sum(c).alias(c) for c in _consumed(requests)],
    )
    totals = per.agg(F.struct(*[F.sum(m).alias(m) for m in metrics]).alias("t")).scalar()
    top = per.where(F.col(dim).isNotNull()).orderBy(F.desc(sort_by), dim).limit(limit).withColumn("_t", totals)
    share = lambda m: F.when(F.col(f"_t.{m}") > 0, F.col(m) * 100.0 / F.col(f"_t.{m}")).otherwise(0.0)
    return top.select(dim, *metrics, *[share(m).alias(f"{m}_pct") for m in metrics])


def error_stats(requests: DataFrame, message: str = "error_message") -> DataFrame:
    """Per error message: how often, by how many users and in how many projects, first and last time, a backtrace."""
    errors = requests.where(F.col(message).isNotNull())
    backtrace = [F.min("backtrace").alias("backtrace")] if "backtrace" in requests.columns else []
    return errors.groupBy("session_id", message).agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct("user_name").alias("users"),
        F.countDistinct("project").alias("projects"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *backtrace,
    )


def error_events(requests: DataFrame, message: str = "error_message") -> DataFrame:
    """The events behind `error_stats`, one row each; no list per message is built."""
    return requests.where(F.col(message).isNotNull()).select("session_id", message, "ts", "endpoint", "user_name", "project")


def latency_overview(stats: DataFrame) -> DataFrame:
    """Dashboard row: requests, endpoints, mean p99, mean fail %, endpoint of the highest score."""
    return stats.agg(
        F.sum("count").alias("total_requests"), F.count(F.lit(1)).alias("total_endpoints"),
        F.avg(F.when(F.col("p99") > 0, F.col("p99"))).alias("avg_p99"), F.avg("fail_pct").alias("error_rate"),
        F.max_by("endpoint", F.struct("score", "endpoint")).alias("top_endpoint"), F.max("score").alias("max_score"),
    )


def compare_sessions(stats: DataFrame, base: str, other: str) -> DataFrame:
    """Endpoints of two sessions side by side; an endpoint of only one of them keeps nulls on the other side."""
    cols = ["count", "rps", "p99", "p95", "median", "score", "fail_pct"]

    def side(session: str, prefix: str) -> DataFrame:
        return stats.where(F.col("session_id") == session).select("endpoint", *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

    return side(base, "base").join(side(other, "other"), "endpoint", "full_outer")


def compare_flags(compared: DataFrame) -> DataFrame:
    """p99 ratio with its change in percent, regression / improvement flags and the high-impact mark."""
    ratio = F.col("other_p99") / F.col("base_p99")
    return (
        compared.withColumn("p99_ratio", ratio).withColumn("change_pct", F.round((ratio - 1) * 100, 1))
        .withColumn("is_regression", F.coalesce(ratio > 1.1, F.lit(False)))
        .withColumn("is_improvement", F.coalesce(ratio < 0.9, F.lit(False)))
        .withColumn("high_impact", F.coalesce(F.abs("change_pct") > 50, F.lit(False)))
    )


def latency_advice(stats: DataFrame) -> DataFrame:
    """What to look at next, as rows (rank, title, priority)."""
    flags = stats.agg(
        F.bool_or(F.col("p99") > 5000).alias("slow"), F.bool_or(F.col("fail_pct") > 10).alias("failing"),
        (F.count(F.lit(1)) > 100).alias("large"), (F.count(F.lit(1)) > 0).alias("any"),
    )

    def row(rank, title, priority):
        return F.struct(F.lit(rank).alias("rank"), F.lit(title).alias("title"), F.lit(priority).alias("priority"))

    rows = F.array_compact(F.array(
        F.when(~F.col("any"), row(0, "No durations loaded yet", "high")),
        F.when(F.col("slow"), row(1, "Slow requests found", "high")),
        F.when(F.col("failing"), row(2, "Many requests fail", "high")),
        F.when(F.col("large"), row(3, "Many endpoints: narrow the list", "medium")),
        F.when(F.col("any"), row(4, "Set this session against another", "medium")),
    ))
    return flags.select(F.explode(rows).alias("r")).select("r.*")


# Limits of the yellow and the red band.
BANDS = {"p99": (1000, 5000), "p95": (1000, 5000), "median": (1000, 5000), "fail_pct": (5, 10), "score": (1e6, 1e7)}


def metric_band(value: Column, metric: str) -> Column:
    if metric not in BANDS:
        return F.lit("none")
    warn, bad = BANDS[metric]
    return F.when(value > bad, "red").when(value > warn, "yellow").otherwise("green")
