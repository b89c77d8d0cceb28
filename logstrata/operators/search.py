"""Search over lines: hits, context, limits, sorting, time range, histogram, spikes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.predicates import contains, java_regex, valid_regex
from .ordered import near

FILE = ["session_id", "path"]


def slice_lines(lines: DataFrame, session_id: str, path: str, start: int, end: int) -> DataFrame:
    """Lines [start, end) of one file, 1-based; three comparisons that reach the parquet scan."""
    return lines.where(
        (F.col("session_id") == session_id) & (F.col("path") == path)
        & (F.col("line_no") >= start) & (F.col("line_no") < end)
    )


def select_files(
    files: DataFrame,
    sessions: list[str] | None = None,
    components: list[str] | None = None,
    log_types: list[str] | None = None,
    path_parts: list[str] | None = None,
) -> DataFrame:
    """Files that satisfy every given filter; path parts are case-insensitive and any of them counts."""
    for column, values in (("session_id", sessions), ("component", components), ("log_type", log_types)):
        if values:
            files = files.where(F.col(column).isin(values))
    if path_parts:
        files = files.where(F.lower("path").rlike("|".join(re.escape(p.lower()) for p in path_parts)))
    return files


def keep_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    return lines.join(files.select(*FILE), FILE, "left_semi")


def drop_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    return lines.join(files.select(*FILE), FILE, "left_anti")


def with_file_info(lines: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """Attach catalogue columns. The catalogue has one row per file; the planner broadcasts it when its size allows."""
    return lines.join(files.select(*FILE, *columns), FILE, "left")


def with_context(lines: DataFrame, n: int, hit: Column) -> DataFrame:
    """Hits with the `n` lines before and after them in `context_before` / `context_after`.

    Hits come first, as places without text. A second scan keeps the lines of small stretches of a file that hold a hit's
    surroundings, and only those are shuffled.
    """
    at = lines.where(hit).select(*FILE, F.col("line_no").alias("hit"), F.greatest(F.col("line_no") - n, F.lit(1)).alias("first"), (F.col("line_no") + n).alias("last"))
    rows = near(lines, at, piece=max(16, 2 * n)).withColumn("line", F.struct("line_no", "content"))
    own = F.struct(*[F.col(c) for c in lines.columns])
    around = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("line")))).getField("content")
    found = rows.groupBy(*FILE, "hit").agg(
        F.first(F.when(F.col("line_no") == F.col("hit"), own), ignorenulls=True).alias("own"),
        around(F.col("line_no") < F.col("hit")).alias("context_before"), around(F.col("line_no") > F.col("hit")).alias("context_after"),
    )
    return found.select("own.*", "context_before", "context_after")


def limit_hits(hits: DataFrame, n: int) -> DataFrame:
    """First n hits in file, then line order (a top-n, not a full sort)."""
    return hits.orderBy(*FILE, "line_no").limit(n)


def sort_hits(hits: DataFrame, name: str, asc: bool = True) -> DataFrame:
    """Hits by a field: numbers first by value, then text by lower case; missing counts as ''."""
    text = F.coalesce(field(name), F.lit(""))
    number = text.try_cast("double")
    keys = [number.isNull(), number, F.lower(text)]
    keys = [keys[0].asc(), *(k.asc() if asc else k.desc() for k in keys[1:])]
    return hits.orderBy(*keys, *FILE, "line_no")


def between_times(hits: DataFrame, start, end) -> DataFrame:
    """Hits whose `ts` lies in [start, end]; hits without a timestamp stay."""
    ts = F.col("ts")
    bounds = [b for b in (start is not None and (ts >= F.lit(start)), end is not None and (ts <= F.lit(end))) if b is not False]
    return hits.where(ts.isNull() | reduce(lambda a, b: a & b, bounds)) if bounds else hits


# Parts of paths that hold no logs.
NOT_LOGS = ["migrations", "schema", "_dump", "_info", "_check", "systemctl", "proc/", "etc/", ".conf", ".yml", ".yaml"]
# Words per severity filter.
SEVERITY_WORDS = {"error": "error|fail|exception", "warning": "warn", "critical": "critical|fatal|panic"}


def simple_search(
    lines: DataFrame, text: str, service: str | None = None, severity: str | None = None, limit: int | None = None
) -> DataFrame:
    """Lines with a substring, by service substring and severity words; `lines` carries `service`."""
    out = lines.where(~F.lower("path").rlike("|".join(re.escape(p) for p in NOT_LOGS)))
    if service:
        out = out.where(F.contains(F.lower("service"), F.lit(service.lower())))
    out = out.where(contains(text))
    if severity in SEVERITY_WORDS:  # other words filter nothing
        out = out.where(F.lower("content").rlike(SEVERITY_WORDS[severity]))
    return limit_hits(out, limit) if limit else out


@dataclass(frozen=True)
class GrepStep:
    pattern: str
    inverse: bool = False
    ignore_case: bool = True
    is_regex: bool = True


def grep_condition(steps: list[GrepStep]) -> Column:
    def one(step: GrepStep) -> Column:
        pattern = java_regex(step.pattern) if step.is_regex else re.escape(step.pattern)
        found = F.col("content").rlike(("(?iu)" if step.ignore_case else "") + pattern)
        return ~found if step.inverse else found

    return reduce(lambda a, b: a & b, [one(s) for s in steps])


def grep_pipeline(lines: DataFrame, steps: list[GrepStep]) -> DataFrame:
    """Lines on which every step holds."""
    return lines.where(grep_condition(steps))


# Words a query is widened to, by the word it contains.
EXPANSIONS = [
    ("error", ["ERROR", "FAIL", "Exception"]),
    ("timeout", ["timeout", "timed out", "deadline exceeded"]),
    ("connection", ["connection", "connect", "refused", "lost"]),
]


def smart_search(lines: DataFrame, text: str) -> DataFrame:
    """Hits of the widened query with a `bucket`: critical, error, warning or other."""
    words = next((ws for key, ws in EXPANSIONS if key in text.lower()), [text])
    low = F.lower("content")
    bucket = (
        F.when(low.rlike("panic|fatal|critical"), "critical").when(low.rlike("error|fail"), "error")
        .when(low.contains("warn"), "warning").otherwise("other")
    )
    pattern = "|".join(w.lower() for w in words)
    found = low.rlike(java_regex(pattern)) if valid_regex(pattern) else low.contains(pattern)
    return lines.where(found).withColumn("bucket", bucket)


def trace_text(lines: DataFrame, wanted: str, context: int = 2) -> DataFrame:
    """Any id as text: hits with context, file by file."""
    return with_context(lines, context, contains(wanted))


def union_hits(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


# time histogram -----------------------------------------------------------------------------------


def hit_severity(status: Column, exception: Column, severity: Column) -> Column:
    """error / warning / info: HTTP status first, then an exception, then the severity word."""
    status = status.try_cast("double")
    low = F.lower(F.coalesce(severity, F.lit("")))
    return (
        F.when((status >= 500) | exception.isNotNull(), "error").when(status >= 400, "warning")
        .when(low.rlike("error|fatal"), "error").when(low.contains("warn"), "warning").otherwise("info")
    )


def time_histogram(hits: DataFrame, buckets: int = 50) -> DataFrame:
    """Counts per severity in `buckets` equal slices between the first and last `ts`; empty slices are kept.

    `hits` has `ts` and `level`. The time range is a scalar subquery: one value, computed once.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    points = hits.where("ts is not null").select(micros.alias("_t"), "level")
    low, high = F.min("_t"), F.max("_t")
    width = F.when(high > low, (high - low) / buckets).otherwise(F.lit(1000.0))
    span = points.agg(F.struct(low.alias("lo"), width.alias("w")).alias("span")).scalar()
    placed = points.withColumn("_s", span)
    slot = F.least(F.floor((F.col("_t") - F.col("_s.lo")) / F.col("_s.w")), F.lit(buckets - 1))
    counts = placed.groupBy(slot.alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
        F.count_if(F.col("level") == "info").alias("info"),
    )
    every = hits.sparkSession.range(buckets).select(F.col("id").alias("bucket"), span.alias("_s")).where("_s.lo is not null")
    start = F.floor(F.col("_s.lo") + F.col("bucket") * F.col("_s.w")).cast("bigint")
    return every.join(counts, "bucket", "left").select(
        "bucket", F.timestamp_micros(start).alias("start"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total", "errors", "warnings", "info")],
    )


def spikes(histogram: DataFrame, k: float = 2, min_count: int = 5) -> DataFrame:
    """Buckets above mean + k population standard deviations over all buckets, and above `min_count`."""
    limit = histogram.agg((F.avg("total") + k * F.stddev_pop("total")).alias("limit")).scalar()
    high = histogram.withColumn("_limit", limit).where((F.col("total") > F.col("_limit")) & (F.col("total") > min_count))
    return high.drop("_limit").orderBy("bucket")
