"""Error detection: pattern matching, the full scan, grouping and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.error_rules import (
    candidate_line, error_patterns, first_pattern, is_false_positive, monitoring_source, relevant_components, unscannable,
)
from ..functions.fields import compute_once, field, parse_json
from ..functions.paths import node_of
from ..functions.severity import class_of, class_steps, component_by_path, quick_error
from ..functions.text import correlation_ids, error_signature, extract_ts, match_hash
from ..session import cut_lineage
from .blocks import block_format, error_blocks, stack_trace, trace_dialect

FILE = ["session_id", "path"]
SEVERITY_RANK = {"CRITICAL": 0, "ERROR": 1, "WARNING": 2}


def ranked_patterns(patterns: DataFrame) -> list:
    """The pattern table in match order. It is a reference table: a few hundred rows, never data."""
    rows = patterns.collect()
    return sorted(rows, key=lambda r: (-r.priority, SEVERITY_RANK.get(r.severity, 3), r.id))


def with_pattern(lines: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Lines with `rank`, the position of their best pattern in match order; null where nothing matches.

    Gate first, then the harmless-line filter, then the patterns: each stage sees only what the last let through.
    """
    spark = lines.sparkSession
    ranked = ranked_patterns(error_patterns(spark) if patterns is None else patterns)
    rows = compute_once(lines, _low=F.lower("content"))
    gate = candidate_line([r.pattern for r in ranked], "content", "_low") & ~unscannable(F.col("path"))
    rows = compute_once(rows, _candidate=gate)
    rows = compute_once(rows, _candidate=F.when(F.col("_candidate"), ~is_false_positive("content", "_low")).otherwise(False))
    rows = compute_once(rows, _relevant=F.when(F.col("_candidate"), relevant_components(F.col("path"))))
    # critical patterns apply to every file
    chain = [(r.pattern, None if r.severity == "CRITICAL" else r.component) for r in ranked]
    rank = F.when(F.col("_candidate"), first_pattern(chain, "content", "_low", "_relevant"))
    return compute_once(rows, rank=rank).drop("_candidate", "_relevant", "_low")


def with_pattern_info(matches: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Replace `rank` by the columns of the pattern; the table is small and broadcast."""
    spark = matches.sparkSession
    ranked = ranked_patterns(error_patterns(spark) if patterns is None else patterns)
    rows = [(i, r.id, r.component, r.category, r.severity, r.description or r.pattern[:100]) for i, r in enumerate(ranked)]
    schema = "rank int, pattern_id string, component string, category string, severity string, description string"
    return matches.join(F.broadcast(spark.createDataFrame(rows, schema)), "rank").drop("rank")


def match_patterns(lines: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Matching lines with their best pattern: highest priority, then severity, then id."""
    return with_pattern_info(with_pattern(lines, patterns).where("rank is not null"), patterns)


# messages and metadata ----------------------------------------------------------------------------

# Words that say nothing as a message, and the extractor per pattern family, in order.
NOISE = ["bulk_exception", "exception", "error"]
EXTRACTORS = [
    ("ssl", r"(?:error|failed):\s*(.+?)(?:\n|$)"), ("timeout", r"timeout.*?:\s*(.+?)(?:\n|$)"),
    ("connection", r"connection.*?:\s*(.+?)(?:\n|$)"), ("postgres", r"ERROR:\s*(.+?)(?:\n|$)"),
    ("grpc", r'desc\s*=\s*"?([^"]+)"?'), ("redis", r"(?:Redis|REDIS).*?:\s*(.+?)(?:\n|$)"),
    ("sidekiq", r"(?:failed|error):\s*(.+?)(?:\n|$)"),
]
GENERIC_EXTRACTORS = [
    r"(?:ERROR|FATAL|CRITICAL|error|fail)[:\s]+(.+?)(?:\n|$)", r"message[:\s]+[\"']*([^\"']+)", r"msg[:\s]+[\"']*([^\"']+)",
]


def _group1(text: Column, pattern: str, flags: str = "(?i)") -> Column:
    return F.when(text.rlike(flags + pattern), F.regexp_extract(text, flags + pattern, 1))


def clean_message(content: Column, fields: Column | str, block: Column, pattern_id: Column, component: Column, description: Column) -> Column:
    """Readable message: JSON fields, JSON of the block's lines, the extractor of the family, a general one, the description."""
    useful = lambda c: F.when(~c.isin(NOISE) & (c != ""), c)
    raised, told = field("exception.class", fields), field("exception.message", fields)
    own = F.coalesce(*[F.nullif(c, F.lit("")) for c in (
        told, field("error_message", fields), raised, field("error", fields), field("msg", fields), field("message", fields))])
    nearby = F.transform(
        block,
        lambda line: F.coalesce(*[field(n, parse_json(line)) for n in ("error_message", "exception.message", "error")]),
    )
    nearby = F.get(F.filter(nearby, lambda m: m.isNotNull() & ~m.isin(NOISE) & (m != "")), 0)
    nearby = F.when(F.size(block) > 1, nearby)
    family = [
        F.when(F.lower(F.concat_ws(" ", pattern_id, component)).contains(key), F.trim(_group1(content, rx))) for key, rx in EXTRACTORS
    ]
    generic = [F.trim(_group1(content, rx)) for rx in GENERIC_EXTRACTORS]
    return F.coalesce(
        F.when((raised != "") & (told != ""), F.concat(raised, F.lit(": "), told)), useful(own), nearby, *family, *generic, description
    )


IDS = ["correlation_id", "request_id", "user_id", "project_id", "job_id", "trace_id"]


def error_meta(content: Column, fields: Column | str, block: Column) -> Column:
    """Struct of six ids and `error_code`: JSON, then the text of the line, then the lines of the block."""

    def in_block(pattern: str) -> Column:
        return F.get(F.filter(F.transform(block, lambda line: _group1(line, pattern, "")), lambda x: x.isNotNull()), 0)

    # How ids and codes stand in a line.
    id_text = r'[=:]\s*"?([a-zA-Z0-9\-_]+)"?'
    out = []
    for name in IDS:
        value = field(name, fields)
        if name in ("correlation_id", "request_id"):
            value = F.coalesce(_group1(content, name + id_text), value)
        if name == "correlation_id":
            value = F.coalesce(value, in_block(name + id_text))
        out.append(value.alias(name))
    code = F.coalesce(
        _group1(content, r"\b([45]\d{2})\s+(?:Error|Bad|Not)"), field("code", fields), field("status", fields),
        field("grpc.code", fields), in_block(r"\b([45]\d{2})\s+"),
    )
    return F.struct(*out, code.alias("error_code"))


def related_counts(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """Matches with `related`: lines of the same file that carry the same correlation id. Of all lines' ids, only those of matches go
    into the count."""
    wanted = cut_lineage(matches.where("correlation_id IS NOT NULL").select(*FILE, "correlation_id").distinct())
    ids = lines.select(*FILE, F.explode(correlation_ids(F.col("content"), wide=True)).alias("correlation_id"))
    counts = ids.join(wanted, [*FILE, "correlation_id"], "left_semi").groupBy(*FILE, "correlation_id").agg(F.count(F.lit(1)).alias("related"))
    return matches.join(counts, [*FILE, "correlation_id"], "left").withColumn("related", F.coalesce("related", F.lit(0).cast("bigint")))


def scan_errors(lines: DataFrame, patterns: DataFrame | None = None, related: bool = True) -> DataFrame:
    """Full scan: excluded files, gate, harmless lines, best pattern, block, message, ids, trace."""
    rows = lines.select(*FILE, "line_no", "content")
    hits = error_blocks(with_pattern(rows, patterns), F.col("rank").isNotNull(), rows, first_only=True)
    hits = with_pattern_info(hits, patterns)
    hits = compute_once(hits, fields=parse_json(F.col("content")))
    fmt = block_format(F.col("content"))
    hits = (
        hits.withColumn("format", fmt)
        .withColumn("_meta", error_meta(F.col("content"), "fields", F.col("block")))
        .withColumn("message", clean_message(F.col("content"), "fields", *[F.col(c) for c in ("block", "pattern_id", "component", "description")]))
        .select("*", "_meta.*").drop("_meta", "covered")
        .withColumn("stack_trace", stack_trace(F.col("block"), F.coalesce(trace_dialect(F.col("block")), F.col("format"))))
        .withColumn("ts", extract_ts(F.col("content"))).withColumn("node", node_of(F.col("path")))
        .withColumn("monitoring", monitoring_source())
        .withColumn("signature", error_signature(F.col("pattern_id"), F.col("message")))
        .withColumn("match_hash", match_hash(F.col("component"), F.col("pattern_id"), F.col("message")))
    )
    return related_counts(cut_lineage(hits), rows) if related else hits


# groups and reports -------------------------------------------------------------------------------


def error_groups(matches: DataFrame, samples: int = 3) -> DataFrame:
    """One row per signature: count, first message, flags, files touched, and the first `samples` matches.

    Counts combine map-side. Samples are ranked, and the rank limit is applied before the shuffle, so a
    signature that owns most rows sends a few per task.
    """
    where = F.struct("session_id", "path", "line_no")
    first = F.struct(where.alias("at"), "message", "severity", "component", "pattern_id")
    per_file = matches.groupBy("signature", "session_id", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min(first).alias("_first"),
        F.bool_or(F.col("correlation_id").isNotNull()).alias("_c"), F.bool_or(F.col("stack_trace").isNotNull()).alias("_s"),
    )
    per = per_file.groupBy("signature").agg(
        F.sum("n").alias("count"), F.min("_first").alias("_first"), F.bool_or("_c").alias("has_correlation"),
        F.bool_or("_s").alias("has_stack_trace"), F.count(F.lit(1)).alias("file_count"),
    )
    per = per.select("signature", "count", *[F.col(f"_first.{c}").alias(c) for c in ("message", "severity", "component", "pattern_id")], "has_correlation", "has_stack_trace", "file_count")
    order = Window.partitionBy("signature").orderBy("session_id", "path", "line_no")
    head = matches.select("signature", "session_id", "path", "line_no", "message", "content").withColumn("_r", F.row_number().over(order))
    head = head.where(F.col("_r") <= samples).groupBy("signature").agg(
        F.array_sort(F.collect_list(F.struct("session_id", "path", "line_no", "message", "content"))).alias("samples")
    )
    return per.join(head, "signature")


def error_group_files(matches: DataFrame) -> DataFrame:
    """Files of each group with their counts, one row each (a group may touch any number of files)."""
    return matches.groupBy("signature", "session_id", "path").agg(F.count(F.lit(1)).alias("count"))


def error_counts(matches: DataFrame, by: str) -> DataFrame:
    return matches.groupBy(by).agg(F.count(F.lit(1)).alias("count"))


def top_groups(groups: DataFrame, k: int = 10) -> DataFrame:
    return groups.orderBy(F.desc("count"), "signature").limit(k)


def error_report(matches: DataFrame) -> dict[str, DataFrame]:
    """Everything that is shown of a scan. The matches, a small part of the lines, are written once and read by each part."""
    matches = cut_lineage(matches.drop("fields"))
    groups = error_groups(matches)
    return {
        "groups": groups, "files": error_group_files(matches), "by_severity": error_counts(matches, "severity"),
        "by_component": error_counts(matches, "component"), "top": top_groups(groups),
    }


def problem_groups(groups: DataFrame) -> DataFrame:
    """Second level: component, severity and message without its variables; counts add up."""
    # What varies in a message.
    text = F.regexp_replace("message", r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}", "TIMESTAMP")
    text = F.regexp_replace(text, r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "UUID")
    text = F.regexp_replace(text, r"\b\d+\b", "N")
    return groups.groupBy("component", "severity", text.alias("text")).agg(
        F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("problems"),
        F.min_by("message", "signature").alias("message"), F.bool_or("has_correlation").alias("has_correlation"),
    )


def filter_problems(
    problems: DataFrame, severity: str | None = None, component: str | None = None, text: str | None = None,
    min_count: int = 1, monitoring: bool | None = None,
) -> DataFrame:
    tests = []
    if severity:
        tests.append(F.upper("severity") == severity.upper())
    if component:
        tests.append(F.col("component") == component)
    if text:
        tests.append(F.contains(F.lower(F.concat_ws(" ", "message", "component")), F.lit(text.lower())))
    if min_count > 1:
        tests.append(F.col("count") >= min_count)
    if monitoring is not None:
        is_monitoring = F.lower("component").contains("monitoring")
        tests.append(is_monitoring if monitoring else ~is_monitoring)
    return problems.where(reduce(lambda a, b: a & b, tests)) if tests else problems


def split_monitoring(problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regular, monitoring) problems."""
    return filter_problems(problems, monitoring=False), filter_problems(problems, monitoring=True)


def classified_lines(lines: DataFrame) -> DataFrame:
    """Lines with their class; `component` decides which rules apply."""
    rows = compute_once(lines, _low=F.lower("content"))
    for name, step in class_steps().items():
        rows = compute_once(rows, **{name: F.expr(step)})
    return rows.select(*lines.columns, *class_of())


def error_summary(classified: DataFrame, k: int = 10) -> DataFrame:
    """Rows (part, key, value): total and rate of errors, counts by severity and category, top k matched rules.

    Everything comes from one aggregate over (severity, category, matched).
    """
    base = classified.groupBy("is_error", "severity", "category", "matched").agg(F.count(F.lit(1)).alias("n"))
    errors = base.where("is_error")
    total = base.agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("is_error"), F.col("n")).otherwise(0)).alias("errors"))

    def part(df, name, key):
        return df.groupBy(F.lit(name).alias("part"), F.col(key).alias("key")).agg(F.sum("n").cast("double").alias("value"))

    rate = F.round(F.when(F.col("lines") > 0, F.col("errors") / F.col("lines") * 100).otherwise(0.0), 2)
    head = total.select(F.explode(F.array(
        F.struct(F.lit("total").alias("part"), F.lit("errors").alias("key"), F.col("errors").cast("double").alias("value")),
        F.struct(F.lit("total").alias("part"), F.lit("rate").alias("key"), rate.alias("value")),
    )).alias("r")).select("r.*")
    top = part(errors, "pattern", "matched").orderBy(F.desc("value"), "key").limit(k)
    return head.unionByName(part(errors, "severity", "severity")).unionByName(part(errors, "category", "category")).unionByName(top)


def quick_scan(lines: DataFrame) -> DataFrame:
    return lines.where(quick_error(F.col("content"))).select(*FILE, "line_no")


def detect_component(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """Component per file: by path, else by flags over its lines, or over the first `sample` of them."""
    content = F.col("content")
    flags = _first(lines, sample).groupBy(*FILE).agg(
        F.bool_or(content.rlike('"severity"|"level"')).alias("is_json"),
        F.bool_or(F.lower(content).contains("sidekiq")).alias("sidekiq"),
        F.bool_or(F.lower(content).contains("gitaly")).alias("gitaly"),
        F.bool_or(content.rlike("LOG:|ERROR:|FATAL:")).alias("postgres"),
    )
    by_content = F.when(
        F.col("is_json"), F.when(F.col("sidekiq"), "sidekiq").when(F.col("gitaly"), "gitaly").otherwise("gitlab-rails")
    ).when(F.col("postgres"), "postgresql").otherwise("unknown")
    return flags.select(*FILE, F.coalesce(component_by_path(F.col("path")), by_content).alias("component"))


def _first(lines: DataFrame, sample: int | None) -> DataFrame:
    return lines if sample is None else lines.where(F.col("line_no") <= sample)


def detect_format(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """Log format per file from its lines, or the first `sample` of them: json (> 70 %), structured (key=value, > 50 %) or plain."""
    text = F.trim("content")
    is_json = text.startswith("{") & text.endswith("}") & parse_json(F.col("content")).isNotNull()
    counts = _first(lines, sample).where(text != "").groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(is_json).alias("_json"),
        F.count_if(text.contains("=") & ~text.startswith("{")).alias("_kv"),
    )
    fmt = F.when(F.col("_json") > F.col("_n") * 0.7, "json").when(F.col("_kv") > F.col("_n") * 0.5, "structured").otherwise("plain")
    return counts.select(*FILE, fmt.alias("format"))
