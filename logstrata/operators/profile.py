"""Profiles of lines and files: fields, levels, counts, catalogues, suggested filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import TYPES, field, flatten_fields, kv_pairs, with_fields
from ..functions.paths import basename
from ..session import cut_lineage

FILE = ["session_id", "path"]


def line_fields(lines: DataFrame) -> DataFrame:
    """One row per field occurrence: JSON fields of JSON lines, key=value pairs of the others."""
    parsed = with_fields(lines)
    json_rows = flatten_fields(parsed).where(~F.col("field").endswith("_concat")).select(*FILE, "field", "type", "text")
    pairs = F.when(F.col("fields").isNull(), kv_pairs(F.col("content")))
    text_rows = parsed.select(*FILE, F.explode(pairs).alias("_p")).select(
        *FILE, F.col("_p.key").alias("field"), F.col("_p.type").alias("type"), F.col("_p.value").alias("text")
    )
    return json_rows.unionByName(text_rows)


LONG = 100


def _value_counts(lines: DataFrame) -> DataFrame:
    """Occurrences per (field, type, sample value): the one wide shuffle of a profile, combined map-side. Long values are counted by
    their hash; `value` has their first LONG characters and `key` the hash, so no row is wide."""
    text = F.when(F.col("type").isin("string", "number", "boolean"), F.col("text"))
    long = F.length(text) >= LONG
    rows = line_fields(lines).select("field", "type", F.substring(text, 1, LONG).alias("value"), F.when(long, F.sha2(text, 256)).alias("key"))
    return rows.groupBy("field", "type", "value", "key").agg(F.count(F.lit(1)).alias("n"))


def top_values(field_values: DataFrame, k: int = 10) -> DataFrame:
    """k most frequent values per field; ties by value, of long ones by their beginning and hash. The rank limit is applied before the
    shuffle."""
    by_value = field_values.where("value is not null").groupBy("field", "value", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value", "key")
    return by_value.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_whole_values(top: DataFrame, lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """top_values with the whole text of long values, which a second scan fetches if there are any; a row for each of k per field."""
    top = cut_lineage(top, tasks)
    if top.where("key IS NOT NULL").isEmpty():
        return top
    found = line_fields(lines).where(F.length("text") >= LONG).select("field", F.sha2("text", 256).alias("key"), "text")
    whole = found.join(top.select("field", "key"), ["field", "key"], "left_semi").groupBy("field", "key").agg(F.first("text").alias("text"))
    return top.join(whole, ["field", "key"], "left").withColumn("value", F.coalesce("text", "value")).drop("text")


def discover_fields(lines: DataFrame, k: int = 10, tasks: int | None = None) -> DataFrame:
    """Per field: count, majority type, top-k sample values and whether more than 10 % of the lines have it. The counts are merged by
    `tasks` tasks."""
    counts = cut_lineage(_value_counts(lines), tasks)
    votes = counts.groupBy("field", "type").agg(F.sum("n").alias("n"))
    per_field = votes.groupBy("field").agg(
        F.sum("n").alias("count"), F.max_by("type", F.struct("n", "type")).alias("type")
    )
    samples = with_whole_values(top_values(counts, k), lines, tasks).groupBy("field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
    )
    total = lines.agg(F.count(F.lit(1)).alias("lines")).scalar()
    return per_field.join(samples, "field", "left").select(
        "field", "type", "count", "sample_values", (F.col("count") > total * 0.1).alias("is_common")
    )


def field_counts(lines: DataFrame) -> DataFrame:
    """Occurrences per (file, field, text), with the place of the first type in TYPES: a number, which is kept in a hash table, while rows
    are sorted for the least of texts."""
    place = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type")).cast("int")
    return line_fields(lines).groupBy(*FILE, "field", "text").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("type"))


def field_profile(lines: DataFrame, k: int = 20, tasks: int | None = None) -> DataFrame:
    """Per file and field: first type, count, whether null occurs, distinct values, up to `k` samples in text order. The counts are merged
    by `tasks` tasks, so give more for more lines."""
    counts = cut_lineage(field_counts(lines), tasks)
    order = Window.partitionBy(*FILE, "field").orderBy("text")
    head = counts.where("text is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    samples = head.groupBy(*FILE, "field").agg(F.array_sort(F.collect_list("text")).alias("samples"))
    found = counts.groupBy(*FILE, "field").agg(
        F.sum("n").alias("count"), F.min(F.when(F.col("text").isNotNull(), F.col("type"))).alias("type"),
        F.bool_or(F.col("text").isNull()).alias("nullable"), F.count("text").alias("distinct_values"),
    )
    name = F.get(F.array(*[F.lit(t) for t in TYPES]), F.col("type") - 1)
    return found.withColumn("type", name).join(samples, [*FILE, "field"], "left")


def file_metadata(lines: DataFrame) -> DataFrame:
    """Per file: lines, characters, share of JSON lines, top-level fields by name and the JSON verdict."""
    parsed = with_fields(lines)
    is_json = F.col("fields").isNotNull()
    base = parsed.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("total_lines"), F.sum(F.length("content") + 1).alias("size"),
        F.count_if(is_json).alias("json_lines"),
    )
    keys = F.map_keys(F.try_variant_get("fields", "$", "map<string,variant>"))
    names = parsed.where(is_json).select(*FILE, F.explode(keys).alias("field")).distinct()
    fields = names.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("field_count"), F.array_sort(F.collect_list("field")).alias("detected_fields"),
    )
    ratio = F.col("json_lines") / F.col("total_lines")
    verdict = (
        (ratio > 0.1) | F.contains(F.lower("path"), F.lit("json"))
        | ((F.col("json_lines") > 5) & (F.col("field_count") > 3))
    )
    return base.join(fields, FILE, "left").withColumn("json_ratio", ratio).withColumn(
        "is_json", F.coalesce(verdict, F.lit(False))
    )


def line_level(content: Column) -> Column:
    """Viewer level of a line: words first, then the JSON severity."""
    low = F.lower(content)
    severity = F.upper(field("severity"))
    by_word = F.when(low.rlike(" error | error:| fail |exception"), "error").when(low.rlike(" warn | warning"), "warning")
    by_word = by_word.when(low.contains(" info "), "info").when(low.contains(" debug "), "debug")
    by_json = F.when(severity.isin("ERROR", "FATAL"), "error").when(severity.isin("WARN", "WARNING"), "warning")
    by_json = by_json.when(severity == "INFO", "info").when(severity == "DEBUG", "debug")
    return F.coalesce(by_word, by_json, F.lit("default"))


def level_counts(lines: DataFrame) -> DataFrame:
    parsed = with_fields(lines).withColumn("level", line_level(F.col("content")))
    return parsed.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("level") == v).alias(v) for v in ("error", "warning", "info")]
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines per file, with the total of the session on every row."""
    per_file = lines.groupBy(*FILE).agg(F.count(F.lit(1)).alias("line_count"))
    return per_file.withColumn("session_lines", F.sum("line_count").over(Window.partitionBy("session_id")))


def session_catalog(files: DataFrame) -> DataFrame:
    """Per session: files, bytes and the components in it (a closed, small set)."""
    return files.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.array_sort(F.collect_set("component")).alias("components"),
    )


def _with_samples(files: DataFrame, key: str, k: int) -> DataFrame:
    """Catalogue by `key` with the first k file names by order; ranks are cut before the shuffle."""
    names = files.select(key, "path").distinct()
    order = Window.partitionBy(key).orderBy("path")
    head = names.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return head.groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("sample_files"))


def component_catalog(files: DataFrame) -> DataFrame:
    per = files.groupBy("component").agg(
        F.count(F.lit(1)).alias("file_count"), F.countDistinct("session_id").alias("session_count")
    )
    return per.join(_with_samples(files, "component", 5), "component")


def log_type_catalog(files: DataFrame) -> DataFrame:
    """Log types by file count; a file without a type is named after its component and file name."""
    unnamed = F.concat(F.initcap("component"), F.lit(" - "), basename(F.col("path")))
    named = files.withColumn("name", F.coalesce("log_type", unnamed)).withColumn(
        "format", F.when(F.col("log_type").isNull(), "unknown").otherwise(F.col("format"))
    )
    per = named.groupBy("name").agg(
        F.first("component").alias("component"), F.first("format").alias("format"),
        F.count(F.lit(1)).alias("file_count"), F.countDistinct("session_id").alias("session_count"),
    )
    return per.join(_with_samples(named, "name", 3), "name").orderBy(F.desc("file_count"), "name")


# Fields that tell errors or durations.
ERROR_FIELDS = ["severity", "level", "status", "error", "exception", "TYPE", "REASON"]
DURATION_FIELDS = ["duration", "elapsed", "response_time", "time_ms", "duration_s"]


def suggest_filters(field_stats: DataFrame) -> DataFrame:
    """Filters worth offering, from the fields and their top values, as rows (rank, name, field, operator, value).

    `field_stats` is the result of `discover_fields`. One aggregate folds it to a single row of findings.
    """
    name, samples = F.col("field"), F.col("sample_values")
    bad = F.get(F.filter(samples, lambda v: F.lower(v).rlike("error|fail|critical|warning")), 0)
    fails = F.get(F.filter(samples, lambda v: F.lower(v).contains("fail")), 0)
    slow_rank = F.array_position(F.array(*[F.lit(f) for f in DURATION_FIELDS]), name)
    found = field_stats.agg(
        F.array_sort(F.collect_list(F.when(name.isin(ERROR_FIELDS) & bad.isNotNull(), F.struct("field", bad.alias("value"))))).alias("errors"),
        F.bool_or(name.isin("status", "status_code")).alias("status"),
        F.min_by("field", F.when(name.isin(DURATION_FIELDS), slow_rank)).alias("slow"),
        F.max(F.when(name == "service", samples)).alias("services"),
        F.bool_or((name == "TYPE") & F.array_contains(samples, "Warning")).alias("warnings"),
        F.max(F.when(name == "REASON", fails)).alias("reason"),
        F.bool_or(name.isin("severity", "level")).alias("levels"),
    )

    def row(rank, title, fld, op, value):
        cells = [c if isinstance(c, Column) else F.lit(c) for c in (title, fld, op, value)]
        return F.struct(
            F.lit(rank).alias("rank"), cells[0].alias("name"), cells[1].alias("field"), cells[2].alias("operator"),
            cells[3].cast("string").alias("value"),
        )

    def when(test, *rows):
        return F.when(test, F.array(*rows))

    parts = [
        F.transform("errors", lambda e: row(1, F.concat(F.initcap(e["field"]), F.lit(": errors")), e["field"], ":", e["value"])),
        when(F.col("status"), row(2, "Requests that failed on the server", "status", ">=", 500), row(3, "Requests refused as wrong", "status", "400..499", None)),
        when(F.col("slow").isNotNull(), row(4, "Requests over one second", F.col("slow"), ">", F.when(F.col("slow").contains("ms"), 1000).otherwise(1))),
        F.transform("services", lambda v: row(5, F.concat(F.initcap(v), F.lit(": this service only")), "service", ":", v)),
        when(F.col("warnings"), row(6, "Cluster events of type Warning", "TYPE", ":", "Warning")),
        when(F.col("reason").isNotNull(), row(7, "Events of failing pods", "REASON", ":", F.col("reason"))),
        when(F.col("levels"), row(8, "Without debug lines", "level", "!=", "debug")),
        F.array(row(9, "Everything of rails", "service", ":", "rails:*"), row(10, "Everything of the workers", "service", ":", "*worker*")),
    ]
    return found.select(F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("r")).select("r.*")
