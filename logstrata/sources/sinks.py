"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.paths import basename


def write_ndjson(hits: DataFrame, path: str) -> None:
    """One JSON object per line and hit, written in parallel."""
    hits.drop("fields").write.mode("overwrite").json(path)


def csv_rows(hits: DataFrame, fields: list[str]) -> DataFrame:
    """File name, line number and the chosen fields of each hit as text."""
    return hits.select(basename(F.col("path")).alias("file"), F.col("line_no").alias("line"), *[F.coalesce(field(f), F.lit("")).alias(f.replace(".", "_")) for f in fields])


def export_csv(hits: DataFrame, fields: list[str], path: str) -> None:
    """Quotes inside a value are doubled."""
    csv_rows(hits, fields).write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)


def export_stats(stats: DataFrame, path: str, fmt: str = "json") -> None:
    """Endpoint statistics as JSON or as flat CSV."""
    writer = stats.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", "true").option("escape", '"').csv(path)


def export_text(lines: DataFrame, path: str) -> None:
    """Filtered lines as text in file and line order: range-sorted, so the parts concatenate in order."""
    lines.orderBy("session_id", "path", "line_no").select("content").write.mode("overwrite").text(path)
