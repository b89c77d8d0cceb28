"""Line sources: text files of any size, the file catalogue, and the lines table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import component_of, file_type, is_log_file, log_type_of, service_of, suitable
from ..operators.ordered import number_rows
from ..session import cut_lineage


def split_path(uri: Column, root: str) -> tuple[Column, Column]:
    """(session_id, path) of a file below `root`: the first directory is the session, the rest the path."""
    below = F.substring_index(uri, "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return F.substring_index(below, "/", 1), F.regexp_replace(below, r"^[^/]*/", "")


def number_lines(raw: DataFrame, root: str) -> DataFrame:
    """Lines table from rows (value, uri, block): `block` is the offset of the split a line was read from.

    Lines are numbered per split and the splits of a file are chained by their line counts, so a file of
    any size is read and numbered in parallel.
    """
    session, path = split_path(F.col("uri"), root)
    # within a split rows come in file order, which the increasing id keeps
    rows = raw.withColumn("_seq", F.monotonically_increasing_id())
    numbered = number_rows(rows, ["uri"], ["_seq"], F.col("block"), "line_no", sizes_from=raw.select("uri", "block"))
    return numbered.select(session.alias("session_id"), path.alias("path"), "line_no", F.col("value").alias("content"))


def raw_lines(reader, root: str) -> DataFrame:
    text = reader.option("recursiveFileLookup", "true").format("text").load(root)
    uri = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return text.select("value", uri.alias("uri"), F.col("_metadata.file_block_start").alias("block"))


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines (session_id, path, line_no, content) of every file below `root/<session>/`.

    Undecodable bytes do not fail; blank lines are numbered; gzip and bzip2 files are decompressed by suffix.
    """
    return number_lines(raw_lines(spark.read, root), root)


def catalog_files(spark: SparkSession, root: str, logs_only: bool = True) -> DataFrame:
    """One row per file with what its path says. Only metadata is read, no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    session, path = split_path(F.col("path"), root)
    files = describe_files(found.select(session.alias("session_id"), path.alias("path"), F.col("length").alias("size")))
    return files.where(is_log_file(F.concat(F.lit("/"), "path"))) if logs_only else files


def describe_files(files: DataFrame) -> DataFrame:
    """Add service, component, log_type, format, file_type and is_suitable to (session_id, path, size)."""
    p = F.col("path")
    kind = files.withColumn("_k", log_type_of(p))
    return kind.select(
        *files.columns, service_of(p).alias("service"), service_of(p, "catalog").alias("catalog_service"),
        F.coalesce("_k.component", component_of(p)).alias("component"), F.col("_k.log_type").alias("log_type"),
        F.coalesce("_k.format", F.lit("unknown")).alias("format"), file_type(p).alias("file_type"), suitable(p).alias("is_suitable"),
    )


def split_suitable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to analyse, static files)."""
    return files.where("is_suitable"), files.where("not is_suitable")


# the lines table: parquet partitioned by session --------------------------------------------------


def append_files(lines: DataFrame, table: str) -> None:
    """Add the lines of files that their session does not have yet, so a call that is made again adds nothing."""
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(lines.schema).parquet(table).select("session_id", "path").distinct()
        lines = lines.join(known, ["session_id", "path"], "left_anti").select(*lines.columns)
    lines.write.mode("append").partitionBy("session_id").parquet(table)


def _remove_partition(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def create_session(spark: SparkSession, table: str, session_id: str) -> None:
    """An empty session: its partition folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/session_id={session_id}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def delete_files(spark: SparkSession, table: str, session_id: str, files: DataFrame) -> None:
    """Take files (a column `path`) out of one session by rewriting its partition only."""
    rows = spark.read.parquet(table).where(F.col("session_id") == session_id)
    kept = cut_lineage(rows.join(files.select("path").distinct(), "path", "left_anti"))
    if kept.isEmpty():
        _remove_partition(spark, f"{table}/session_id={session_id}")
        create_session(spark, table, session_id)
        return
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(table)


def merge_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of a session and newly extracted ones; on the same path the new one wins."""
    kept = old.join(new.select("session_id", "path"), ["session_id", "path"], "left_anti")
    return new.dropDuplicates(["session_id", "path"]).unionByName(kept, allowMissingColumns=True)
