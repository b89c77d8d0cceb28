"""Incremental jobs: new files into the lines table, severity counts per interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lines import number_lines, raw_lines


def ingest_new_files(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Append the lines of files not seen before to `out_dir`, partitioned by session, then stop.

    Each micro-batch owns the partitions batch=<id>; a batch that is run again replaces what it wrote, so
    a failure never doubles lines.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = number_lines(batch, in_dir).withColumn("batch", F.lit(batch_id))
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "batch").parquet(out_dir)

    stream = raw_lines(spark.readStream, in_dir)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity_counts_stream(stream: DataFrame, interval: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts per interval and severity; rows later than `delay` behind the newest are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", interval).alias("w"), "severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "severity", "n")


def append_severity_counts(stream: DataFrame, out_dir: str, checkpoint: str, interval: str = "1 hour", delay: str = "10 minutes") -> int:
    """Count what is new in the stream, append the intervals that are over to `out_dir` (Parquet), and stop; a later call goes on from
    the checkpoint. Returns how many (interval, severity) groups of late rows were dropped; a batch's late rows of a group count once."""
    counts = severity_counts_stream(stream, interval, delay)
    query = counts.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
