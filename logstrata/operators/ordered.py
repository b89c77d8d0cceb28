"""Ordered computations that hold when one key owns a large share of all rows.

A plain window sorts every row of a key in one task. The helpers here split a key into bounded
pieces (by an ordered bucket, by blocks of line numbers, or by range partitions), do the local
work per piece, and combine small per-piece summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_LINES = 4096


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    name: str,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row within `keys` by `order`.

    `bucket` must not decrease along `order`; rows are sorted per (keys, bucket) only. Bucket sizes
    are counted map-side first, so the running offset is a window over one row per bucket.
    `sizes_from` may be a narrower form of `df` to count from.
    """
    sizes = (
        (df if sizes_from is None else sizes_from)
        .withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    cols = df.columns
    joined = df.withColumn("_bucket", bucket).join(offsets, [*keys, "_bucket"])
    return joined.select(*cols, (F.row_number().over(local) + F.col("_offset")).cast("bigint").alias(name))


def range_pieces(df: DataFrame, order: list[Column], pieces: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by `order`, with the piece number in `_piece`.

    Range bounds come from a sample, so a hot key is cut wherever `order` goes on past it. The rows are
    checkpointed: every later stage sees the same pieces, even after an executor is lost.
    """
    parted = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    return cut_lineage(parted.sortWithinPartitions(*order).withColumn("_piece", F.spark_partition_id()))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based rank over the whole table by `order` (must be total), without sorting it in one task."""
    parts = range_pieces(df, order)
    sizes = parts.groupBy("_piece").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range partition: bounded by the partition count, not by the data.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_piece").orderBy(*order)
    cols = df.columns
    return parts.join(F.broadcast(offsets), "_piece").select(
        *cols, (F.row_number().over(local) + F.col("_offset")).cast("bigint").alias(name)
    )


def near(lines: DataFrame, ranges: DataFrame, piece: int = 1024, most: int = 500_000) -> DataFrame:
    """lines (session_id, path, line_no, ...) joined with the ranges (session_id, path, first, last, ...) that they lie in.

    Only lines of pieces with a range leave the scan: the pieces' list is broadcast if it has `most` rows or fewer, and joined as any
    table beyond.
    """
    keys = ["session_id", "path"]
    ranges = cut_lineage(ranges.withColumn("piece", F.explode(F.sequence(F.floor((F.col("first") - 1) / piece), F.floor((F.col("last") - 1) / piece)))))
    wanted = ranges.select(*keys, "piece").distinct()
    wanted = F.broadcast(wanted) if ranges.count() <= most else wanted
    rows = lines.withColumn("piece", F.floor((F.col("line_no") - 1) / piece)).join(wanted, [*keys, "piece"], "left_semi")
    return rows.join(ranges, [*keys, "piece"]).where((F.col("line_no") >= F.col("first")) & (F.col("line_no") <= F.col("last"))).drop("piece", "first", "last")


def with_blocks(lines: DataFrame, before: int, after: int, block: int | None = None) -> DataFrame:
    """Cut each file into blocks of consecutive lines; every row is also copied to the blocks whose home
    rows can see it, that is those within `before` lines ahead of it or `after` lines behind it.

    Adds `_block` and `_home`. Work per (file, _block) sees all neighbours of its home rows; copies are
    few because the block is much longer than the reach.
    """
    size = block or max(BLOCK_LINES, 16 * max(before, after))
    pos = F.col("line_no") - 1
    home = F.floor(pos / size)
    # A row is needed by home rows up to `before` lines later and `after` lines earlier.
    first = F.floor(F.greatest(pos - after, F.lit(0)) / size)
    last = F.floor((pos + before) / size)
    return lines.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_block") == home)


def carry_forward(
    lines: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("session_id", "path"), block: int = 65536
) -> DataFrame:
    """Last non-null `value` at or before each line of a file, for files of any length.

    Per block: the local carry. Across blocks: the last value of each block, carried over one row per block.
    """
    keys = list(keys)
    cols = lines.columns
    rows = lines.withColumn("_value", value).withColumn("_block", F.floor((F.col("line_no") - 1) / block))
    ends = (
        rows.where(F.col("_value").isNotNull())
        .groupBy(*keys, "_block")
        .agg(F.max_by("_value", "line_no").alias("_end"))
    )
    # Blocks with no value of their own must see the carry too: attach by the latest earlier block.
    blocks = rows.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    local = Window.partitionBy(*keys, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, [*keys, "_block"]).select(
        *cols, F.coalesce(F.last("_value", ignorenulls=True).over(local), F.col("_carried")).alias(name)
    )


def running_count(
    lines: DataFrame, flag: Column, name: str, keys: tuple[str, ...] = ("session_id", "path"), block: int = 65536
) -> DataFrame:
    """Number of lines with `flag` at or before each line of a file, for files of any length."""
    keys = list(keys)
    cols = lines.columns
    rows = lines.withColumn("_flag", flag.cast("bigint")).withColumn("_block", F.floor((F.col("line_no") - 1) / block))
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_flag").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    local = Window.partitionBy(*keys, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, [*keys, "_block"]).select(
        *cols, (F.sum("_flag").over(local) + F.col("_carried")).alias(name)
    )
