"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash has BITS bits. A bucket is named by its depth d and the first d bits; it is a shard if its bytes fit the limit, else it
is split on the next bit. Splitting bucket by bucket would take a pass for each bit, so a round sums bytes by cells of several more
bits, sums cells up to every depth between, and takes each cell's first depth that fits. Only rows of cells that fit at no depth go
to the next round. The directory (cell -> depth) is a table: it grows with the number of shards and is joined, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BITS, LIMIT, STEP = 60, 16 << 20, 6


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The first BITS bits of md5(doc_id ':' text), nulls as empty: rows of one id but different texts can be told apart."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def cell(depth: int) -> Column:
    return F.shiftright("hash", BITS - depth)


def split(rows: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """The directory of rows (hash, n_bytes): for each round its depth and a table (cell, depth, prefix, shard_bytes, shard_docs).
    The second result has the hashes that are too large at all BITS bits, with the number of rows that make a part: (hash, per_part)."""
    total = rows.agg(F.sum("n_bytes")).head()[0] or 0
    low, high, directory = 0, min(BITS, max(1, (total // limit).bit_length()) + STEP), []
    while True:
        cells = cut_lineage(rows.groupBy(cell(high).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most")))
        levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        sums = cut_lineage(sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)))
        first = cut_lineage(levels.join(sums.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth")))
        found = first.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)")).join(sums, ["depth", "prefix"])
        directory.append((high, cut_lineage(found.select("cell", "depth", "prefix", "shard_bytes", "shard_docs"))))
        over = cells.join(first, "cell", "left_anti")
        if over.isEmpty():
            return directory, None
        if high == BITS:
            per_part = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.col("most")))
            return directory, cut_lineage(over.select(F.col("cell").alias("hash"), per_part.alias("per_part")))
        rows = cut_lineage(rows.join(over.select("cell"), cell(high) == F.col("cell"), "left_semi"))
        low, high = high + 1, min(BITS, high + STEP)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with their number (from 0) among those of one hash. Each partition numbers its own; a small table of counts adds the
    numbers before it, so no task sees all rows of a hash."""
    rows = cut_lineage(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    counts = rows.groupBy("hash", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut_lineage(counts.select("hash", "_part", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy("hash", "_part").orderBy("_row")) - 1
    return rows.withColumn("_own", own).join(counts, ["hash", "_part"]).withColumn("number", F.col("_own") + F.col("_before")).drop("_part", "_row", "_own", "_before")


def place(rows: DataFrame, directory: list[tuple[int, DataFrame]], over: DataFrame | None) -> DataFrame:
    """rows (hash and any other columns) with depth, prefix, part, shard_bytes and shard_docs. Rows of a part have both null."""
    out = None
    for high, table in directory:
        placed = rows.join(table, cell(high) == table["cell"]).drop("cell").withColumn("part", F.lit(0).cast("long"))
        out = placed if out is None else out.unionByName(placed)
    if over is not None:
        rest = numbered(rows.join(over, "hash")).withColumn("part", F.floor(F.col("number") / F.col("per_part")))
        rest = rest.select("*", F.lit(BITS).alias("depth"), F.col("hash").alias("prefix"), F.lit(None).cast("long").alias("shard_bytes"), F.lit(None).cast("long").alias("shard_docs"))
        out = out.unionByName(rest.drop("number", "per_part"))
    return out


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, shard_id ('depth-prefix-part'), depth, shard_bytes, shard_docs, oversized.

    The shard is the least deep bucket of the row's hash prefix whose texts have at most `limit` bytes. A document longer than that
    gets a shard of its own, marked oversized. Rows that agree in id and text cannot be told apart by any bit; if they exceed the limit
    together, they are dealt to numbered parts that fit. Null ids and texts count as empty ones. Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), hash_of(doc_id, text).alias("hash"))
    rows = cut_lineage(rows)
    directory, over = split(rows.select("hash", "n_bytes"), limit)
    out = place(rows, directory, over)
    if over is not None:
        out = cut_lineage(out)
        parts = out.where("shard_bytes IS NULL").groupBy("prefix", "part").agg(F.sum("n_bytes").alias("own_bytes"), F.count(F.lit(1)).alias("own_docs"))
        parts = cut_lineage(parts.withColumn("depth", F.lit(BITS)))
        out = out.join(parts, ["depth", "prefix", "part"], "left")
        out = out.withColumn("shard_bytes", F.coalesce("shard_bytes", "own_bytes")).withColumn("shard_docs", F.coalesce("shard_docs", "own_docs"))
    return out.select(
        "doc_id", "n_bytes", F.concat_ws("-", "depth", "prefix", "part").alias("shard_id"), F.col("depth").cast("int").alias("depth"),
        "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"),
    )


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """docs with all their columns as Parquet, a folder shard_id=... for each shard (a column of that name is replaced)."""
    docs = docs.drop("shard_id")
    rows = docs.select(F.struct("*").alias("row"), hash_of(doc_id, text).alias("hash"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    placed = place(rows.drop("n_bytes"), *split(cut_lineage(rows.select("hash", "n_bytes")), limit))
    placed = placed.select("row.*", F.concat_ws("-", "depth", "prefix", "part").alias("shard_id"))
    placed.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
