"""Helpers for long keys against plain windows, with pieces far smaller than a key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logstrata.operators import ordered
from logstrata.operators.search import with_context

FILE = ["session_id", "path"]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(3)
    rows = [("s", "hot", i + 1, rng.choice(["head: x", "  body", "error here", "tail"])) for i in range(700)]
    rows += [("s", f"p{n}", i + 1, rng.choice(["head: y", "  body", "error"])) for n in range(20) for i in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "session_id string, path string, line_no bigint, content string").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_context(lines, partitions):
    hit = F.col("content").startswith("error")
    w = Window.partitionBy(*FILE).orderBy("line_no")
    plain = lines.withColumn("context_before", F.collect_list("content").over(w.rowsBetween(-3, -1))).withColumn(
        "context_after", F.collect_list("content").over(w.rowsBetween(1, 3))).where(hit)
    got = with_context(lines.repartition(partitions), 3, hit)
    same(got.select(*FILE, "line_no", "context_before", "context_after"), plain)


def test_blocks_cover_neighbours(lines):
    rows = ordered.with_blocks(lines, 3, 2, block=10)
    assert rows.where("_home").count() == lines.count()
    near = rows.where("path = 'hot' and _block = 1").agg(F.min("line_no"), F.max("line_no")).first()
    assert tuple(near) == (11 - 3, 20 + 2)


def test_carry_and_count(lines):
    w = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("content").startswith("head"), F.concat("content", "line_no"))
    plain = lines.withColumn("t", F.last(title, ignorenulls=True).over(w)).withColumn("n", F.sum(F.col("content").startswith("head").cast("int")).over(w))
    same(ordered.carry_forward(lines, title, "t", block=16).select(*FILE, "line_no", "t"), plain)
    same(ordered.running_count(lines, F.col("content").startswith("head"), "n", block=16).select(*FILE, "line_no", "n"), plain)


def test_ranks(lines):
    w = Window.partitionBy(*FILE).orderBy("content", "line_no")
    plain = lines.withColumn("r", F.row_number().over(w))
    bucket = F.struct("content", F.floor(F.col("line_no") / 16).alias("b"))
    same(ordered.number_rows(lines, FILE, ["content", "line_no"], bucket, "r").select(*FILE, "line_no", "r"), plain)
    order = [F.desc("content"), F.col("path"), F.col("line_no")]
    total = lines.withColumn("r", F.row_number().over(Window.orderBy(*order)))
    same(ordered.global_rank(lines, order, "r").select(*FILE, "line_no", "r"), total)
