"""What must reach the scan, and what must not appear in a plan."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from logstrata.functions import predicates as p
from logstrata.functions.fields import field, with_fields
from logstrata.functions.text import parse_bytes, parse_duration
from logstrata.operators import ordered, search
from logstrata.plans import all_queries
from logstrata.plans.derived import Tables, spread
from logstrata.plans.registry import runner


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "t")
    Tables(spark, "/root/testdata/sf0.001").log_lines().write.partitionBy("session_id").parquet(path)
    return spark.read.parquet(path)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_line_range_is_pushed_down(lines):
    text = plan(search.slice_lines(lines.select("session_id", "path", "line_no", "content"), "node1", "p", 10, 20))
    assert "PartitionFilters" in text and "session_id" in text.split("PartitionFilters")[1].split("\n")[0]
    assert "GreaterThanOrEqual(line_no,10)" in text and "EqualTo(path,p)" in text
    assert "ReadSchema: struct<path:string,content:string,line_no:bigint>" in text


def test_search_parses_json_once_and_stays_in_one_stage(lines):
    df = with_fields(lines.select("session_id", "path", "content")).where(p.all_of(F.col("path").contains("rails"), p.gte("status", 500), p.eq("ctx.k", 7))).select("path", field("message"))
    text = plan(df)
    assert text.count("parseJson") <= 2  # once in the tree, once in its details
    assert "Exchange" not in text
    assert "StringContains(path,rails)" in text


def test_context_shuffles_only_lines_near_hits(spark):
    lines = spark.range(1, 20_001).selectExpr("'s' AS session_id", "'a.log' AS path", "id AS line_no", "IF(id IN (7, 9000), 'ERROR', 'fine') AS content")
    found = search.with_context(lines, 2, F.col("content").contains("ERROR"))
    text = plan(found)
    assert text.count("hashpartitioning") == 2  # of the list of stretches, and of the lines near hits
    assert re.search(r"BroadcastHashJoin LeftSemi", text)
    rows = ordered.near(lines, spark.createDataFrame([("s", "a.log", 8998, 9002)], "session_id string, path string, first long, last long"), piece=16)
    assert rows.count() == 5
    got = {r.line_no: (r.context_before, r.context_after) for r in found.collect()}
    assert got == {7: (["fine"] * 2, ["fine"] * 2), 9000: (["fine"] * 2, ["fine"] * 2)}


@pytest.mark.parametrize("name", ["line_classes", "error_summary"])
def test_generated_code_compiles(spark, name):
    """Every part that is compiled as a whole fits the JVM's limit for a method; a part that does not reports no size."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        df = runner(all_queries()[name])(spark, "/root/testdata/sf0.001")
        plan_of = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan_of)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", text)]
    assert sizes and all(0 < x < 65_536 for x in sizes), sizes


def test_more_rows_make_more_tasks_not_longer_ones(spark, tmp_path):
    """One tightly packed file goes to more tasks than there are cores when it has many rows."""
    path = str(tmp_path / "t")
    spark.range(1_000_000).coalesce(1).write.parquet(path)
    found = spread(spark.read.parquet(path), rows=100_000)
    assert found.rdd.getNumPartitions() == 10 and found.distinct().count() == 1_000_000
    assert spread(spark.read.parquet(path), rows=2_000_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_sorted_fields_make_more_tasks_than_lines_do(spark, tmp_path):
    """A line has many fields, which are sorted by name in a task; a task gets fewer lines for that, and all lines are counted."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    events.union(events).union(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = runner(all_queries()["json_fields_flattened"])(spark, str(tmp_path))
    dealt = [int(n) for n in re.findall(r"RoundRobinPartitioning\((\d+)\)", plan(df))]
    assert dealt and min(dealt) == 6  # of 300,000 lines
    got = df.collect()
    assert len(got) == 9 and {r.n for r in got} == {300_000}


def test_units_are_compiled_by_the_jvm(spark):
    """The JVM interprets methods of 8000 bytes or more, several times as slowly."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan_of = runner(all_queries()["units_to_numbers"])(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan_of)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", text)]
    assert sizes and all(0 < x < 8000 for x in sizes), sizes


def test_numbers_of_odd_texts(spark):
    rows = [("1h9m20.6s", 4160.6), ("350ms", 0.35), (" 1,200 ", 1200.0), ("1e3", 1000.0), ("", 0.0), ("ms", 0.0), ("2h x", 7200.0), (None, 0.0)]
    df = spark.createDataFrame(rows, "x string, want double").select(parse_duration(F.col("x")).alias("got"), "want")
    assert df.where("got <> want").isEmpty()
    sizes = [("5.01 GiB", 5379446538), ("12 MB", 12_000_000), ("12 IB", 12), ("kb", 0), (None, 0)]
    df = spark.createDataFrame(sizes, "x string, want long").select(parse_bytes(F.col("x")).alias("got"), "want")
    assert df.where("got <> want").isEmpty()
