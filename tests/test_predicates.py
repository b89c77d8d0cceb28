import pytest
from pyspark.sql import functions as F

from logstrata.functions import predicates as p
from logstrata.functions.fields import field, flatten_fields, with_fields
from logstrata.functions.text import (
    correlation_ids, extract_ts, parse_bytes, parse_duration, parse_size_mb, safe_double, tai64n_to_ts,
)

from .conftest import lines_frame

LINES = [
    '{"a":{"b":{"c":5}},"meta.user":"Root","tags":["x","y"],"gone":null,"status":"500","level":"WARN"}',  # 1
    '2024-01-02T03:04:05.678Z {"message":"hello World","status":404,"a":{"b":[10,20]}}',  # 2
    'plain status=301 name="two words" level: \'debug\'',  # 3
    "",  # 4
    '{"msg":"only msg","user":{"name.first":"ann"}}',  # 5
    "{broken json status=7",  # 6
]


@pytest.fixture(scope="module")
def rows(spark):
    return with_fields(lines_frame(spark, LINES)).cache()


def hits(rows, condition):
    return {r.line_no for r in rows.where(condition).select("line_no").collect()}


def test_nested_literal_list_and_null(rows):
    got = rows.select("line_no", field("a.b.c").alias("c"), field("meta.user").alias("u"), field("a.b.1").alias("i"), field("user.name.first").alias("n")).collect()
    by = {r.line_no: r for r in got}
    assert (by[1].c, by[1].u, by[2].i, by[5].n) == ("5", "Root", "20", "ann")
    assert hits(rows, p.eq("gone", None)) == {1}
    assert hits(rows, p.exists("gone")) == {1}
    assert hits(rows, p.neq("gone", None)) == {2, 3, 4, 5, 6}


def test_missing_fields(rows):
    every = {1, 2, 3, 4, 5, 6}
    assert hits(rows, p.neq("nope", "x")) == every
    assert hits(rows, p.field_not_contains("nope", "x")) == every
    assert hits(rows, p.not_in("nope", ["x"])) == every
    assert hits(rows, p.field_not_regex("nope", "x")) == every
    for positive in (p.eq("nope", "x"), p.gt("nope", 1), p.field_contains("nope", "x"), p.field_regex("nope", "x"), p.is_in("nope", ["x"])):
        assert hits(rows, positive) == set()


def test_numbers_text_and_aliases(rows):
    assert hits(rows, p.gte("status", 404)) == {1, 2}
    assert hits(rows, p.lt("status", 302)) == {3, 6}
    assert hits(rows, p.gt("status", "many")) == set()
    assert hits(rows, p.eq("severity", "warn")) == {1}
    assert hits(rows, p.eq("level", "debug")) == {3}
    assert hits(rows, p.eq("name", "two words")) == {3}
    assert hits(rows, p.eq("message", "hello*")) == {2}
    assert hits(rows, p.field_contains("message", "only")) == {5}
    assert hits(rows, p.is_in("status", ["5??", "404"])) == {1, 2}
    assert hits(rows, p.is_in("status", ["[45]0?"])) == {1, 2}


def test_trees_are_null_safe(rows):
    assert hits(rows, p.negate(p.all_of(p.eq("status", 500), p.eq("level", "warn")))) == {2, 3, 4, 5, 6}
    assert hits(rows, p.any_of()) == set()
    assert hits(rows, p.regex(r"(?P<first_word>plain)")) == {3}
    assert hits(rows, p.regex("(")) == set()
    tree = {"type": "FIELD_NEQ", "field": "status", "value": 500}
    assert hits(rows, p.json_condition(tree)) == {2}


def test_flatten(rows):
    got = {(r.line_no, r.field): (r.type, r.text) for r in flatten_fields(rows).select("line_no", "field", "type", "text").collect()}
    assert got[(1, "a.b.c")] == ("number", "5")
    assert got[(1, "a.b")][0] == "object"
    assert got[(1, "tags_concat")] == ("string", "x y")
    assert got[(1, "gone")][0] == "unknown"
    assert got[(5, "user.name.first")] == ("string", "ann")


def test_text_functions(spark):
    rows = spark.createDataFrame(
        [("1h9m20.6s", "5.01 GiB", "10G", "1.2.3%"), ("350ms", "12 MB", "512M", "N/A"), ("45", "7", "-", "-3 C"), ("x", "x", "x", "")],
        "d string, b string, m string, s string",
    )
    got = rows.select(parse_duration(F.col("d")), parse_bytes(F.col("b")), parse_size_mb(F.col("m")), safe_double(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(4160.6, 5379446538, 10240.0, 1.23), (0.35, 12000000, 512.0, 0.0), (45.0, 0, 0.0, -3.0), (0.0, 0, 0.0, 0.0)]


def test_stamps_and_ids(spark):
    stamps = ["@4000000069151465074de55c text", "@40000000", "@zzzz000069151465074de55c text", "plain"]
    rows = spark.createDataFrame([(s,) for s in stamps], "c string")
    got = [r[0] for r in rows.select(tai64n_to_ts(F.col("c"))).collect()]
    assert got == ["[2025-11-12 23:12:27] text", stamps[1], stamps[2], stamps[3]]
    uuid = "12345678-1234-1234-1234-123456789abc"
    ids = spark.createDataFrame([(f'request_id={uuid} "correlation_id":"{"a" * 32}" job_id=short job_id=long-enough',)], "c string")
    r = ids.select(correlation_ids(F.col("c")).alias("n"), correlation_ids(F.col("c"), wide=True).alias("w")).first()
    assert set(r.n) == {uuid, "a" * 32} and set(r.w) == {uuid, "a" * 32, "long-enough"}
    ts = spark.createDataFrame([('{"time":"2024-05-06T07:08:09.123Z"}',), ("[2024-05-06 07:08:09 UTC] x",), ("none",)], "c string")
    assert [str(r[0]) for r in ts.select(extract_ts(F.col("c")).cast("string")).collect()] == ["2024-05-06 07:08:09"] * 2 + ["None"]
