import json

from pyspark.sql import functions as F

from logstrata.functions.fields import field, flatten_fields, with_fields
from logstrata.operators import kube, profile, triage
from logstrata.session import cut_lineage

from .conftest import lines_frame


def flat(value, prefix=""):
    for key, v in value.items():
        name = f"{prefix}{key}"
        yield name, v
        if isinstance(v, dict):
            yield from flat(v, name + ".")


def nested(depth):
    return {f"k{depth}": nested(depth - 1), "own": depth} if depth else {"leaf": "end"}


def test_fields_of_any_depth(spark):
    bodies = [nested(12), nested(2), {"a": {"b": [{"c": {"d": {"e": {"f": 1}}}}]}}]
    parsed = with_fields(lines_frame(spark, [json.dumps(b) for b in bodies]))
    found = flatten_fields(parsed).select("line_no", "field").collect()
    want = {(k + 1, name) for k, b in enumerate(bodies) for name, _ in flat(b)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    deepest = max((name for _, name in want), key=lambda n: n.count("."))
    assert deepest.count(".") == 12 and {r.field for r in flatten_fields(parsed, depth=2).collect()} == {n for _, n in want if n.count(".") < 2}


def test_long_names_follow_the_same_rules(spark):
    bodies = ['{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}', '{"a.b":{"c":{"d.e":{"f":2}}}}', '{"a.b.c.d.e.f":3}', '{"a":{"b.c.d":{"e.f":4}}}', '{"a":{"b":5}}']
    rows = with_fields(lines_frame(spark, bodies)).select("line_no", field("a.b.c.d.e.f").alias("v")).collect()
    assert {r.line_no: r.v for r in rows} == {1: "1", 2: "2", 3: "3", 4: "4", 5: None}


def test_layouts_of_one_listing(spark):
    texts = [
        "LAST SEEN   TYPE      REASON    OBJECT    MESSAGE", "5m          Warning   Failed    pod/x     text a", "LAST SEEN   TYPE      REASON    OBJECT    MESSAGE",
        "6m          Warning   Failed    pod/x     text b", "NAMESPACE   LAST SEEN   TYPE     REASON    OBJECT   MESSAGE", "ns          7m          Normal   Created   pod/y    text c",
    ]
    found = kube.parse_events(lines_frame(spark, texts)).orderBy("line_no").collect()
    assert [(r.type, r.reason, r.message) for r in found] == [("Warning", "Failed", "text a"), ("Warning", "Failed", "text b"), ("Normal", "Created", "text c")]


def test_deep_dive_of_geo_files(spark):
    paths = ["var/log/gitlab/geo-logcursor/current", "var/log/gitlab/gitlab-rails/geo.log", "var/log/rails/geometry.log"]
    rows = [("s", p, 1, "repository sync failed") for p in paths]
    lines = spark.createDataFrame(rows, "session_id string, path string, line_no bigint, content string")
    files = lines.select("session_id", "path", F.lit("rails").alias("service"))
    found = {(r.service, r.category): r.lines for r in triage.deep_dive(lines, files).where("level = 0").collect()}
    assert found == {("geo", "sync"): 2}


def test_long_values_are_samples(spark):
    start = "x" * 120
    values = [start + "a"] * 3 + [start + "b"] * 2 + ["short"] * 2 + ["z"]
    lines = lines_frame(spark, [json.dumps({"v": v}) for v in values] + ["v=" + "y" * 300])
    (row,) = [r for r in profile.discover_fields(lines, k=4).collect() if r.field == "v"]
    assert (row["count"], row.type, row.sample_values) == (9, "string", [start + "a", "short", start + "b", "y" * 300])


def test_counts_are_hashed_and_merged_by_tasks(spark):
    lines = lines_frame(spark, ['{"v":"1"}', '{"v":1}', '{"v":1}', '{"v":null}', '{"v":"a","w":true}', "v=zz"])
    counts = profile.field_counts(lines)
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    assert cut_lineage(counts, 7).rdd.getNumPartitions() == 7
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    found = {r.field: (r["count"], r.type, r.nullable, r.distinct_values, r.samples) for r in profile.field_profile(lines, k=2, tasks=7).collect()}
    assert found == {"v": (6, "number", True, 3, ["1", "a"]), "w": (1, "boolean", False, 1, ["true"])}
