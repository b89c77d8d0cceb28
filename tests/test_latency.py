import random

import numpy as np
from pyspark.sql import functions as F

from logstrata.operators import latency

SCHEMA = "endpoint string, duration_ms double, status int, ts timestamp"


def requests(spark, rows):
    start = "2024-01-01 00:00:00"
    frame = spark.createDataFrame([(e, d, s, k) for k, (e, d, s) in enumerate(rows)], "endpoint string, duration_ms double, status int, k int")
    return frame.select("endpoint", "duration_ms", "status", (F.lit(start).cast("timestamp") + F.make_interval(secs=F.col("k"))).alias("ts"))


def test_ranks_against_numpy(spark):
    """A hot endpoint whose durations all differ, small ones, ties, missing durations and a missing endpoint."""
    rng = random.Random(2)
    rows = [("hot", float(k) + rng.random(), 200) for k in range(5000)] + [("pair", 1.0, 500), ("pair", 2.0, 200), ("one", 7.0, 200), (None, 3.0, 200), (None, 5.0, 200)]
    rows += [("ties", float(rng.randint(1, 4)), 500 if k % 4 == 0 else 200) for k in range(300)] + [("ties", None, 200)] * 5 + [("none", None, 200)]
    rng.shuffle(rows)
    frame = requests(spark, rows)
    found = {r.endpoint: r for r in latency.endpoint_stats(frame.repartition(7), ["endpoint"]).collect()}
    assert set(found) == {"hot", "pair", "one", "ties", "none", None}
    for name, row in found.items():
        own = [d for e, d, _ in rows if e == name and d is not None]
        assert row["count"] == sum(e == name for e, _, _ in rows)
        if not own:
            assert row.p99 is None and row.stddev is None
            continue
        want = np.percentile(own, [99, 95, 50])
        assert np.allclose([row.p99, row.p95, row.median], want) and (row.max, row.min) == (max(own), min(own))
        assert np.isclose(row.stddev, np.std(own)) and np.isclose(row.fail_pct, 100 * sum(s >= 500 for e, _, s in rows if e == name) / row["count"])


def test_spread_of_large_values(spark):
    frame = requests(spark, [("e", 1e15 + d, 200) for d in (0.0, 1.0, 2.0, 3.0)])
    assert np.isclose(latency.endpoint_stats(frame, ["endpoint"]).first().stddev, np.std([0, 1, 2, 3]))


def test_no_percentile_buffer_and_partitions_do_not_matter(spark):
    rows = [("e", float(k * 7919 % 1000), 200) for k in range(999)]
    frame = requests(spark, rows)
    stats = latency.endpoint_stats(frame, ["endpoint"])
    assert "percentile" not in stats._jdf.queryExecution().executedPlan().toString()
    want = stats.collect()
    for parts in (1, 32):
        assert latency.endpoint_stats(frame.repartition(parts), ["endpoint"]).collect() == want


def test_tiny_files_count(spark):
    files = spark.createDataFrame([("s", "var/log/rails/production_json.log", 12), ("s", "x", 500)], "session_id string, path string, size long")
    assert latency.latency_files(files).count() == 1 and latency.latency_files(files, 100).count() == 0
