from collections import defaultdict

import pytest

from logstrata.llm import sharding

from .brute import frame


def check(found, docs, limit):
    assert sorted((r.doc_id for r in found), key=repr) == sorted((k for k, _ in docs), key=repr)
    held, sizes = defaultdict(int), defaultdict(set)
    for r in found:
        held[r.shard_id] += r.n_bytes
        sizes[r.shard_id].add((r.shard_bytes, r.oversized))
    for shard, total in held.items():
        assert sizes[shard] == {(total, total > limit)}
        if total > limit:
            assert sum(r.shard_id == shard for r in found) == 1
    buckets = {(r.depth, int(r.shard_id.split("-")[1])) for r in found}
    for d, p in buckets:  # no bucket lies inside another, and none could have been left whole
        assert not any(d2 < d and p >> (d - d2) == p2 for d2, p2 in buckets)
        if d:
            parent = [r for r in found if r.depth >= d and int(r.shard_id.split("-")[1]) >> (r.depth - d + 1) == p >> 1]
            assert sum(r.n_bytes for r in parent) > limit
    return held


def test_limits_hold(spark):
    docs = [(k, "x" * (k % 97)) for k in range(600)] + [(700, "y" * 5000), (None, "no id"), (None, None), (3, "another three"), (701, "")]
    held = check(sharding.shards(frame(spark, docs), limit=1000).collect(), docs, 1000)
    assert len(held) > 30


def test_rows_that_no_bit_tells_apart(spark):
    docs = [(1, "z" * 100)] * 55 + [(k, "q" * 10) for k in range(2, 40)]
    held = check(sharding.shards(frame(spark, docs, 6), limit=1000).collect(), docs, 1000)
    assert sum(total in (1000, 500) for total in held.values()) == 6


def test_one_shard_and_empty_table(spark):
    assert {r.shard_id for r in sharding.shards(frame(spark, ["a", "b"])).collect()} == {"0-0-0"}
    assert sharding.shards(frame(spark, []).where("false")).collect() == []


def test_files(spark, tmp_path):
    docs = frame(spark, [(k, "x" * 50) for k in range(100)])
    sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.groupBy("shard_id").count().agg({"count": "max"}).head()[0] <= 20


def test_no_python_in_the_plan(spark, capsys):
    sharding.shards(frame(spark, ["a", "b"])).explain("formatted")
    text = capsys.readouterr().out
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


@pytest.mark.parametrize("limit", [1, 7])
def test_tiny_limits(spark, limit):
    docs = [(k, "ab") for k in range(20)]
    check(sharding.shards(frame(spark, docs), limit=limit).collect(), docs, limit)
