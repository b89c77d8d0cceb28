"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

from check_queries import TABLES, rows_of
from logstrata.plans import all_queries
from logstrata.plans.registry import runner

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    got = runner(q)(spark, FOLDER).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if q.oracle is None:
        return
    want = con.execute(q.oracle).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
