"""Registry of named queries: each is a Spark job over the tables of one folder, with an oracle SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc
from .derived import Tables, oracle_prefix


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ops: str, tables: str = "", oracle: str | None = None):
    """Register a job. `tables` lists the derived tables its oracle SQL reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        sql = None if oracle is None else oracle_prefix(tables.split(), oracle.strip())
        REGISTRY[name] = Query(name, ops, fn, sql)
        return fn

    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return q.run(Tables(spark, sf_dir))

    return run
