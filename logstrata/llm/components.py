"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def union_find(frames):
    """mapInPandas: the edges (a, b) of a partition to a star (node, root) for each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        stars = pd.DataFrame({"a": part, "b": [root(x) for x in part]})
        yield stars[stars["a"] != stars["b"]]


def components(edges: DataFrame, block: int = 100_000) -> DataFrame:
    """(node, component) for each node of edges (a, b), both long and not null; component is the least node that it reaches.

    Union-find reduces the edges of each task, about `block` of them, to stars. If there is more than one task, large-star and
    small-star steps alternate until the edges stay as they are: every node points to its component's least node. A step is a minimum
    by node (combined before the shuffle) and a join of two written tables, whose large keys Spark splits, so a component may hold any
    share of the nodes.
    """
    edges = cut_lineage(edges.where("a <> b").select("a", "b"))
    tasks = 1 + edges.count() // block
    edges, before = cut_lineage(edges.coalesce(tasks).mapInPandas(union_find, "a long, b long")), None
    while tasks > 1:
        both = cut_lineage(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(tasks))
        least = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")).coalesce(tasks))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = cut_lineage(large.where("a <> b").distinct().coalesce(tasks))  # every edge points to the smaller node
        least = cut_lineage(down.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        edges = cut_lineage(small.union(least.select("a", F.col("least").alias("b"))).distinct().coalesce(tasks))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
