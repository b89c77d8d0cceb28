"""Ranks and prefix sums of linked lists that are given as a table of (id, next).

A task takes the entries of one range of ids and walks the chains within it by pointer jumping: every entry learns its chain's first
entry and the sums before it. Only first entries stay, with the sums of their chains, and make a shorter list, on which the same is
done with wider ranges, until one task's worth is left. Where neighbours in the list are neighbours in id too, as in a tour whose ids
follow the tree, a pass leaves few entries. Where they are not, random mates shorten the list: an entry whose coin shows heads takes
in its successor if that one's shows tails, a quarter of all entries in each pass. Passes are written, then undone in reverse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Entries in a task. A list of that many is finished in one.
BLOCK = 200_000


def walk(ids: np.ndarray, nexts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For chains of a block: each entry's chain (place of its first entry), the sums of weights before it, and, for first entries, the
    chain's last entry and its total. ids ascend; nexts may name entries elsewhere; weights has a column for each sum."""
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, nexts), n - 1)
    here = ids[at] == nexts
    chain, before = np.arange(n), np.zeros_like(weights)
    chain[at[here]], before[at[here]] = np.flatnonzero(here), weights[here]
    while True:
        further = chain[chain]
        if (further == chain).all():
            break
        before, chain = before + before[chain], further
    last, total = np.arange(n), np.zeros_like(weights)
    ends = np.flatnonzero(~here)
    last[chain[ends]], total[chain[ends]] = ends, before[ends] + weights[ends]
    return chain, before, last, total


def _contract(names: list[str]):
    def fn(batches):
        batches = [b for b in batches if b.num_rows]  # one block
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        get = lambda c: rows[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(get("id"), kind="stable")
        ids, nexts, weights = get("id")[order], get("next")[order], np.stack([get(c)[order] for c in names], axis=1)
        chain, before, last, total = walk(ids, nexts, weights)
        out = [pa.array(ids), pa.array(ids[chain]), pa.array(nexts[last])]
        out += [pa.array(np.ascontiguousarray(x[:, k])) for x in (before, total) for k in range(len(names))]
        yield from pa.table(out, names=["id", "head", "next", *names, *(f"all_{c}" for c in names)]).to_batches(50_000)

    return fn


def prefix_sums(entries: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """entries: (id, next, and the long columns `names`); ids are distinct, not negative and not null, next is null at the end of a list.
    Returns (id, and each of `names` summed over the entries before it in its list). A column of ones gives ranks from 0.

    An empty table gives none. There may be several lists; each starts from 0. The `next` must not form a ring.
    """
    spark = entries.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels, columns = [], "id long, head long, next long, " + ", ".join(f"{c} long" for c in [*names, *(f"all_{c}" for c in names)])
    rest, size, shrunk = cut_lineage(entries.select("id", F.coalesce("next", F.lit(-1)).alias("next"), *names)), None, True
    while True:
        count = rest.count()
        alone = bool(levels) and count <= block
        shrunk = size is None or 2 * count <= size
        size = count
        if shrunk or alone:
            parts = 1 if alone else max(least if not levels else 1, -(-count // block))
            cut = rest.repartitionByRange(parts, "id") if parts > 1 else rest.coalesce(1)
            level = cut_lineage(cut.mapInArrow(_contract(names), columns))
        else:
            level = cut_lineage(_mates(rest, names, len(levels)))
        levels.append(level)
        if alone:
            break
        rest = level.where("id = head").select("id", "next", *[F.col(f"all_{c}").alias(c) for c in names])
    known = levels.pop().select("id", *names)  # of these, the first entries of lists have no one before them
    for level in reversed(levels):
        heads = known.select(F.col("id").alias("head"), *[F.col(c).alias(f"more_{c}") for c in names])
        known = cut_lineage(level.join(heads, "head").select("id", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in names]))
    return known


def _mates(rest: DataFrame, names: list[str], round_no: int) -> DataFrame:
    """A pass of random mates, as a table like that of a contraction."""
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(round_no)), F.lit(2))
    after = rest.select(F.col("id").alias("next"), F.col("next").alias("then"), *[F.col(c).alias(f"next_{c}") for c in names])
    pairs = rest.join(after, "next", "left")
    takes = F.col("then").isNotNull() & (coin("id") == 1) & (coin("next") == 0)
    pairs = cut_lineage(pairs.select("id", "next", takes.alias("takes"), "then", *names, *[f"next_{c}" for c in names]))
    zero = F.lit(0).cast("long")
    own = pairs.select(
        "id", F.col("id").alias("head"), F.when(F.col("takes"), F.col("then")).otherwise(F.col("next")).alias("next"), *[zero.alias(c) for c in names],
        *[(F.col(c) + F.when(F.col("takes"), F.col(f"next_{c}")).otherwise(zero)).alias(f"all_{c}") for c in names],
    )
    taken = pairs.where("takes").select(F.col("next").alias("id"), F.col("id").alias("head"), F.lit(-1).cast("long").alias("next"), *names, *[zero.alias(f"all_{c}") for c in names])
    return own.join(taken.select("id"), "id", "left_anti").unionByName(taken)
