"""The trie of conversations' first turns, and sums over its subtrees by the Euler-tour technique.

1. Turns are numbered by range partitions. A node, the sequence of the first d turns, is named by d and 128 bits: the exclusive or of
   a hash of each turn and its place. Such a name is a prefix sum, so a long conversation is worked on in blocks.
2. Nodes are groups of equal names: members, the least member, the last turn's words. Nodes are numbered by (least member, depth), so
   the path that a conversation does not share with a smaller one is a stretch of numbers.
3. Each node has an enter and an exit arc. The arc after an enter arc enters the first child or exits the node; the one after an exit
   arc enters the next sibling or exits the parent. Siblings follow their numbers; their order comes from range partitions as well.
4. The tour is list-ranked (list_ranking.prefix_sums): the place of an arc, and the leaves and savings of all arcs before it. What a
   subtree holds is the difference between its node's exit and enter arcs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .list_ranking import prefix_sums

BLOCK = 1024  # turns of one conversation in a block
PIECE = 65_536  # ids in a piece of a list of members
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]


def _pieces(rows: DataFrame, *order, keep: list) -> DataFrame:
    """The columns `keep` of rows, range-partitioned and sorted by order, with `row`: it ascends along order, and row >> 33 is the partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(rows.select(*keep, F.monotonically_increasing_id().alias("row")))


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, length, tag, words) for each row: its place in its conversation from 0, the conversation's number of turns, the
    128-bit hash of role and text, and the words (between ASCII blanks) of its text.

    Order is by turn, null first; ties by role, then text; equal rows count as turns of their own. Null role or text is empty. Rows
    without conv_id belong to no conversation and are left out. Other columns are not looked at.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    tag = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("tag")
    words = F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")
    rows = _pieces(rows, "conv_id", "turn", "role", "text", keep=["conv_id", tag, words]).withColumn("piece", F.shiftright("row", 33))
    parts = rows.groupBy("conv_id", "piece").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")  # a row for each piece of a conversation
    before = F.coalesce(F.sum("n").over(own.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "piece", "first", before.alias("before"), F.sum("n").over(own).alias("length"))
    return cut_lineage(rows.join(parts, ["conv_id", "piece"]).select("conv_id", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "length", "tag", "words"))


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of the conversations of ordered_turns."""
    return turns.where("pos = 0").select("conv_id", "length")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of rebuilt conversations: the first h turns of conversation c - c % every (all if fewer, none if absent), then
    c's own turns after its first h; h = crc32(decimal c) % (most + 1). A rebuilt conversation may have no turn."""
    own = lengths(turns).select("conv_id", "length", F.expr(f"conv_id - conv_id % {every}").alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).alias("h"))
    base = lengths(turns).where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    own = own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    own = cut_lineage(own.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where(f"conv_id % {every} = 0 AND pos < {most}").select(F.col("conv_id").alias("base"), "pos", "tag", "words")
    heads = own.join(heads, "base").where("pos < h").select("conv_id", "pos", "length", "tag", "words")
    tails = turns.drop("length").join(own, "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    return cut_lineage(heads.unionByName(tails.select(heads.columns))), own.select("conv_id", "length")


def _named(turns: DataFrame) -> DataFrame:
    """turns with depth (pos + 1), the name (k1, k2) of the node that they end, and that of the node before (p1, p2)."""
    rows = turns.select("*", F.floor(F.col("pos") / BLOCK).alias("block"), F.xxhash64("pos", "tag").alias("t1"), F.xxhash64(F.lit("b"), "tag", "pos").alias("t2"))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK turns
    carried = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"x{k}") for k in (1, 2)])
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"t{k}").over(upto).alias(f"k{k}") for k in (1, 2)]).join(carried, ["conv_id", "block"])
    name = [F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)]
    own = [n.bitwiseXOR(F.col(f"t{k}")) for k, n in enumerate(name, 1)]
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "words", name[0].alias("k1"), name[1].alias("k2"), own[0].alias("p1"), own[1].alias("p2"))


def _next_siblings(nodes: DataFrame) -> DataFrame:
    """(node, sibling) for the nodes (node, parent) that have one: the next larger number under the same parent."""
    rows = _pieces(nodes.where("parent IS NOT NULL"), "parent", "node", keep=["parent", "node"]).withColumn("piece", F.shiftright("row", 33))
    ends = rows.groupBy("piece").agg(F.min_by(F.struct("parent", "node"), "row").alias("head"))  # a row for each partition
    after = ends.select("piece", F.lead("head").over(Window.orderBy("piece")).alias("after"))
    own = Window.partitionBy("piece").orderBy("row")
    rows = rows.select("*", F.lead(F.struct("parent", "node")).over(own).alias("follows")).join(F.broadcast(after), "piece")
    rows = rows.withColumn("follows", F.coalesce("follows", "after"))
    return rows.where("follows.parent = parent").select("node", F.col("follows.node").alias("sibling"))


def _joined_ids(frames):
    """mapInPandas: ends (depth, k1, k2, conv_id), sorted, to pieces of their ids, comma-joined."""
    for pdf in frames:
        if not len(pdf):
            continue
        keys = pdf[KEY].to_numpy()
        runs = pd.Series(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)).cumsum(), index=pdf.index)
        groups = runs * (len(pdf) // PIECE + 1) + pdf.groupby(runs).cumcount() // PIECE
        pdf["ids"] = pdf["conv_id"].astype(str)
        yield pdf.groupby(groups, sort=False).agg(depth=("depth", "first"), k1=("k1", "first"), k2=("k2", "first"), first=("conv_id", "first"), ids=("ids", ",".join))


def _digests(frames):
    """mapInPandas: pieces, sorted by node and first id, to the SHA-256 of each node's joined ids. Only the current digest is held."""
    key, digest = None, None
    for pdf in frames:
        done = []
        for row in pdf[[*KEY, "ids"]].itertuples(index=False):
            if (own := tuple(row[:3])) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row[3].encode())
        if done:
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*KEY, "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end. Lists are cut into pieces before they meet; a digest is
    sequential, so the pieces of one node go through one task, one after another."""
    kinds = "depth long, k1 long, k2 long, "
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    pieces = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_joined_ids, kinds + "first long, ids string")
    pieces = cut_lineage(pieces).repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return cut_lineage(pieces.mapInPandas(_digests, kinds + "ends_sha256 string"))


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node of the trie of `turns` (conv_id, pos, length, tag, words; as of ordered_turns) and of `members` (conv_id,
    length: every conversation, also without turns). See prefix_trie."""
    named = cut_lineage(_named(turns))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "words", "k1", "k2")]
    rows = named.select("conv_id", *KEY, "words", "p1", "p2").unionByName(members.select("conv_id", *zero, *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")]))
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = _pieces(nodes, "conv_id", "depth", keep=nodes.columns).withColumnRenamed("row", "node")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut_lineage(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.min("node").alias("child"))
    nodes = cut_lineage(nodes.join(children, "node", "left").join(_next_siblings(nodes.select("node", "parent")), "node", "left"))

    enter, leave = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    one, none, saved = F.lit(1).cast("long"), F.lit(0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    arc = lambda at, then, leaves, saves: F.struct(at.alias("id"), then.alias("next"), one.alias("place"), leaves.alias("leaves"), saves.alias("saves"))
    arcs = nodes.select(F.explode(F.array(
        arc(enter("node"), F.coalesce(enter("child"), leave("node")), F.when(F.col("child").isNull(), one).otherwise(none), saved),
        arc(leave("node"), F.coalesce(enter("sibling"), leave("parent")), none, none),
    )).alias("arc")).select("arc.*")
    tour = prefix_sums(arcs, ["place", "leaves", "saves"])
    at = lambda k, c: F.max(F.when(F.col("id") % 2 == k, F.col(c)))
    tour = tour.groupBy(F.shiftright("id", 1).alias("node")).agg(
        at(0, "place").alias("tour_start"), at(1, "place").alias("tour_end"), (at(1, "leaves") - at(0, "leaves")).alias("n_leaves"), (at(1, "saves") - at(0, "saves")).alias("saved_tokens"),
    )
    ends = named.where("depth = length").select(*KEY, "conv_id").unionByName(members.where("length = 0").select(*zero[:1], *zero[2:], "conv_id"))
    out = nodes.join(tour, "node").join(_ends(ends), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "tour_start", "tour_end",
    )


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns (role, text) of the conversations, the root (no turn) included.

    conv_id (the least of the conversations that start so; with depth it names the node), depth (number of turns), parent_conv_id
    (null for the root), n_convs, n_children, n_leaves (childless nodes of the subtree, the node itself included), saved_tokens (summed
    over the subtree: (n_convs - 1) * words of the last turn), ends_sha256 (SHA-256 of the ascending decimal ids, comma-joined, of the
    conversations that end here), tour_start and tour_end (places of the node's arcs in the Euler tour, from 0).

    Order, ties, nulls and repeated rows are as in ordered_turns. An empty table has no conversation, and no row, not even a root.
    """
    turns = ordered_turns(conversations, conv_id, turn, role, text)
    return trie(turns, lengths(turns))
