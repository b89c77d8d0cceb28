"""Near duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

A SuperMinHash signature has, for each of m slots, the least (rank, value) over the shingles, where a shingle's ranks over the slots
are a permutation of 0..m-1. Ranks of one shingle are correlated, so signatures vary less than those of m independent hashes; and
once every slot holds a rank below j, ranks from j on cannot change anything, so work stops there (after two or three ranks for a
text of a few hundred shingles). All shingles of a slice of texts take one rank at a time, as arrays.

Texts of one shingle set form a class, and only one member of a class is banded. In a band's bucket nobody is paired with everybody:
first each member is checked against one chosen by hash, another in each bucket; what is linked then counts as one component; then only members of a
bucket that lie in different components are checked with each other, in full buckets only those that share a rare shingle. Any two
similar members that a bucket brings together are therefore verified or already linked, while a bucket of thousands of near copies
costs one check a member.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import LOWER, NOT_BLANK, U, grams, hash_spans, list_array, map_slices, mix, ragged, signed, spans
from .components import components

SLOTS, ROWS, WORDS, PERCENT = 128, 4, 5, 75
BLOCK = 64
FULL = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and their len + 1 offsets."""
    starts, ends, by_text = spans(data, offsets, NOT_BLANK)
    hashes = hash_spans(data, starts, ends, LOWER)
    shingles, places = grams(hashes, by_text, words)
    cuts = np.searchsorted(places, by_text)
    sets = []
    for k, n in enumerate(np.diff(by_text)):
        if n >= words:
            sets.append(np.unique(shingles[cuts[k] : cuts[k + 1]]))
        elif n:
            whole = grams(hashes[by_text[k] : by_text[k + 1]], np.array([0, n]), int(n))[0]
            sets.append(mix(whole + U(n)))
        else:
            sets.append(shingles[:0])
    return (np.concatenate(sets) if sets else shingles[:0]), np.cumsum([0, *map(len, sets)])


def superminhash(values: np.ndarray, offsets: np.ndarray, slots: int = SLOTS, chunk: int = 50_000) -> np.ndarray:
    """A row of `slots` 64-bit values (rank in the upper half, random value in the lower) for each set; all ones for an empty set."""
    out = np.full((len(offsets) - 1, slots), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        counts = np.diff(offsets[at : to + 1])
        owner = np.repeat(np.arange(at, to), counts)
        _fill(out, values[offsets[at] : offsets[to]], owner, slots)
        at = to
    return out


def _fill(out: np.ndarray, values: np.ndarray, owner: np.ndarray, slots: int) -> None:
    table = out.reshape(-1)
    empty = np.iinfo(np.uint64).max
    perm = None
    for rank in range(slots):
        if not len(values):
            return
        random = mix(values + U((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        pick = rank + ((random >> U(32)) * U(slots - rank) >> U(32)).astype(np.int64)
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(values), 1))
        rows = np.arange(len(values))
        slot = perm[rows, pick].astype(np.int64)
        perm[rows, pick] = perm[rows, rank]
        key = owner * slots + slot
        free = table[key] == empty  # a slot that is filled holds a lower rank
        np.minimum.at(table, key[free], (random[free] & U(0xFFFFFFFF)) | U(rank << 32))
        if rank % 4 == 0 or len(values) < 4096 or rank < 4:
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            open_ = (out[owner[first]] == empty).any(1)
            keep = np.repeat(open_, np.diff(np.append(first, len(owner))))
            if not keep.all():
                values, owner, perm = values[keep], owner[keep], perm[keep]


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of `rows` slots; the band's number is part of it."""
    n, slots = signatures.shape
    parts = signatures.reshape(n, slots // rows, rows)
    keys = np.zeros((n, slots // rows), np.uint64)
    for j in range(rows):
        keys = mix(keys ^ parts[:, :, j]) + U(j)
    return mix(keys + np.arange(slots // rows, dtype=np.uint64))


def _sketch(slots: int, rows: int, words: int):
    def fn(batch, data, offsets):
        values, cuts = shingle_sets(data, offsets, words)
        sets = np.diff(cuts)
        keys = band_keys(superminhash(values, cuts, slots), rows)
        digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:])]
        width = keys.shape[1]
        bands = list_array(np.arange(len(sets) + 1) * width, pa.array(signed(keys).ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sets.astype(np.int64)), pa.array(digests, pa.binary()), bands],
            ["doc_id", "text_key", "n_shingles", "digest", "bands"],
        )

    return map_slices(fn)


def _verify(words: int, percent: int):
    """mapInArrow over rows (center, block, role, row_id, text) sorted so that a center's own text (role 0) comes first in each block:
    the links (a, b) of centers and members."""

    def run(batches):
        current, members = None, np.zeros(0, np.uint64)

        def fn(batch, data, offsets):
            nonlocal current, members
            values, cuts = shingle_sets(data, offsets, words)
            centers, roles, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            a, b = [], []
            for k in range(len(ids)):
                own = values[cuts[k] : cuts[k + 1]]
                if roles[k] == 0:
                    current, members = centers[k], own
                    continue
                assert current == centers[k]
                at = np.searchsorted(members, own)
                at[at == len(members)] = 0
                common = int((members[at] == own).sum()) if len(members) else 0
                if 100 * common >= percent * (len(own) + len(members) - common) and common:
                    a.append(int(current))
                    b.append(int(ids[k]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        yield from map_slices(fn)(batches)

    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are similar. Members b of a center a are dealt to blocks of bounded size, each with
    the center's text, and checked in one pass over sorted rows."""
    sizes = cut_lineage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    dealt = cut_lineage(pairs.join(sizes, "a").select(F.col("a").alias("center"), block, F.lit(1).alias("role"), F.col("b").alias("id")))
    centers = dealt.select("center", "block", F.lit(0).alias("role"), F.col("center").alias("id")).distinct()
    work = dealt.union(centers).join(texts, "id").select("center", "block", "role", "id", "text")
    work = work.repartition(F.col("center"), F.col("block")).sortWithinPartitions("center", "block", "role")
    return work.mapInArrow(_verify(words, percent), "a long, b long")


def _explode_sets(words: int):
    def fn(batch, data, offsets):
        values, cuts = shingle_sets(data, offsets, words)
        ids = np.repeat(batch.column(0).to_numpy(), np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(signed(values))], ["id", "shingle"])

    return map_slices(fn)


def _paired(rows: DataFrame, key: str, percent: int, more: str = "") -> DataFrame:
    """Pairs (a, b) of rows with one key that lie in different components and can be similar by their sizes."""
    possible = F.expr(
        f"x.{key} = y.{key} AND x.id < y.id AND x.component <> y.component"
        f" AND 100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles){more}"
    )
    return rows.alias("x").join(rows.alias("y"), possible).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _across(members: DataFrame, parts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) still to be checked: members of one bucket in different components. Buckets of up to FULL members are paired as
    they are. Those of fuller ones meet on rare shingles instead: of two sets that share `percent` of their union, the
    n - ceil(percent n) + 1 rarest shingles of the one and of the other have one in common, so what fills the bucket, a passage that
    many documents share, brings nobody together. Where the passage is nearly all of a set, the position of the first shared shingle
    decides: those after it are all that the sets can share besides."""
    placed = members.join(parts, members["id"] == parts["node"], "left")
    placed = cut_lineage(placed.select("bucket", "id", "center", "n_shingles", F.coalesce("component", "id").alias("component")))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = cut_lineage(mixed.where("low <> high").select("bucket", "n"))
    rows = cut_lineage(placed.where("id <> center").join(mixed, "bucket").select("bucket", "id", "n_shingles", "component", "n"))
    few = _paired(rows.where(F.col("n") <= FULL), "bucket", percent)
    many = cut_lineage(rows.where(F.col("n") > FULL).select("id", "n_shingles", "component").distinct())
    sets = cut_lineage(texts.join(many, "id", "left_semi").mapInArrow(_explode_sets(words), "id long, shingle long").distinct())
    counts = cut_lineage(sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")))
    ranked = sets.join(counts, "shingle").join(many, "id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle"))
    prefix = ranked.withColumn("rank", rank).where(F.expr(f"df > 1 AND rank <= n_shingles - ceil(n_shingles * {percent} / 100) + 1"))
    prefix = cut_lineage(prefix.select("shingle", "id", "n_shingles", "component", "rank"))
    enough = f" AND (1 + least(x.n_shingles - x.rank, y.n_shingles - y.rank)) * (100 + {percent}) >= {percent} * (x.n_shingles + y.n_shingles)"
    return few.union(_paired(prefix, "shingle", percent, enough)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, text_key (md5 of the text).

    Words are what stands between blanks, A-Z lower-cased; a text's set is its distinct shingles of `words` words, or its whole word
    sequence if it has fewer; an empty set (also of a null text) links with nothing. Texts are linked if `percent` of their union is
    shared, confirmed on full sets; shingles are compared by 64-bit hashes. component_id is the least doc_id of the component, null
    ids left out; it is null where no member has an id. Rows that repeat a doc_id are documents of their own. Other columns are not
    looked at.
    Candidates are pairs that agree in all rows of one of slots / rows bands: at 128 and 4, a pair at the threshold is missed with
    probability 5e-6, a pair at 0.85 with 1e-10.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key binary, n_shingles long, digest binary, bands array<long>"
    sketches = cut_lineage(source.mapInArrow(_sketch(slots, rows, words), schema))
    # a class for each set, with one text to stand for it
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = sketches.where("n_shingles > 0").groupBy("digest").agg(F.min(row).alias("row"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    classes = cut_lineage(classes.select("digest", "row.doc_id", "row.text_key", "bands", "n_shingles", F.monotonically_increasing_id().alias("id")))
    entries = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = cut_lineage(entries.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", "bucket")).alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    members = cut_lineage(entries.join(shared, "bucket"))
    needed = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    same = source["doc_id"].eqNullSafe(needed["own_id"]) & (source["text_key"] == needed["own_key"])
    texts = cut_lineage(source.join(needed, same).select("id", "text"))
    pairs = cut_lineage(members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct())
    links = cut_lineage(verified(pairs, texts, words, percent))
    parts = cut_lineage(components(links))
    rest = cut_lineage(_across(members, parts, texts, words, percent))
    if not rest.isEmpty():
        parts = cut_lineage(components(links.union(cut_lineage(verified(rest, texts, words, percent)))))
    named = cut_lineage(classes.join(parts, classes["id"] == parts["node"], "left").select("digest", "doc_id", F.coalesce("component", "id").alias("component")))
    least = cut_lineage(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = cut_lineage(named.join(least, "component").select("digest", "component_id"))
    out = sketches.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each component the rows of the least doc_id stay (if no row has an id, all), and all rows
    without words."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key")).distinct()
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & (key == gone["gone_key"]), "left_anti").select(*docs.columns)
