"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every sender (some partitions together) sorts the distinct fingerprints of its rows, cuts them by owner (a range of values) and sends each owner one
   Golomb-Rice coded block: a few bits more than log2(range / count) a fingerprint, whatever the texts' lengths.
2. Owners decode, find values that came from two senders, and answer each block with a bitmap of one bit a fingerprint.
3. Senders mark their suspects: rows whose bit is set, or whose fingerprint repeats within the sender.
4. Only suspects' texts are grouped, by the bytes themselves, so a fingerprint shared by different texts does no harm.

Copies are reduced to (text, count, largest doc_id) before each shuffle, and owners get a value once from each sender, so a text
that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SPARE_BITS = 8
#: Senders and owners: as many as partitions, but above LEAST of them only as many as give each so many rows, for blocks go from every
#: sender to every owner.
LEAST, SENDER_ROWS, OWNER_ROWS = 64, 1_000_000, 4_000_000


def rice(gaps: np.ndarray, bits: int) -> bytes:
    """Golomb-Rice code: all quotients in unary, then all remainders in `bits` bits."""
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(bits, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, rest])).tobytes()


def unrice(blob: bytes, count: int, bits: int) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(flags)[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = flags[ends[-1] + 1 : ends[-1] + 1 + count * bits].reshape(count, bits).astype(np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(bits)) + (rest << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def rice_bits(size: int, count: int) -> int:
    """Best remainder length for the gaps of `count` uniform values below `size`."""
    return max(0, int(np.floor(np.log2(max(1.0, 0.69 * size / max(1, count))))))


def fingerprints(digest: pd.Series, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(bytes(x)[:8] for x in digest), ">u8").astype(np.uint64)
    return raw >> np.uint64(64 - width)


def senders(owners: int, width: int):
    """applyInPandas by sender: the rows (sender, digest) to one coded block for each owner."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(fingerprints(pdf["digest"], width))
        lead = min(31, width)
        owner = ((values >> np.uint64(width - lead)).astype(np.int64) * owners) >> lead
        out = []
        for k, at, n in zip(*np.unique(owner, return_index=True, return_counts=True)):
            own, base = values[at : at + n], np.array([_base(int(k), owners, width)], np.uint64)
            bits = rice_bits((1 << width) // owners, n)
            out.append((int(k), int(pdf["sender"].iloc[0]), int(n), bits, rice(np.diff(own, prepend=base), bits)))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "bits", "block"])

    return run


def _base(owner: int, owners: int, width: int) -> int:
    """Least value of an owner: values are dealt by their leading (at most 31) bits."""
    lead = min(31, width)
    return (-(-(owner << lead) // owners)) << (width - lead)


def owner_answers(owners: int, width: int):
    """applyInPandas by owner: bitmaps of the values that came from several senders."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(_base(int(pdf["owner"].iloc[0]), owners, width))
        blocks = [base + np.cumsum(unrice(b, n, r), dtype=np.uint64) for b, n, r in zip(pdf["block"], pdf["n"], pdf["bits"])]
        _, inverse, counts = np.unique(np.concatenate(blocks), return_inverse=True, return_counts=True)
        flags = np.split((counts > 1)[inverse], np.cumsum(pdf["n"].to_numpy())[:-1])
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bitmap": [np.packbits(f).tobytes() for f in flags], "n": pdf["n"]})

    return run


def mark_suspects(width: int):
    """cogroup by sender: the rows of a sender and its bitmaps, to the digests of its suspects."""

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"digest": pd.Series(dtype=object)})
        values, inverse, counts = np.unique(fingerprints(rows["digest"], width), return_inverse=True, return_counts=True)
        answers = answers.sort_values("owner")
        shared = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for b, n in zip(answers["bitmap"], answers["n"])]
        suspect = (np.concatenate(shared) | (counts > 1))[inverse]
        return pd.DataFrame({"digest": rows["digest"][suspect].drop_duplicates()})

    return run


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text, and all empty texts are equal. The row with the largest
    doc_id stays. A null doc_id counts as the smallest; if a group has no other, keep_id is null and its rows stay. Rows of one
    doc_id and one text are the same document twice: both say kept. Other columns are not looked at. No rows, no result rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    rows = cut_lineage(docs.select("doc_id", digest.alias("digest"), F.spark_partition_id().alias("part")))
    total, parts = rows.agg(F.count(F.lit(1)), F.countDistinct("part")).head()
    n_senders, owners = (max(1, min(parts, max(LEAST, total // n))) for n in (SENDER_ROWS, OWNER_ROWS))
    width = min(62, max(16, int(total).bit_length() + SPARE_BITS))
    slim = rows.select(F.pmod("part", F.lit(n_senders)).alias("sender"), "digest").groupBy("sender")
    blocks = slim.applyInPandas(senders(owners, width), "owner long, sender int, n int, bits int, block binary")
    answers = blocks.groupBy("owner").applyInPandas(owner_answers(owners, width), "sender int, owner long, bitmap binary, n int")
    suspects = slim.cogroup(answers.groupBy("sender")).applyInPandas(mark_suspects(width), "digest binary")
    suspects = cut_lineage(suspects.distinct())
    texts = docs.withColumn("digest", digest).join(suspects, "digest", "left_semi").select("text", "doc_id")
    groups = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut_lineage(groups.where("group_size > 1").select(digest.alias("digest"), F.length("text").alias("size"), "keep_id", "group_size"))
    out = rows.select("doc_id", "digest").join(groups.select("digest", "keep_id", "group_size"), "digest", "left")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that have an equal text with a larger doc_id; of rows equal in doc_id and text one stays. All columns stay
    as they are, whatever their names."""
    found = cut_lineage(exact_duplicates(docs))
    digest = F.unhex("text_sha256").alias("gone_digest")
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("gone"), digest)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))

    def keyed(other: DataFrame, how: str) -> DataFrame:
        return rows.join(other, rows["id"].eqNullSafe(other["gone"]) & (rows["digest"] == other["gone_digest"]), how)

    twice = found.where("kept AND group_size > 1").groupBy(F.col("doc_id").alias("gone"), digest).count().where("count > 1").drop("count")
    if twice.isEmpty():
        return keyed(dropped, "left_anti").select("row.*")
    once = keyed(twice, "left_semi").dropDuplicates(["id", "digest"])
    return keyed(dropped.union(twice), "left_anti").union(once).select("row.*")
