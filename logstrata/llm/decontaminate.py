"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions that count; the others may differ. Hashes of the benchmark's tokens under every mask are joined with
those of all documents, and each hit is extended along its diagonal (document position - item position) over substituted tokens.

Documents first meet a Bloom filter of the benchmark's hashes, whose size is bounded whatever the benchmark's (it is the only thing that
is broadcast, and a filter only: what it lets through is joined). Only stretches around hits are shuffled, as 64-bit token hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import ALNUM, U, grams, hash_spans, list_array, map_slices, mix, runs, signed

#: Positions that count, six out of spans of 6 to 10 tokens: every overlap with an item of 13 tokens or more holds a hit, wherever its
#: substituted tokens are.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 3, 4, 5, 6, 7), (0, 1, 2, 3, 5, 8))
#: Least and greatest number of tokens of a shorter item, and the masks that do the same for it. Up to four tokens all must be equal.
SHORT = (
    (10, 12, ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))), (7, 9, ((0, 1, 3, 4),)), (6, 6, ((0, 1, 2),)), (5, 5, ((0, 1),)),
    *((n, n, (tuple(range(n)),)) for n in (4, 3, 2, 1)),
)
#: Items with fewer tokens, words that any clean text may hold, match nothing, unless `shortest` says otherwise.
SHORTEST = 4
#: An overlap counts from so many equal tokens and this share of equal ones in it.
TOKENS, SHARE = 13, 0.8
#: The filter has 2**MAX_BITS bits at most: 32 MB.
MAX_BITS = 28


def marks_and_signs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters that begin at these bytes (0xC2, or 0xE0 and above): which are marks, which belong to scripts that are written
    without blanks between words (Han, kana, Thai, Lao, Burmese, Khmer), and their numbers of bytes. Blocks of Unicode decide."""
    a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
    full = (a == 0xEF) & ((b == 0xBC) | (b == 0xBD))  # full-width forms of ASCII, half-width kana
    full_mark = (b == 0xBC) & ((c < 0x90) | (c >= 0x9A) & (c <= 0xA0) | (c >= 0xBB)) | (b == 0xBD) & ((c == 0x80) | (c >= 0x9B) & (c <= 0xA5))
    mark = (a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA)) | (a == 0xE2) & (b < 0xB0) | (a == 0xE3) & (b == 0x80) & ~np.isin(c, (0x85, 0x86, 0x87)) | full & full_mark | (a == 0xF0) & (b == 0x9F)
    sign = (
        (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)) | (a >= 0xE3) & (a <= 0xE9) & ~mark
        | (a == 0xEF) & ((b >= 0xA4) & (b <= 0xAB) | (b == 0xBD) & (c >= 0xA6) | (b == 0xBE) & (c < 0xA0)) | (a == 0xF0) & (b >= 0xA0) & (b <= 0xAF)
    )
    return mark, sign, np.where(a == 0xC2, 2, np.where(a >= 0xF0, 4, 3))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits; the text is already in lower case) and their offsets by text. In scripts without
    blanks between words every character is a word."""
    inside, cuts = ALNUM[data], None
    at = np.flatnonzero((data == 0xC2) | (data >= 0xE0))
    if len(at):
        mark, sign, size = marks_and_signs(data, at)
        for k in range(4):
            own = at[mark & (size > k)] + k
            inside[own[own < len(data)]] = False
        cuts = np.minimum(np.concatenate([at[sign], at[sign] + size[sign]]), len(data))
    starts, ends, by_text = runs(inside, offsets, cuts)
    return hash_spans(data, starts, ends), by_text


def numbered(masks, shortest: int) -> list[tuple[int, int, float, tuple]]:
    """Number, least and greatest number of an item's tokens, and positions, of every mask: `masks` are for what SHORT leaves."""
    groups = [(SHORT[0][1] + 1, float("inf"), masks), *SHORT]
    return [(k, max(low, shortest), high, mask) for k, (low, high, mask) in enumerate((a, b, m) for a, b, group in groups for m in group) if high >= shortest]


def masked(hashes: np.ndarray, by_text: np.ndarray, masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes under every mask, their first positions, and the masks' places in the list. A text that is shorter than a mask's span
    counts under no mask."""
    found = [grams(hashes, by_text, mask[-1] + 1, mask) for *_, mask in masks]
    keys = [mix(h + U(k)) for (k, *_), (h, _) in zip(masks, found)]
    return np.concatenate(keys), np.concatenate([p for _, p in found]), np.repeat(np.arange(len(masks)), [len(h) for h in keys])


def _item_rows(masks):
    def fn(batch, data, offsets):
        hashes, by_text = tokens(data, offsets)
        keys, places, which = masked(hashes, by_text, masks)
        length = np.diff(by_text)[np.searchsorted(by_text, places, "right") - 1]
        own = (np.array([low for _, low, _, _ in masks])[which] <= length) & (length <= np.array([high for _, _, high, _ in masks])[which])
        keys, places = keys[own], places[own]
        order = np.argsort(places, kind="stable")
        keys, places = keys[order], places[order]
        cuts = np.searchsorted(places, by_text)
        first = np.repeat(by_text[:-1], np.diff(cuts))
        seeds = pa.StructArray.from_arrays([pa.array(signed(keys)), pa.array((places - first).astype(np.int32))], ["key", "at"])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), list_array(by_text, pa.array(signed(hashes))), list_array(cuts, seeds)], ["item_id", "tokens", "seeds"]
        )

    return map_slices(fn)


def _stretches(masks, bits: np.ndarray, size: int, reach: int):
    """Stretches of a document around its hits in the filter: hits with overlapping surroundings share one."""

    def fn(batch, data, offsets):
        hashes, by_text = tokens(data, offsets)
        keys, places, _ = masked(hashes, by_text, masks)
        hit = np.ones(len(keys), bool)
        for slot in (keys >> U(64 - size), keys & U((1 << size) - 1)):
            hit &= (bits[slot >> U(6)] >> (slot & U(63))) & U(1) == 1
        keys, places = keys[hit], places[hit]
        order = np.argsort(places, kind="stable")
        keys, places = keys[order], places[order]
        text = np.searchsorted(by_text, places, "right") - 1
        low = np.maximum(by_text[text], places - reach)
        high = np.minimum(by_text[text + 1], places + reach)
        new = np.ones(len(places), bool)
        new[1:] = (low[1:] > high[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        cuts = np.append(first, len(places))
        starts, ends = low[first], high[cuts[1:] - 1] if len(first) else first
        size_of = ends - starts
        offs = np.concatenate([[0], np.cumsum(size_of)])
        values = np.concatenate([hashes[a:b] for a, b in zip(starts, ends)]) if len(first) else hashes[:0]
        inner = places - np.repeat(starts, np.diff(cuts))
        seeds = pa.StructArray.from_arrays([pa.array(signed(keys)), pa.array(inner.astype(np.int32))], ["key", "at"])
        owner = text[first]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner)), pa.array((starts - by_text[owner]).astype(np.int64)), list_array(offs, pa.array(signed(values))), list_array(cuts, seeds)],
            ["doc_id", "first", "tokens", "seeds"],
        )

    return map_slices(fn)


def best_overlap(same: np.ndarray, share: float) -> tuple[int, int, int]:
    """Start, end and equal tokens of the stretch of a diagonal with most equal tokens among those with `share` of equal ones (the
    first, if several), ends being equal tokens; zeros if none is equal.

    With score(i) = equal tokens - share * tokens before i, a stretch counts if the score at its end is at least that at its start;
    for each end the first start that is low enough is found by binary search in the running minimum.
    """
    if not same.any():
        return 0, 0, 0
    score = np.concatenate([[0.0], np.cumsum(same - share)])
    count = np.concatenate([[0], np.cumsum(same)])
    low = np.minimum.accumulate(score)
    start = np.searchsorted(-low, -(score + 1e-9))
    start = np.minimum(start, np.arange(len(score)))
    total = count - count[start]
    end = int(np.argmax(total))
    begin = int(start[end])
    hits = np.flatnonzero(same[begin:end])
    return (begin + int(hits[0]), begin + int(hits[-1]) + 1, int(total[end])) if len(hits) else (0, 0, 0)


def _overlaps(share: float):
    def run(batches):
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            out = []
            doc, doc_at = np.asarray(columns["tokens"].flatten()), np.concatenate([[0], np.cumsum(np.asarray(columns["tokens"].value_lengths()))])
            item, item_at = np.asarray(columns["item_tokens"].flatten()), np.concatenate([[0], np.cumsum(np.asarray(columns["item_tokens"].value_lengths()))])
            for k, shift in enumerate(columns["diagonal"].to_pylist()):
                d, i = doc[doc_at[k] : doc_at[k + 1]], item[item_at[k] : item_at[k + 1]]
                a, b = max(0, -shift), min(len(i), len(d) - shift)
                begin, end, equal = best_overlap(d[a + shift : b + shift] == i[a:b], share)
                out.append((a + begin, a + end, equal))
            begin, end, equal = (pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), ())))
            names = ["doc_id", "item_id", "first", "diagonal", "n_item"]
            yield pa.RecordBatch.from_arrays([*(columns[n] for n in names), begin, end, equal], [*names, "begin", "end", "equal"])

    return run


def hash_filter(keys: DataFrame, size: int) -> np.ndarray:
    """Bloom filter of 2**size bits with two bits for each key, its leading and its trailing ones; its words are gathered, at most
    2**size / 64."""
    slots = keys.select(F.explode(F.expr(f"array(shiftrightunsigned(key, {64 - size}), key & {(1 << size) - 1}L)")).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    found = words.toPandas()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks=MASKS, tokens_needed: int = TOKENS, share: float = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, doc_start, doc_end, item_start, item_end (token positions,
    end exclusive), equal_tokens, item_tokens. Documents without an overlap have no row.

    Tokens are runs of letters and digits in lower case, single characters in scripts without blanks between words. An overlap is a stretch of aligned tokens with at least `share` of equal
    ones and at least `tokens_needed` equal ones, or `share` of the item's tokens, if that is fewer; of a document's overlaps with an item
    the one with most equal tokens is given (ties: the first in the document). It must hold a hit, all positions of one mask equal:
    with the default masks, tokens_needed and share every overlap does. Items of fewer than `shortest` tokens match nothing. Null texts
    are empty; rows with a null id take part and return a null id. Rows that repeat an id are reported together. Other columns are not looked at. An empty table gives no rows.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.lower(F.coalesce(F.col(item_text), F.lit(""))).alias("text"))
    id_type = items.schema["item_id"].dataType.simpleString()
    known = numbered(masks, max(1, shortest))
    items = items.mapInArrow(_item_rows(known), f"item_id {id_type}, tokens array<long>, seeds array<struct<key:long,at:int>>")
    items = cut_lineage(items.withColumn("item_no", F.monotonically_increasing_id()))
    seeds = items.select("item_no", F.explode("seeds").alias("seed")).select("item_no", "seed.key", F.col("seed.at").alias("item_at"))
    held = [F.max(F.size("tokens").between(low, high) if high < float("inf") else F.size("tokens") >= low) for _, low, high, _ in known]
    reach, total, *held = items.agg(F.max(F.size("tokens")), F.sum(F.size("seeds")), *held).head()
    used = [mask for mask, some in zip(known, held) if some] or known[:1]  # documents need no masks that are for no item
    size = min(MAX_BITS, max(16, int(total or 0).bit_length() + 8))
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(seeds, size))

    def scan(batches, masks=used, reach=reach or 0):
        yield from _stretches(masks, bits.value, size, reach)(batches)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    doc_type = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInArrow(scan, f"doc_id {doc_type}, first long, tokens array<long>, seeds array<struct<key:long,at:int>>")
    found = cut_lineage(found.withColumn("no", F.monotonically_increasing_id()))
    places = found.select("no", F.explode("seeds").alias("seed")).select("no", "seed.key", F.col("seed.at").alias("at"))
    hits = places.join(seeds, "key").select("no", "item_no", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = cut_lineage(hits)
    work = hits.join(found.select("no", "doc_id", "first", "tokens"), "no")
    work = work.join(items.select("item_no", "item_id", F.col("tokens").alias("item_tokens"), F.size("tokens").alias("n_item")), "item_no")
    schema = f"doc_id {doc_type}, item_id {id_type}, first long, diagonal int, n_item int, begin long, end long, equal long"
    best = work.select("doc_id", "item_id", "first", "diagonal", "n_item", "tokens", "item_tokens").mapInArrow(_overlaps(share), schema)
    best = best.where(F.col("equal") >= F.least(F.lit(tokens_needed), F.ceil(F.col("n_item") * share)))
    start = F.col("first") + F.col("diagonal") + F.col("begin")
    row = F.struct((-F.col("equal")).alias("less"), start.alias("doc_start"), (start + F.col("end") - F.col("begin")).alias("doc_end"), F.col("begin").alias("item_start"), F.col("end").alias("item_end"), F.col("n_item").cast("long").alias("item_tokens"))
    out = best.groupBy("doc_id", "item_id").agg(F.min(row).alias("row"))
    return out.select("doc_id", "item_id", "row.doc_start", "row.doc_end", "row.item_start", "row.item_end", (-F.col("row.less")).alias("equal_tokens"), "row.item_tokens")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps with a benchmark item."""
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.select(F.struct("doc_id", key.alias("text_key")).alias("doc_id"), "text")  # ids may be null or repeat
    gone = overlaps(keyed, benchmark).select(F.col("doc_id.doc_id").alias("gone"), F.col("doc_id.text_key").alias("gone_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & (key == gone["gone_key"]), "left_anti").select(*docs.columns)
