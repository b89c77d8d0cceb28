"""Repeated lines by winnowing.

A document is the sequence of its non-blank lines, each a 128-bit hash with a number of words. A window starts at a line and takes
as many lines as it needs for `words` words. Windows of equal content select the same line, the one with the least hash, so two
documents that share a run of lines of that many words share a selected line inside it (Schleimer, Wilkerson and Aiken, 2003).

1. Selected lines are fingerprints: about two of w + 1, and none of a document that is too short. Those that occur once in the corpus
   are dropped by a count; most documents leave here.
2. Positions are joined by fingerprint. Around each remaining one the match is extended both ways, window by window: every window that
   selected it is named by the hash of its lines, the shortest windows that end at a line too, so a match reaches a common run's last
   line. A window seen before, in an earlier document or further up, is a repeat.
3. Windows that overlap or touch join to runs; the later runs go, the first occurrence stays.

No pair of positions is ever formed: a passage in a third of all documents costs each of them a few rows, and first occurrences are
minima that combine before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut_lineage
from .arrays import NOT_BLANK, NOT_FEED, U, hash_spans, list_array, map_slices, mix, signed, spans

WORDS, BLANKS = 50, " \t\x0b\f\r"


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: start, end, two hashes (a pair of 64 bits), words; and their offsets by text, as the last column."""
    starts, ends, by_text = spans(data, offsets, NOT_FEED)
    word_starts, _, _ = spans(data, offsets, NOT_BLANK)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    keep = words > 0
    by_text = np.concatenate([[0], np.cumsum(keep)])[by_text]
    starts, ends, words = starts[keep], ends[keep], words[keep]
    hashes = np.stack([hash_spans(data, starts, ends), hash_spans(data, starts, ends, seed=7)])
    return starts, ends, hashes, words, by_text


def windows(hashes: np.ndarray, words: np.ndarray, by_text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, end line and selected line of every window: the shortest run from a line on with `least` words."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + least)  # first end with enough words
    limit = np.repeat(by_text[1:], np.diff(by_text))
    first = np.flatnonzero(ends <= limit)
    ends = ends[first]
    pick = first.copy()
    for step in range(1, int((ends - first).max(initial=0))):
        other = np.minimum(first + step, n - 1)
        better = (first + step < ends) & (hashes[0][other] < hashes[0][pick])
        pick[better] = other[better]
    return first, ends, pick


def backward_windows(words: np.ndarray, by_text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end line of the shortest run with `least` words that ends at each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.searchsorted(total, total[1:] - least, "right") - 1  # last start with enough words
    some = first >= np.repeat(by_text[:-1], np.diff(by_text))
    return first[some], np.flatnonzero(some) + 1


def window_names(hashes: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hash of the lines of each window, as two rows."""
    out = np.zeros((2, len(first)), np.uint64)
    for step in range(int((ends - first).max(initial=0))):
        inside = first + step < ends
        for k in range(2):
            out[k, inside] = mix(out[k, inside] * U(0x9E3779B97F4A7C15) + hashes[k][first[inside] + step])
    return out


def _winnow(least: int):
    def fn(batch, data, offsets):
        starts, ends, hashes, words, by_text = lines_of(data, offsets)
        first, to, pick = windows(hashes, words, by_text, least)
        heads = np.flatnonzero(np.diff(pick, prepend=-1))  # selected lines never go backwards, so windows of one stand together
        lines, cuts = pick[heads], np.append(heads, len(first))
        # a run that ends at a line goes with the window from its first line on: who shares the run shares that window
        more, ends = backward_windows(words, by_text, least)
        own = np.searchsorted(first, more)
        other = ends > to[own]
        own = np.concatenate([np.arange(len(first)), own[other]])
        order = np.argsort(own, kind="stable")
        first, to = np.concatenate([first, more[other]])[order], np.concatenate([to, ends[other]])[order]
        cuts = np.searchsorted(own[order], cuts)
        names = window_names(hashes, first, to)
        base = np.searchsorted(by_text, first, "right") - 1
        base = by_text[base]
        runs = pa.StructArray.from_arrays(
            [pa.array(signed(names[0])), pa.array(signed(names[1])), pa.array((first - base).astype(np.int32)), pa.array((to - base).astype(np.int32))],
            ["name", "more", "first", "end"],
        )
        seeds = pa.StructArray.from_arrays(
            [pa.array(signed(mix(hashes[0][lines] ^ hashes[1][lines]))), list_array(cuts, runs)], ["fingerprint", "windows"]
        )
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(by_text)), list_array(by_text, pa.array(words.astype(np.int32))), list_array(np.searchsorted(lines, by_text), seeds)],
            ["doc_id", "text_key", "n_lines", "words", "seeds"],
        )

    return map_slices(fn)


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, n_lines, removed_lines, removed_words, runs (array of first and end line).

    Lines are what stands between line feeds; lines without a word are left out and not counted. A line is removed if it lies in a run
    of lines with at least `words` words that, byte for byte, occurred earlier: in a document with a smaller doc_id or further up in the
    same one. Null ids come last, equal ids are ordered by text; rows equal in both count as one document and are treated alike. A null
    text has no lines. Other columns are not looked at.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    seeds = "array<struct<fingerprint:long,windows:array<struct<name:long,more:long,first:int,end:int>>>>"
    found = cut_lineage(source.mapInArrow(_winnow(words), f"doc_id {kind}, text_key binary, n_lines long, words array<int>, seeds {seeds}"))
    places = found.select("doc_id", "text_key", F.explode("seeds").alias("s")).select("doc_id", "text_key", "s.fingerprint", "s.windows")
    shared = places.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = places.join(cut_lineage(shared.select("fingerprint")), "fingerprint", "left_semi")
    matched = cut_lineage(matched.select("doc_id", "text_key", F.explode("windows").alias("w")).select("doc_id", "text_key", "w.*"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "first")
    earliest = matched.groupBy("name", "more").agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    earliest = cut_lineage(earliest.select("name", "more", "at"))
    later = matched.join(earliest, ["name", "more"]).where(order > F.col("at"))
    gone = cut_lineage(later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("gone")))
    gone = gone.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "gone")
    out = found.drop("seeds").join(gone, found["doc_id"].eqNullSafe(gone["own_id"]) & (found["text_key"] == gone["own_key"]), "left")
    out = out.withColumn("runs", F.expr("""aggregate(coalesce(gone, array()), CAST(array() AS ARRAY<STRUCT<first: INT, end: INT>>),
      (acc, x) -> IF(size(acc) > 0 AND element_at(acc, -1).end >= x.first,
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))"""))
    removed = F.expr("CAST(aggregate(runs, 0, (n, r) -> n + r.end - r.first) AS LONG)")
    removed_words = F.expr("CAST(aggregate(runs, 0, (n, r) -> n + aggregate(slice(words, r.first + 1, r.end - r.first), 0, (m, w) -> m + w)) AS LONG)")
    return out.select("doc_id", "text_key", "n_lines", removed.alias("removed_lines"), removed_words.alias("removed_words"), "runs")


@F.pandas_udf(StringType())
def _left(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """Texts without the lines of their runs; lines without a word have no number and stay."""
    out = []
    for text, own in zip(texts, runs):
        kept, number, gone = [], 0, {n for r in own for n in range(r["first"], r["end"])}
        for line in (text or "").split("\n"):
            if not line.strip(BLANKS):
                kept.append(line)
                continue
            if number not in gone:
                kept.append(line)
            number += 1
        out.append("\n".join(kept))
    return pd.Series(out, dtype=object)


def without_runs(docs: DataFrame, runs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the lines of their runs (from repeated_runs) taken out of the text; rows are kept even if no line is left, and so are
    all other columns, whatever their names."""
    runs = runs.where("removed_lines > 0").select("doc_id", "text_key", "runs").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"))
    rows = rows.join(runs, rows["id"].eqNullSafe(runs["doc_id"]) & (rows["key"] == runs["text_key"]), "left").select("row", "runs")
    name = "`" + text.replace("`", "``") + "`"
    own = F.col("row").withField(name, _left(F.col("row").getField(text), "runs"))
    same = rows.where("runs IS NULL").select("row.*")
    return same.unionByName(rows.where("runs IS NOT NULL").select(own.alias("row")).select("row.*")).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
