"""Periodic runs of words: maximal stretches that repeat with a period at least three times over.

A word of a run with period q and length at least 3 * q stands in it three times or more, and so do all its words. Hence a word that
occurs less often within a segment is in no run of that segment, and splits it. Parts are counted anew, and split again, until every
word of every segment is frequent enough or the segment is too short (recursive frequency splitting). Most text is gone by then.

Surviving segments are scanned by lag. Of all lags only those are tried at which a gram, as long as the lag at least, occurs next: a
run's first q words form a primitive word, which stands in the run at multiples of q only, so a gram of 2**k >= q words from the run's
start occurs next exactly q further on. Prefix doubling names the grams of each length. So long segments do not need a scan for each
third of their length, and no lag of a run is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_BLANK, hash_spans, list_array, map_slices, ragged, spans

LEAST, TIMES = 24, 3


def segments(words: np.ndarray, by_text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which every word occurs `times` times or more, of `least` words or more; none crosses a text.

    words: a number for each word, equal for equal words.
    """
    starts, ends = by_text[:-1], by_text[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        some = ends - starts >= least
        starts, ends = starts[some], ends[some]
        if not len(starts):
            break
        sizes = ends - starts
        at = ragged(starts, sizes)
        segment = np.repeat(np.arange(len(starts)), sizes)
        order = np.lexsort((words[at], segment))
        w, s = words[at][order], segment[order]
        heads = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])]))
        counts = np.diff(heads, append=len(w))
        rare = np.zeros(len(at), bool)
        rare[order] = np.repeat(counts < times, counts)
        split = np.zeros(len(starts), bool)
        split[segment[rare]] = True
        done.append((starts[~split], ends[~split]))
        # what stands between rare words, in segments that have some
        inside = split[segment] & ~rare
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2] - 1
        crossing = segment[first] != segment[last]
        if crossing.any():  # neighbours in `at` that belong to different segments
            cuts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            starts_in = np.zeros(len(at), bool)
            starts_in[cuts] = True
            begin = inside & (np.concatenate([[True], ~inside[:-1]]) | starts_in)
            stop = inside & np.concatenate([~inside[1:] | starts_in[1:], [True]])
            first, last = np.flatnonzero(begin), np.flatnonzero(stop)
        starts, ends = at[first], at[last] + 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def possible_lags(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[int]:
    """Lags of all runs of words, ascending, and perhaps others: distances to the next equal gram that are at most the gram's length."""
    names, k, found = np.unique(words, return_inverse=True)[1].ravel(), 1, set()
    while True:
        n = len(names)
        order = np.argsort(names, kind="stable")
        again = np.diff(names[order]) == 0
        gaps = np.diff(order)[again]
        gaps = gaps[(gaps > k // 2) & (gaps <= k)]
        found.update(np.unique(gaps).tolist())
        if k >= len(words) // times or n <= k or not again.any():
            return sorted(q for q in found if max(least, times * q) <= len(words))
        names = np.unique(names[: n - k].astype(np.int64) * (int(names.max()) + 1) + names[k:], return_inverse=True)[1].ravel()
        k *= 2


def lag_scan(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start, then period."""
    runs: list[tuple[int, int, int]] = []
    for q in possible_lags(words, least, times):
        same = words[q:] == words[:-q]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        long = b - a + q >= max(least, times * q)
        for s, e in zip(a[long].tolist(), (b[long] + q).tolist()):
            # with a shorter period, the stretch lies in that period's run, which an earlier lag has found
            if not any(q % p == 0 and s >= x and e <= x + m for x, m, p in runs):
                runs.append((s, e - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _runs_of(least: int, times: int, collapse: bool):
    def fn(batch, data, offsets):
        starts, ends, by_text = spans(data, offsets, NOT_BLANK)
        words = hash_spans(data, starts, ends)
        found: list[tuple[int, int, int]] = []
        for a, b in zip(*(x.tolist() for x in segments(words, by_text, least, times))):
            found += [(a + s, m, q) for s, m, q in lag_scan(words[a:b], least, times)]
        table = np.array(found, np.int64).reshape(-1, 3)
        text = np.searchsorted(by_text, table[:, 0], "right") - 1
        runs = pa.StructArray.from_arrays([pa.array(table[:, 0] - by_text[text]), pa.array(table[:, 1]), pa.array(table[:, 2])], ["start", "length", "period"])
        columns = [batch.column(0), pa.array(np.diff(by_text)), list_array(np.searchsorted(table[:, 0], by_text), runs)]
        if collapse:
            dropped = np.zeros(len(words) + 1, np.int64)
            np.add.at(dropped, table[:, 0] + table[:, 2], 1)
            np.add.at(dropped, table[:, 0] + table[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(dropped)[:-1] == 0)
            columns.append(joined(data, starts[kept], ends[kept], np.searchsorted(kept, by_text)))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"][: len(columns)])

    return map_slices(fn)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, by_text: np.ndarray) -> pa.Array:
    """Texts of spans joined by one blank."""
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1  # where a word goes, if a blank follows every word
    out = np.full(int((sizes + 1).sum()) + 1, 32, np.uint8)
    for k in range(0, len(sizes), 100_000):
        part = slice(k, k + 100_000)
        out[ragged(at[part], sizes[part])] = data[ragged(starts[part], sizes[part])]
    ends_at = np.concatenate([[0], at + sizes + 1])[by_text]
    first, last = ends_at[:-1], np.maximum(ends_at[1:] - 1, ends_at[:-1])  # without the last word's blank
    raw = out.tobytes()
    return pa.array([raw[a:b].decode() for a, b in zip(first.tolist(), last.tolist())], pa.string())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, collapse: bool = True) -> DataFrame:
    """One row for each row of docs, in no order: doc_id, n_words, runs (array of start, length, period in words), collapsed.

    Words are what stands between ASCII blanks. A run is a stretch with smallest period q of max(least, times * q) words or more that
    no neighbouring word extends. Runs come by start, then period. `collapsed` has the words that no run contains after its first
    `period` words, joined by one blank (left out if `collapse` is false). times is 3 or more. Words are told apart by 64-bit hash.
    A null or empty text has no words and no runs. Ids may be null or repeat. Other columns are not looked at. A document is worked on
    by one task, in slices of bounded bytes; a text longer than a slice takes memory in proportion to its own length.
    """
    if times < 3 or least < 1:
        raise ValueError("times must be 3 or more, and least 1 or more")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    tail = ", collapsed string" if collapse else ""
    return source.mapInArrow(_runs_of(least, times, collapse), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>{tail}")


def strongest(runs: str = "runs") -> F.Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""
    return F.expr(f"""aggregate({runs}, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>),
      (a, r) -> IF(a IS NULL OR CAST(r.length AS DECIMAL(20)) * a.period > CAST(a.length AS DECIMAL(20)) * r.period, r, a))""")


def planted(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """The text, or with h = crc32(decimal id) and h % 10 = 0 its words joined by a blank, made periodic from word g % n on (g = h // 10, n words)."""
    h = f"crc32(CAST({doc_id} AS STRING))"
    body = f"""transform(array(regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w -> named_struct('w', w, 'n', size(w), 'g', CAST(floor({h} / 10) AS BIGINT)))"""
    cut = f"transform({body}, x -> named_struct('w', x.w, 'n', x.n, 'a', CAST(x.g % x.n AS INT), 'k', CAST(3 + x.g % 8 AS INT)))"
    period = f"transform({cut}, x -> named_struct('w', x.w, 'n', x.n, 'a', x.a, 'p', CAST(1 + (x.n - x.a) DIV x.k AS INT)))"
    made = f"transform({period}, x -> IF(x.n = 0, '', array_join(transform(x.w, (v, i) -> IF(i < x.a, v, element_at(x.w, 1 + x.a + (i - x.a) % x.p))), ' ')))"
    return F.expr(f"IF({h} % 10 = 0 AND {text} RLIKE '[^\\\\x20\\\\x09-\\\\x0D]', element_at({made}, 1), {text})")
