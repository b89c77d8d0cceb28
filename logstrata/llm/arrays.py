"""Arrow and numpy helpers: the bytes of many texts as one array, words and shingles as 64-bit hashes.

Work goes through slices of a few megabytes, so memory is bounded by `SLICE` and the longest single text, never by a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U = np.uint64

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1 << 62, size=256, dtype=np.uint64) | U(1)
_BASE = int(_rng.integers(1 << 62)) | 1
_MULT = _rng.integers(1 << 62, size=64, dtype=np.uint64) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words without punctuation: ASCII letters and digits, and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of lines: all but the line feed.
NOT_FEED = np.ones(256, bool)
NOT_FEED[10] = False


def unused(columns: list[str], name: str) -> str:
    """name, or name with underscores after it, that is none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sizes(col: pa.Array) -> np.ndarray:
    return np.diff(_offsets(col))


def _offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]


def binary(col: pa.Array) -> pa.Array:
    """The texts as large_binary without nulls (null counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    return col.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_binary array, and the len + 1 offsets into them."""
    offsets = _offsets(col) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch with at most `limit` bytes of text each, or one text; with the bytes and offsets of the texts."""
    col = binary(batch.column(batch.schema.get_field_index(text)))
    if not len(col):
        return
    ends = np.cumsum(sizes(col))
    at = 0
    while at < len(col):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at), *flat(col.slice(at, to - at))
        at = to


def map_slices(fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], text: str = "text", limit: int = SLICE):
    """A function for mapInArrow that applies fn(rows, bytes, offsets) slice by slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                yield fn(*part)

    return run


def spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with keep[byte] that lie in one text, and the len + 1 offsets of runs by text."""
    return runs(keep[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes that lie in one text and cross no cut, and the len + 1 offsets of runs by text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    at = np.flatnonzero(edge)
    first = inside[at[:-1]]
    starts, ends = at[:-1][first], at[1:][first]
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = _POWERS[k]
            _POWERS[k] = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
    return _POWERS


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of the bytes of each span (after fold[byte], if given). Spans must be sorted and disjoint.

    A polynomial in random byte values: prefix sums modulo 2**64 give the hash of any span in constant time.
    """
    out = np.empty(len(starts), np.uint64)
    table = mix(_BYTE + U(seed)) | U(1)
    table = table[fold] if fold is not None else table
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        up, down = (p[: b - a + 1] for p in _powers(b - a + 1))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * up[:-1], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _MULT[63])
        at = to
    return out


def grams(hashes: np.ndarray, offsets: np.ndarray, k: int, mask: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k consecutive hashes from each place that has them in its own text, and those places. mask: only these of the k count."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    places = np.flatnonzero(left >= k)
    total = np.zeros(n, np.uint64)
    for j in mask or range(k):
        total += hashes[j : j + n] * _MULT[j]
    return mix(total[places]), places


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between successive offsets; it depends on a segment's own values only, to the last bit."""
    out, filled = np.zeros(len(offsets) - 1, values.dtype), np.diff(offsets) > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, offsets[:-1][filled])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
