"""Quality classifier from weak labels.

Overlapping heuristics vote bad or nothing on every document: each looks for one defect, none has evidence that a document is good. So
'good' means that no defect shows, and how often a heuristic is right about good documents is known only from its wrong votes. Expectation-maximisation over the counts of vote patterns (all
documents; at most 3 ** heuristics patterns, however large the corpus) estimates how often each heuristic is right, and gives every
pattern a posterior. A linear scorer over hashed word-shape features learns the posteriors, so documents on which the heuristics say
nothing, or disagree, are judged by what else they have in common with the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_BLANK, U, hash_spans, list_array, map_slices, mix, segment_sums, spans, unused

DIMS, SAMPLE, THRESHOLD = 1024, 4_000, 0.5
NEW = ("votes", "posterior", "score")

#: Classes of bytes: 0 lower case or not ASCII, 1 upper case, 2 digit, 3 mark of a sentence, 4 other mark, 5 blank.
KIND = np.full(256, 4, np.uint8)
KIND[128:] = KIND[97:123] = 0
KIND[65:91] = 1
KIND[48:58] = 2
KIND[[ord(c) for c in ".,;:'\"!?-()"]] = 3
KIND[[9, 10, 11, 12, 13, 32]] = 5
SHAPE = KIND.copy()
SHAPE[[ord(c) for c in "!|.,?"]] = [10, 11, 12, 13, 14]

#: Heuristics: a measure of a document, up to where it votes good, and from where it votes bad. Each looks for one defect: it cannot
#: tell that a document is good, so it votes bad or nothing.
NEVER = -1.0
HEURISTICS = (
    ("repeated", NEVER, 0.25),  # share of words equal to the word before
    ("sameness", NEVER, 0.85),  # share of words seen before among the text's words of four letters or more
    ("symbols", NEVER, 0.08),  # other marks by letter
    ("capitals", NEVER, 0.50),  # capitals by letter
    ("shouting", NEVER, 0.30),  # exclamation marks by word
    ("columns", NEVER, 0.20),  # words that are nothing but marks
    ("endings", NEVER, 0.15),  # words that end in another mark than one of a sentence
    ("runs", NEVER, 0.04),  # marks that follow the same mark, by letter
    ("digits", NEVER, 0.40),  # digits by letter or digit
)


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of measures for each text; and starts, ends and offsets of its words."""
    starts, ends, by_text = spans(data, offsets, NOT_BLANK)
    kinds = KIND[data]

    def by_bytes(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    letters, marks = (kinds == 0) | (kinds == 1), np.concatenate([[0], np.cumsum(kinds >= 3)])
    n_letters, n_words = np.maximum(by_bytes(letters), 1), np.maximum(np.diff(by_text), 1)
    hashes = hash_spans(data, starts, ends)
    only_marks = marks[ends] - marks[starts] == ends - starts
    again = np.zeros(len(starts), bool)
    if len(starts):
        again[1:] = hashes[1:] == hashes[:-1]
        again[by_text[:-1][np.diff(by_text) > 0]] = False

    def by_words(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[by_text[1:]] - total[by_text[:-1]]

    long = ends - starts >= 4
    n_long = by_words(long)
    distinct = np.array([len(np.unique(hashes[a:b][long[a:b]])) for a, b in zip(by_text[:-1], by_text[1:])], np.int64)
    n_digits = by_bytes(kinds == 2)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kinds[1:] >= 3) & (kinds[1:] < 5)
    odd_end = kinds[ends - 1] == 4 if len(ends) else np.zeros(0, bool)
    columns = [
        by_words(again) / n_words, 1 - distinct / np.maximum(n_long, 1), by_bytes(kinds == 4) / n_letters, by_bytes(kinds == 1) / n_letters,
        by_bytes(data == 33) / n_words, by_words(only_marks) / n_words, by_words(odd_end) / n_words, by_bytes(same) / n_letters, n_digits / (n_letters + n_digits),
    ]
    columns[1][n_long == 0] = 0.7  # says nothing
    return np.stack(columns, 1).reshape(len(offsets) - 1, len(HEURISTICS)), starts, ends, by_text


def votes(values: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """1 good, 2 bad, 0 nothing; all heuristics find a text without words bad."""
    good, bad = (np.array([h[k] for h in HEURISTICS]) for k in (1, 2))
    out = np.where(values <= good, 1, np.where(values >= bad, 2, 0))
    out[empty] = 2
    return out


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, by_text: np.ndarray, dims: int) -> np.ndarray:
    """Hashed features of every word, five columns: first and last shape, last two shapes, length, shapes at the gap, repetition."""
    if not len(starts):
        return np.zeros((0, 5), np.int64)
    shapes = SHAPE[data].astype(np.int64)
    head, tail, before = shapes[starts], shapes[ends - 1], shapes[np.maximum(ends - 2, starts)]
    following = np.append(head[1:], 0)
    following[by_text[1:][by_text[1:] > 0] - 1] = 31
    hashes = hash_spans(data, starts, ends)
    repeat = np.zeros(len(starts), np.int64)
    for back in (1, 2, 3):
        repeat[back:] |= (hashes[back:] == hashes[:-back]).astype(np.int64) << (back - 1)
    columns = [head * 32 + tail, before * 32 + tail, np.minimum(ends - starts, 40), tail * 32 + following, repeat]
    return np.stack([(mix((c + (k << 20)).astype(np.uint64)) & U(dims - 1)).astype(np.int64) for k, c in enumerate(columns)], 1)


def patterns_of(values: np.ndarray, by_text: np.ndarray) -> np.ndarray:
    """The votes of all heuristics as one number."""
    return votes(values, np.diff(by_text) == 0) @ (3 ** np.arange(len(HEURISTICS)))


def _vote_rows():
    def fn(batch, data, offsets):
        values, _, _, by_text = measures(data, offsets)
        return pa.RecordBatch.from_arrays([pa.array(patterns_of(values, by_text).astype(np.int32))], ["pattern"])

    return map_slices(fn)


def _examples(posterior: np.ndarray, dims: int):
    def fn(batch, data, offsets):
        values, starts, ends, by_text = measures(data, offsets)
        found = features(data, starts, ends, by_text, dims)
        vectors = [np.bincount(found[a:b].ravel(), minlength=dims) / max(1, b - a) for a, b in zip(by_text[:-1], by_text[1:])]
        flat = np.concatenate(vectors).astype(np.float32)
        target = posterior[patterns_of(values, by_text)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(target), list_array(np.arange(len(vectors) + 1) * dims, pa.array(flat))], ["text_key", "posterior", "vector"])

    return map_slices(fn)


def _scores(posterior: np.ndarray, weights: np.ndarray, bias: float, own: str):
    def fn(batch, data, offsets):
        values, starts, ends, by_text = measures(data, offsets)
        pattern = patterns_of(values, by_text)
        per_word = weights[features(data, starts, ends, by_text, len(weights))].sum(1)
        n = np.diff(by_text)
        z = segment_sums(per_word, by_text) / np.maximum(n, 1) + bias
        score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)
        keep = [k for k, f in enumerate(batch.schema.names) if f != own]
        new = [pa.array(pattern.astype(np.int32)), pa.array(posterior[pattern]), pa.array(score)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new], [*(batch.schema.names[k] for k in keep), *NEW])

    return map_slices(fn, own)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior that a pattern is good, P(vote | class) by heuristic (heuristic, class, vote), and the share of good ones.

    patterns: votes by pattern and heuristic. A pattern without a bad vote starts as probably good, any other as probably bad.
    """
    hot = np.eye(3)[patterns]  # pattern, heuristic, vote
    good = np.where((patterns == 2).any(1), 0.1, 0.9)
    for _ in range(rounds):
        chance, share = [], []
        for weight in (counts * good, counts * (1 - good)):
            tally = np.einsum("p,phv->hv", weight, hot) + 0.5
            chance.append(tally / tally.sum(1, keepdims=True))
            share.append(weight.sum() + 1.0)
        logs = [np.log(s) + np.einsum("phv,hv->p", hot, np.log(c)) for s, c in zip(share, chance)]
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -60, 60)))
    return good, np.stack(chance, 1), share[0] / sum(share)


def fit_linear(vectors: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes of equal weight (Adam, full batches)."""
    weights, first, second = (np.zeros(vectors.shape[1] + 1) for _ in range(3))
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    vectors = np.hstack([vectors, np.ones((len(vectors), 1), vectors.dtype)]).astype(np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(vectors @ weights.astype(np.float32), -60, 60)))
        step = vectors.T @ (weight * (p - target)).astype(np.float32) + decay * weights * np.append(np.ones(len(weights) - 1), 0)
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        weights -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return weights[:-1], float(weights[-1])


def with_quality(docs: DataFrame, text: str = "text", dims: int = DIMS, sample: int = SAMPLE) -> DataFrame:
    """docs with the columns votes (the heuristics' votes as one number), posterior (what they say together: the chance that the
    document is good) and score (the linear scorer's, 0 to 1); columns of these names are replaced, all others stay.

    Votes and their counts come from all documents. The scorer is fitted on about `sample` distinct texts: those with the least
    hashes. A text without words, null or not, has score 0; equal texts have equal scores. Labels are not looked at. An empty table
    gives no rows.
    """
    docs = docs.drop(*NEW)
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = source.mapInArrow(_vote_rows(), "pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy("pattern").toPandas()  # 3 ** heuristics rows at most
    posterior, weights, bias = np.ones(3 ** len(HEURISTICS)), np.zeros(dims), 0.0
    if len(counts):
        table = counts["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3
        posterior[counts["pattern"]] = expectation_maximisation(table, counts["n"].to_numpy(float))[0]
        share = int((1 << 30) * min(1.0, sample / counts["n"].sum()))
        chosen = source.withColumn("text_key", F.xxhash64("text")).where(F.pmod("text_key", F.lit(1 << 30)) < share)
        chosen = chosen.groupBy("text_key").agg(F.first("text").alias("text"))
        fitted = chosen.mapInArrow(_examples(posterior, dims), "text_key long, posterior double, vector array<float>").toPandas().sort_values("text_key")
        if len(fitted):
            weights, bias = fit_linear(np.stack(fitted["vector"].to_numpy()), fitted["posterior"].to_numpy())
    own = unused(docs.columns, "_text")
    rows = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(_scores(posterior, weights, bias, own), f"{kept}, votes int, posterior double, score double")


def drop_poor(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score is below the threshold."""
    others = {c: unused([*docs.columns, *NEW], f"_own_{c}") for c in docs.columns if c.lower() in NEW}
    return with_quality(docs.withColumnsRenamed(others)).where(F.col("score") >= threshold).select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])
