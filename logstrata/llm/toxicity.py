"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (and of the word itself), found by hashing; a text's vector is the
mean over its words; two softmax outputs follow. Vectors and outputs are trained together, in numpy, on a bounded sample of labelled
documents. A misspelling that was never seen shares most n-grams with the word, and so its vector. An n-gram gets a vector if the
shares of toxic and other documents that have it differ by SURE standard errors; all others stay at zero, as there are many more
n-grams than labelled documents.

Everything is linear in the vectors up to the softmax, so a trained model comes down to one number for each n-gram: scoring looks up
those of the distinct words of a slice and averages them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import LOWER, NOT_BLANK, U, hash_spans, list_array, map_slices, mix, ragged, segment_sums, spans

BUCKETS, DIMS, SAMPLE, THRESHOLD = 1 << 17, 8, 2_000, 0.7
GRAMS = (3, 4, 5)
SCALE, SURE = 40.0, 4.0

_CODES = np.random.default_rng(11).integers(1 << 62, size=(max(GRAMS), 256), dtype=np.uint64)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (in bytes, with '<' and '>' around) of each word and of the word; and their offsets by word."""
    size = ends - starts
    wide = size + 2
    at = np.concatenate([[0], np.cumsum(wide)])
    raw = np.full(at[-1], ord("<"), np.uint8)
    raw[ragged(at[:-1] + 1, size)] = LOWER[data[ragged(starts, size)]]
    raw[at[1:] - 1] = ord(">")
    owner, keys = [np.arange(len(starts))], [hash_spans(data, starts, ends, LOWER) if len(starts) else np.zeros(0, np.uint64)]
    for n in GRAMS:
        count = np.maximum(wide - n + 1, 0)
        first = ragged(at[:-1], count)
        total = np.full(len(first), n, np.uint64)
        for j in range(n):
            total += _CODES[j][raw[first + j]]
        owner.append(np.repeat(np.arange(len(starts)), count))
        keys.append(mix(total))
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return (keys[order] % U(buckets)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(starts) + 1))


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the distinct words of a slice, the number of each word of the texts among them, and offsets by text."""
    starts, ends, by_text = spans(data, offsets, NOT_BLANK)
    _, first, inverse = np.unique(hash_spans(data, starts, ends, LOWER), return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    return starts[first[order]], ends[first[order]], number[inverse], by_text


def _examples(buckets: int):
    def fn(batch, data, offsets):
        starts, ends, number, by_text = distinct_words(data, offsets)
        keys, cuts = subwords(data, starts, ends, buckets)
        ids, weights = [], []
        for a, b in zip(by_text[:-1], by_text[1:]):
            words, times = np.unique(number[a:b], return_counts=True)
            count = cuts[words + 1] - cuts[words]
            own = keys[ragged(cuts[words], count)]
            unique, inverse = np.unique(own, return_inverse=True)
            ids.append(unique)
            weights.append(np.bincount(inverse, np.repeat(times / count / max(1, b - a), count), len(unique)))
        at = np.cumsum([0, *map(len, ids)])
        lists = [list_array(at, pa.array(np.concatenate(ids).astype(np.int32))), list_array(at, pa.array(np.concatenate(weights).astype(np.float32)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "label", "ids", "weights"])

    return map_slices(fn)


def telling(counts: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int, sure: float = SURE) -> np.ndarray:
    """Which buckets differ between classes, given the number of documents and of toxic documents that have each."""
    if not 0 < n_toxic < n:
        return np.zeros(len(counts), bool)
    share = counts / n
    error = np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / (n - n_toxic))) + 1e-9
    return np.abs(toxic / n_toxic - (counts - toxic) / (n - n_toxic)) >= sure * error


def _only(chosen: np.ndarray):
    """Examples without the buckets that are not chosen."""

    def run(batches):
        for batch in batches:
            ids, weights = (batch.column(k) for k in (2, 3))
            flat, values = np.asarray(ids.flatten()), np.asarray(weights.flatten())
            keep = chosen[flat]
            cuts = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])]
            lists = [list_array(cuts, pa.array(flat[keep])), list_array(cuts, pa.array(values[keep]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], batch.schema.names)

    return run


def train(rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, labels: np.ndarray, share: float, buckets: int = BUCKETS, dims: int = DIMS, rounds: int = 150, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Trains embeddings and softmax on documents given as (row, bucket, weight) triples; returns the log odds of label 1 that each
    bucket adds, and the bias. share: the share of label 1 that the loss assumes.

    Adam on full batches. With residuals r = p(1) - label, the gradient of the embeddings is (X' r) outer (w1 - w0), and that of w1 is
    E' X' r, so a step is one product with X and one with its transpose.
    """
    rng, n = np.random.default_rng(seed), len(labels)
    ids, at = np.unique(ids, return_inverse=True)
    model = {"E": rng.normal(0, 0.1, (len(ids), dims)), "W": rng.normal(0, 0.3, (2, dims)), "b": np.zeros(2)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    weight = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
    weights = weights * SCALE
    for t in range(1, rounds + 1):
        apart = model["W"][1] - model["W"][0]
        logits = np.bincount(rows, (model["E"] @ apart)[at] * weights, n) + model["b"][1] - model["b"][0]
        rest = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - labels) * weight
        pull = np.bincount(at, rest[rows] * weights, len(ids))
        up = pull @ model["E"]
        steps = {"E": np.outer(pull, apart) + decay * model["E"] / len(ids), "W": np.stack([-up, up]) + decay * model["W"], "b": np.array([-rest.sum(), rest.sum()])}
        for k, step in steps.items():
            first, second = moments[k]
            first += 0.1 * (step - first)
            second += 0.001 * (step**2 - second)
            model[k] -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
    out = np.zeros(buckets)
    out[ids] = model["E"] @ (model["W"][1] - model["W"][0]) * SCALE
    return out, float(model["b"][1] - model["b"][0])


def _scores(table, bias: float):
    def fn(batch, data, offsets):
        odds = table.value
        starts, ends, number, by_text = distinct_words(data, offsets)
        keys, cuts = subwords(data, starts, ends, len(odds))
        word = segment_sums(odds[keys].astype(float), cuts) / np.maximum(np.diff(cuts), 1)
        z = segment_sums(word[number], by_text) / np.maximum(np.diff(by_text), 1) + bias
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    return map_slices(fn)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", buckets: int = BUCKETS, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    held_out: crc32 of the id as text leaves 1 when divided by 3; such rows are never learned from. Of the others with a label,
    about `sample` of each class are learned from: those with the least hashes of the id. A null or empty text gets the score of
    the bias alone. A null id is never learned from and not held out; a null label counts as none; an id labelled several times counts
    as toxic if one says so. If no n-gram tells the classes apart, every score is 0.5. Other columns are not looked at.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    held_out = F.coalesce(remainder == 1, F.lit(False))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds, bias = np.zeros(buckets), 0.0
    kind = source.schema["doc_id"].dataType.simpleString()
    if counts:
        limit = F.coalesce(*(F.when(F.col("label") == k, int((1 << 30) * min(1.0, sample / n))) for k, n in counts.items()))
        chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit))  # about `sample` rows of each class
        examples = source.join(chosen, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
        schema = f"doc_id {kind}, label int, ids array<int>, weights array<float>"
        examples = cut_lineage(examples.mapInArrow(_examples(buckets), schema))
        n, n_toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).head()
        spread = examples.select("label", F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
        spread = spread.toPandas()  # a row for each bucket at most
        keep = np.zeros(buckets, bool)
        keep[spread["id"][telling(spread["n"].to_numpy(), spread["toxic"].to_numpy(), n, n_toxic)]] = True
        found = examples.mapInArrow(_only(keep), schema).toPandas().sort_values("doc_id", kind="stable")
        if keep.any():
            rows = np.repeat(np.arange(len(found)), found["ids"].map(len))
            share = min(max(counts.get(1, 0) / sum(counts.values()), 0.05), 0.5)
            odds, bias = train(rows, *(np.concatenate(found[c].to_numpy()).astype(t) for c, t in (("ids", np.int64), ("weights", float))), found["label"].to_numpy(), share, buckets)
    table = docs.sparkSession.sparkContext.broadcast(odds.astype(np.float32))
    out = source.mapInArrow(_scores(table, bias), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
