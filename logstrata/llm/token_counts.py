"""Token counts of whole texts: batch encoding in Arrow tasks that return lengths only.

Texts are cut at blanks, which the tokenizer drops and across which it neither normalises, merges nor looks for added tokens, so the
counts of the pieces add up. Work comes in slices of bounded bytes, however long or short the texts are; within a slice each distinct
piece is encoded once, in batches balanced by bytes, and lengths of pieces met before in the task are remembered (up to `remember`).
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_BLANK, hash_spans, map_slices, spans

TOKENIZER, BATCH_BYTES, REMEMBER = "word_bpe_49k.json", 64 << 10, 1_000_000
LIMIT = 2048


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def lengths(tokenizer, pieces: list[bytes], batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Number of tokens of each piece, encoded in batches of about equal bytes."""
    out, at = [], 0
    ends = np.cumsum([len(p) + 8 for p in pieces])
    while at < len(pieces):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_bytes, "right")))
        encoded = tokenizer.encode_batch_fast([p.decode() for p in pieces[at:to]], add_special_tokens=False)
        out += map(len, encoded)
        at = to
    return out


def _count(name: str, remember: int):
    known: dict[int, int] = {}

    def fn(batch, data, offsets):
        starts, ends, by_text = spans(data, offsets, NOT_BLANK)
        keys, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        found = [known.get(k, -1) for k in keys.tolist()]
        new = [k for k, n in enumerate(found) if n < 0]
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        if len(known) + len(new) > remember:
            known.clear()
        for k, n in zip(new, lengths(load(name), pieces)):
            found[k] = n
            known[int(keys[k])] = n
        totals = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[inverse])])[by_text] if len(starts) else np.zeros(len(by_text), np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(totals))], ["doc_id", "n_bytes", "n_tokens"]
        )

    return map_slices(fn)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT, remember: int = REMEMBER) -> DataFrame:
    """One row for each row of docs, in no order: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those of the tokenizer's library without begin, end or added special tokens; special strings inside a text count as
    the library takes them by default. A null text is empty and has none. Ids may be null or repeat. Other columns are not looked at.
    The tokenizer must drop white space and have no lstrip / rstrip tokens, as the default has; pieces are told apart by 64-bit hash.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(_count(tokenizer, remember), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
