import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from logstrata.llm import exact_dedup as e

from .brute import frame


@given(st.lists(st.integers(0, 2**40 - 1), min_size=1, unique=True))
def test_code_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    bits = e.rice_bits(2**40, len(values))
    gaps = np.diff(values, prepend=values[:1] * 0)
    assert (np.cumsum(e.unrice(e.rice(gaps, bits), len(values), bits), dtype=np.uint64) == values).all()


def test_code_is_short():
    values = np.unique(np.random.default_rng(1).integers(2**20, size=4000, dtype=np.uint64))
    blob = e.rice(np.diff(values, prepend=values[:1] * 0), e.rice_bits(2**20, len(values)))
    assert 8 * len(blob) / len(values) < np.log2(2**20 / len(values)) + 2


def brute(docs):
    groups = defaultdict(list)
    for k, t in docs:
        groups[t or ""].append(k)
    out = []
    for k, t in docs:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((k, keep, len(groups[t or ""]), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = [(k, f"text {k % 37}" if k % 3 else f"own {k}") for k in range(400)] + [(1000 + k, "hot") for k in range(300)]
    docs += [(None, "hot"), (None, "alone"), (5000, None), (5001, ""), (5002, "é\n" * 9000), (5003, "é\n" * 9000), (7, "again"), (7, "again")]
    found = e.exact_duplicates(frame(spark, docs, 7))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs)


def test_empty_table(spark):
    assert e.exact_duplicates(frame(spark, []).where("false")).collect() == []


def test_rows_that_stay(spark):
    docs = frame(spark, [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (4, None), (5, "")])
    left = e.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(2, "a"), (3, "b"), (None, "c"), (5, "")], key=repr)

def test_clashing_columns_stay(spark):
    docs = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c")]
    table = frame(spark, docs).withColumns({"_digest": F.concat(F.lit("own "), "text"), "_key": F.col("text"), "row": F.col("text")})
    left = e.drop_exact_duplicates(table).collect()
    assert len(left) == 3 and all(r["_digest"] == f"own {r.text}" and r["_key"] == r.text == r["row"] for r in left)
