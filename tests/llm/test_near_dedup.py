import random

import numpy as np

from logstrata.llm import components as c
from logstrata.llm import near_dedup as n
from logstrata.llm.arrays import flat, binary
from logstrata.session import cut_lineage
import pyarrow as pa

from . import brute
from .brute import frame


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    text = lambda k: " ".join(word() for _ in range(k))
    docs = [text(rnd.randint(1, 60)) for _ in range(80)]
    passage = text(60)
    docs += [f"{text(rnd.randint(3, 25))} {passage} {text(rnd.randint(3, 25))}" for _ in range(60)]  # share most, are not alike
    base = text(100).split()
    for _ in range(80):  # a large group of near copies, some at the threshold
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(len(own))] = word()
        docs.append(" ".join(own))
    docs += [docs[0].upper(), docs[1].replace(" ", "\t "), "", None, "  \n ", "one two", "One TWO", "one two three four five"]
    return list(enumerate(docs))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(n, "FULL", 4)
    docs = corpus()
    want = brute.near(docs)
    found = n.near_duplicates(frame(spark, docs, 5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len({c for _, c in want.values()}) < len(docs) - 40


def test_missing_and_repeated_ids(spark):
    text = " ".join(map(str, range(40)))
    found = n.near_duplicates(frame(spark, [(None, text), (9, text + " x"), (9, "other"), (12, text), (None, "alone at last"), (3, "other")]))
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found.collect()), key=repr) == sorted(
        [(None, 9, False), (9, 9, True), (9, 3, False), (12, 9, False), (None, None, True), (3, 3, True)], key=repr
    )


def test_empty_table_and_stage(spark):
    assert n.near_duplicates(frame(spark, []).where("false")).collect() == []
    docs = frame(spark, corpus())
    text = " ".join(map(str, range(40)))
    own = frame(spark, [(9, text), (9, "own words of nine"), (12, text + " x"), (None, text), (None, "no id")])
    assert {(r.doc_id, r.text[:3]) for r in n.keep_one_of_each_group(own).collect()} == {(9, "0 1"), (9, "own"), (None, "no ")}
    left = n.keep_one_of_each_group(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, (_, comp) in brute.near(corpus()).items() if comp == k)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(2**63, size=300, dtype=np.uint64)
    other = rng.integers(2**63, size=100, dtype=np.uint64)
    both = np.concatenate([a[:200], other])
    sig = n.superminhash(np.concatenate([a, both]), np.array([0, 300, 600]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.06
    assert (n.superminhash(a[::-1].copy(), np.array([0, 300]), 512)[0] == sig[0]).all()  # order does not count
    small = n.superminhash(a[:1], np.array([0, 1, 1]), 128)
    assert (np.sort(small[0] >> np.uint64(32)) == np.arange(128)).all()  # ranks of one element are a permutation
    assert (small[1] == np.iinfo(np.uint64).max).all()


def test_shingles_of_short_and_odd_texts():
    data, offsets = flat(binary(pa.array(["a b c d e f", "A  b\tC d e F", "a b", None, "a b c", "x a b"])))
    values, cuts = n.shingle_sets(data, offsets)
    assert np.diff(cuts).tolist() == [2, 2, 1, 0, 1, 1]
    sets = [set(values[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
    assert sets[0] == sets[1] and len(sets[2] | sets[4] | sets[5]) == 3


def test_components_in_many_tasks(spark):
    rnd = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(6)
    want = brute.components(x for x in links if x[0] != x[1])
    for block in (10, 100_000):
        assert {r.node: r.component for r in c.components(edges, block).collect()} == want
    assert c.components(edges.where("false")).collect() == []
