import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from logstrata.llm import quality, toxicity

from .brute import frame


def prose(rnd, n):
    words = ["".join(rnd.choice(["an", "the", "ri", "so", "un", "ver", "lo"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


def junk(rnd, text):
    words = text.split()
    return rnd.choice([
        " ".join(w for w in words[:8] for _ in range(30)), " ".join(w.upper() + "!!" for w in words),
        " ".join(w + rnd.choice(["$$$", "&&&", "###"]) for w in words), " | ".join(words),
    ])


def test_quality_of_planted_junk(spark):
    rnd = random.Random(6)
    docs = []
    for k in range(400):
        text = prose(rnd, rnd.randint(20, 120))
        docs.append((k, junk(rnd, text) if k % 8 == 0 else text))
    table = frame(spark, [*docs, (900, None), (901, ""), (902, " \n "), (None, docs[1][1]), (1, docs[1][1])])
    left = quality.drop_poor(table)
    assert left.columns == table.columns
    kept = {r.doc_id for r in left.collect()}
    assert not kept & {900, 901, 902} and None in kept
    assert len({k for k, _ in docs if k % 8} - kept) == 0 and len({k for k, _ in docs if k % 8 == 0} & kept) <= 2
    scored = quality.with_quality(table).collect()
    assert len(scored) == 405 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.text == docs[1][1]}) == 1


def test_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    n = len(quality.HEURISTICS)
    hit = np.linspace(0.5, 0.9, n)
    votes = np.where(~truth[:, None] & (rng.random((4000, n)) < hit), 2, 0)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, chance, share = quality.expectation_maximisation(patterns, counts.astype(float))
    assert ((good[inverse.ravel()] > 0.5) == truth).mean() > 0.98
    assert np.abs(chance[:, 1, 2] - hit).max() < 0.08 and abs(share - 0.8) < 0.03


def test_quality_of_empty_table(spark):
    assert quality.with_quality(frame(spark, []).where("false")).collect() == []


def test_toxicity_on_held_out_rows(spark):
    rnd, docs, labels = random.Random(8), [], []
    bad = ["scoundrel", "nitwit", "blockhead", "rubbish"]
    for k in range(900):
        words = prose(rnd, rnd.randint(15, 60)).split()
        if toxic := k % 5 == 0:
            for _ in range(max(1, len(words) // 8)):
                word = rnd.choice(bad)
                if zlib.crc32(str(k).encode()) % 3 == 1:  # held out: misspelt
                    at = rnd.randrange(2, len(word) - 1)
                    word = word[:at] + rnd.choice("aeiou") + word[at:]
                words.insert(rnd.randint(0, len(words)), word)
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    labels += [(None, 1, 1), (2, None, None), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(frame(spark, [*docs, (None, "x"), (3000, None), (0, "again")]), table).collect()
    assert len(found) == 903
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    held = [(r.score, r.doc_id % 5 == 0) for r in found if r.held_out and r.doc_id < 900]
    good, bad_scores = ([s for s, y in held if y == kind] for kind in (False, True))
    auc = np.mean([a > b for a in bad_scores for b in good])
    assert auc > 0.95, auc


def test_toxicity_of_empty_tables(spark):
    docs, labels = frame(spark, ["a b"]), spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs.where("false"), labels).collect() == []
    assert [r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()] == [0.5]


def test_quality_keeps_clashing_columns(spark):
    table = frame(spark, [(1, "The cat sat on the mat, and it was glad of it."), (2, "$$$ ### $$$")]).withColumns({"_text": F.upper("text"), "score": F.lower("text"), "_own_score": F.col("text")})
    rows = quality.drop_poor(table, threshold=0.0).collect()
    assert len(rows) == 2 and all((r["_text"], r.score, r["_own_score"]) == (r.text.upper(), r.text.lower(), r.text) for r in rows)
