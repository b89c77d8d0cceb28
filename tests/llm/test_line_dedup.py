import random

from pyspark.sql import functions as F

from logstrata.llm import line_dedup as ld

from .brute import frame


def brute(docs, least):
    """doc -> numbers of removed lines, by the definition: all runs of lines with at least so many words."""
    seen, out = {}, {}
    for k, t in sorted(docs):
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\f\r")]
        gone = set()
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += len(lines[j].split())
                if total >= least and seen.setdefault(tuple(lines[i : j + 1]), (k, i)) < (k, i):
                    gone.update(range(i, j + 1))
        out[k] = sorted(gone)
    return out


def corpus():
    rnd = random.Random(2)
    line = lambda: " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9)))
    shared = [[line() for _ in range(rnd.randint(1, 8))] for _ in range(6)]
    docs = []
    for k in range(120):
        own = [line() for _ in range(rnd.randint(0, 6))]
        for _ in range(rnd.randint(0, 2)):
            own[rnd.randint(0, len(own)) : 0] = rnd.choice(shared)
        if rnd.random() < 0.2:
            own.insert(rnd.randint(0, len(own)), "  ")
        docs.append((k, "\n".join(own)))
    return docs + [(200, None), (201, ""), (202, "\n\n"), (203, "x " * 500), (204, "x " * 500), (205, "y y y y y y\n" * 40)]


def test_against_brute_force(spark):
    docs = corpus()
    found = ld.repeated_runs(frame(spark, docs), words=12).collect()
    want = brute(docs, 12)
    assert {r.doc_id: [i for a, b in r.runs for i in range(a, b)] for r in found} == want
    assert sum(map(len, want.values())) > 100
    assert all(r.removed_lines == len(want[r.doc_id]) for r in found)


def test_texts_without_runs(spark):
    docs = [(1, "keep\n\none two three four\nfive six"), (2, "own\none two three four\nfive six\n\nend")]
    table = frame(spark, docs)
    left = ld.without_runs(table, ld.repeated_runs(table, words=6))
    assert left.columns == table.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: docs[0][1], 2: "own\n\nend"}


def test_missing_and_repeated_ids(spark):
    text = "a b c d e f g"
    found = ld.repeated_runs(frame(spark, [(None, text), (4, text), (2, text), (2, text), (2, text + " h")]), words=6).collect()
    assert sorted(((r.doc_id, r.removed_lines) for r in found), key=repr) == sorted([(None, 1), (4, 1), (2, 0), (2, 0), (2, 0)], key=repr)
    assert ld.repeated_runs(frame(spark, []).where("false")).collect() == []


def test_whole_copies_go(spark):
    lines = [" ".join(f"w{k}x{n}" for n in range(words)) for k, words in enumerate((80, 90, 30))]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "own line\n" + "\n".join(lines) + "\nown end")]
    runs = ld.repeated_runs(frame(spark, docs))
    assert {r.doc_id: r.removed_words for r in runs.collect()} == {1: 0, 2: 200, 3: 200}
    assert {r.doc_id: r.text for r in ld.without_runs(frame(spark, docs), runs).collect()} == {1: docs[0][1], 2: "", 3: "own line\nown end"}

def test_clashing_columns_stay(spark):
    docs = [(1, "one two three four\nfive six"), (2, "own\none two three four\nfive six\n\nend"), (3, None)]
    table = frame(spark, docs).withColumns({"_runs": F.concat(F.lit("own "), "text"), "row": F.col("text")})
    left = ld.without_runs(table, ld.repeated_runs(table, words=6))
    assert left.columns == table.columns
    assert {r.doc_id: (r.text, r["_runs"], r["row"]) for r in left.collect()} == {1: (docs[0][1], "own " + docs[0][1], docs[0][1]), 2: ("own\n\nend", "own " + docs[1][1], docs[1][1]), 3: (None, None, None)}
