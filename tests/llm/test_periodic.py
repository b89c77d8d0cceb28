import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logstrata.llm import periodic as p

from .brute import frame


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, least=24, times=3):
    """Every run by its definition: all periods, maximal stretches, none that has a shorter period too."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                s, e = i, j + q
                if e - s >= max(least, times * q) and not any(words[s : e - r] == words[s + r : e] for r in range(1, q)):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def numbers(text):
    return np.unique(np.array(list(text), dtype="U1"), return_inverse=True)[1].ravel() if text else np.zeros(0, np.int64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 12)), max_size=8), st.integers(3, 4), st.integers(1, 24))
def test_lag_scan(blocks, times, least):
    text = "".join(b * n for b, n in blocks)
    assert p.lag_scan(numbers(text), least, times) == brute(text, least, times)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcdefgh", max_size=80), max_size=6))
def test_segments_keep_all_runs(texts):
    words, by_text = numbers("".join(texts)), np.cumsum([0, *map(len, texts)])
    starts, ends = p.segments(words, by_text, 6, 3)
    assert all(a[1] <= b[0] for a, b in zip(zip(starts, ends), list(zip(starts, ends))[1:]))
    for s, e in zip(starts, ends):
        assert e - s >= 6 and np.unique(words[s:e], return_counts=True)[1].min() >= 3
        assert np.searchsorted(by_text, s, "right") == np.searchsorted(by_text, e - 1, "right")
    for k, text in enumerate(texts):
        for s, m, _ in brute(text, 6):
            assert any(a <= by_text[k] + s and by_text[k] + s + m <= b for a, b in zip(starts, ends))


def documents():
    rnd, docs = random.Random(4), []
    for k in range(150):
        words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            unit = [rnd.choice("xyzab") for _ in range(rnd.randint(1, 12))]
            many = unit * rnd.randint(2, 9) + unit[: rnd.randint(0, len(unit))]
            at = rnd.randint(0, len(words))
            words[at:at] = many
        docs.append((k, rnd.choice([" ", "\n", "\t \r"]).join(words)))
    return docs + [(200, None), (201, ""), (202, " \n "), (203, "w " * 3000), (204, "é ü " * 40), (None, "a b " * 20), (1, "twice " * 30), (1, "twice " * 30)]


def test_against_brute_force(spark):
    docs = documents()
    found = p.periodic_runs(frame(spark, docs)).collect()
    want = []
    for k, t in docs:
        words = words_of(t)
        runs = brute(words)
        want.append((k, len(words), runs, collapse(words, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(len(w[2]) for w in want) > 60


def test_strongest_and_planted(spark):
    docs = [(k, t) for k, t in documents() if t is not None]
    rows = p.periodic_runs(frame(spark, docs)).select("runs", p.strongest().alias("best")).collect()
    for r in rows:
        best = min(r.runs, key=lambda x: (-x.length / x.period, x.start, x.period), default=None)
        assert r.best == best
    made = frame(spark, docs).select("doc_id", "text", p.planted().alias("made")).collect()
    changed = 0
    for r in made:
        h, words = zlib.crc32(str(r.doc_id).encode()), words_of(r.text)
        if r.doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
            assert r.made == " ".join(words)
            changed += 1
        else:
            assert r.made == r.text
    assert changed > 5


def test_empty_table(spark):
    assert p.periodic_runs(frame(spark, []).where("false")).collect() == []


def test_long_text(spark):
    rnd = random.Random(9)
    body = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000)]
    unit = [f"u{k}" for k in range(50_000)]
    text = " ".join([*body, *unit * 3, *body[:1000]])
    (row,) = p.periodic_runs(frame(spark, [text], 1), collapse=False).collect()
    assert [tuple(r) for r in row.runs] == [(400_000, 150_000, 50_000)]
