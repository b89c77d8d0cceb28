import itertools
import random
import re

import numpy as np

from logstrata.llm import decontaminate as d

from .brute import frame


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def brute_best(same, share):
    best = (0, 0, 0)
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            hits = int(same[a:b].sum())
            if same[a] and same[b - 1] and hits >= share * (b - a) - 1e-9 and hits > best[2]:
                best = (a, b, hits)
    return best


def test_best_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        same = rng.random(rng.integers(1, 40)) < 0.6
        found, want = d.best_overlap(same, 0.8), brute_best(same, 0.8)
        assert found[2] == want[2]
        if found[2]:
            a, b, hits = found
            assert same[a] and same[b - 1] and same[a:b].sum() == hits >= 0.8 * (b - a) - 1e-9


def test_planted_passages(spark):
    rnd = random.Random(5)
    items = [(k, " ".join(words(rnd, n))) for k, n in enumerate((14, 30, 59, 20, 13, 6))] + [(8, None), (9, "")]
    docs, want = [], set()
    for k in range(120):
        body = words(rnd, rnd.randint(0, 200))
        if k % 3 == 0:
            item, text = items[k % 5]
            own = text.split()
            if k % 2:
                for at in range(4, len(own), 9):  # one of nine replaced
                    own[at] = "other"
            place = rnd.randint(0, len(body))
            body[place:place] = own
            want.add((k, item))  # an item of 14 tokens keeps 12, one of 13 keeps 11
        docs.append((k, " ".join(body).title().replace(" ", ", ")))
    docs += [(500, " ".join(items[2][1].split()[:10] + words(rnd, 9))), (501, None), (502, ""), (None, items[1][1]), (3, "twice"), (503, items[5][1])]
    want.add((503, 5))  # a short item, word for word
    found = d.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(None, 1)}
    texts = dict(reversed(docs))
    for r in found:
        if r.doc_id is not None:
            doc, item = (re.findall(r"\w+", t.lower()) for t in (texts[r.doc_id], dict(items)[r.item_id]))
            a, b = doc[r.doc_start : r.doc_end], item[r.item_start : r.item_end]
            assert len(a) == len(b) and sum(x == y for x, y in zip(a, b)) == r.equal_tokens and r.item_tokens == len(item)
    left = d.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    rows = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(k for k, _ in rows if k is not None) == sorted([k for k, _ in docs if k is not None and (k, ) not in {(x,) for x, _ in want}] + [3])
    assert (None, items[1][1]) not in rows and (3, "twice") in rows


def test_empty_tables(spark):
    docs, items = frame(spark, ["some words here"]), spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert d.overlaps(docs.where("false"), items).collect() == []
    assert d.overlaps(docs, items.where("false")).collect() == []
    assert d.drop_contaminated(docs, items).count() == 1


def placements(n, lost):
    return itertools.combinations(range(n), lost)


def test_every_placement_of_substitutions(spark):
    """Whatever counts as an overlap is found, wherever the substituted tokens are."""
    rnd, items, docs, want = random.Random(11), [], [], set()
    for n, lost in ((16, 3), (15, 3), (13, 2), (12, 2), (11, 2), (10, 2), (10, 1), (10, 0), (9, 1), (8, 1), (7, 1), (7, 0)):
        item = len(items)
        items.append((item, " ".join(words(rnd, n))))
        for gaps in placements(n, lost):
            own = [f"other{rnd.randrange(10**9)}" if k in gaps else w for k, w in enumerate(items[-1][1].split())]
            kept = [k for k in range(n) if k not in gaps]
            if n - lost >= 0.8 * (kept[-1] - kept[0] + 1) - 1e-9:
                want.add((len(docs), item))
            docs.append((len(docs), " ".join(words(rnd, 5) + own + words(rnd, 5))))
    long = (len(items), " ".join(words(rnd, 60)))
    items.append(long)
    for _ in range(400):  # stretches of 20 with 4 substituted, of 25 with 5
        n, lost = rnd.choice(((20, 4), (25, 5)))
        at, gaps = rnd.randint(0, 60 - n), rnd.sample(range(1, n - 1), lost)
        own = ["other" if k in gaps else w for k, w in enumerate(long[1].split()[at : at + n])]
        want.add((len(docs), long[0]))
        docs.append((len(docs), " ".join(words(rnd, 5) + own + words(rnd, 5))))
    found = d.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want


def test_no_long_overlap_avoids_the_masks():
    """Stretches without a hit, by their last tokens and number of equal ones: the best of any length stays under the share."""
    masks, least = [sum(1 << k for k in m) for m in d.MASKS], d.TOKENS
    keep = (1 << max(m.bit_length() for m in masks) - 1) - 1
    best, todo = {(1, 1): 1}, [(1, 1)]  # score: 1 for an equal token, -4 for another; a share of 0.8 is a score of 0
    while todo:
        state = last, equal = todo.pop()
        for bit in (0, 1):
            bits = last << 1 | bit
            if bit and any(bits & m == m for m in masks):
                continue
            after, score = (bits & keep, min(least, equal + bit)), best[state] + (1 if bit else -4)
            if score > best.get(after, -5 * least):
                best[after] = score
                assert after[1] < least or score < 0
                todo.append(after)


def test_shorter_items_on_demand(spark):
    items = [(n, " ".join(f"t{n}{k}" for k in range(n))) for n in range(1, 7)]
    docs = [(n, f"before {text} after") for n, text in items] + [(15, "t50 t51 x t53 t54"), (16, "t60 t61 t62 x t64 t65"), (14, "t40 t41 x t43"), (17, "试验文字"), (18, "其他文字")]
    items.append((7, "试验文字"))
    found = d.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), shortest=1).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(n, n) for n in range(1, 7)} | {(15, 5), (16, 6), (17, 7)}


def test_tokens_of_all_scripts():
    texts = ["the cat, sat", "«don’t» stop…", "今天天气，很好。ok", "カタカナ と ひらがな", "ภาษาไทย", "ａｂｃ！１２ｄ", "ｶﾅ｡", "𠀀𠀁 😀 x", "żółw naïve ½µ", "한국어 말"]
    want = [3, 3, 7, 9, 7, 2, 2, 3, 3, 2]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    hashes, by_text = d.tokens(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert np.diff(by_text).tolist() == want and len(hashes) == sum(want)
    assert d.tokens(np.frombuffer("。天".encode(), np.uint8), np.array([0, 3, 6]))[1].tolist() == [0, 0, 1]


def test_short_items_and_unspaced_scripts(spark):
    items = [(1, "Which river crosses seven old capitals?"), (2, "请问中国古代四大发明分别是什么？它们对世界产生了怎样的影响？"), (3, "How tall is Everest"), (4, "the answer")]
    docs = [(1, "Quiz: which river crosses seven old capitals? Write it down."), (2, "题目。请问中国古代四大发明分别是什么，它们对世界产生了这样的影响！谢谢"), (3, "Now, how tall is Everest?"), (4, "He knew the answer well."),
            (5, "今天天气很好，我们一起去公园散步，看见了很多美丽的花和高大的树木。"), (6, "Which river crosses the old town? How tall is it?")]
    found = d.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 2), (3, 3)}
    left = d.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {4, 5, 6}
