import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logstrata.llm import list_ranking as lr
from logstrata.llm import prefix_trie as p

TURNS = "conv_id long, turn long, role string, text string, node long, depth int, length int, pos string, words string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, None, 1, 2, "3", "4") for r in rows], TURNS).repartition(parts)


def sequences(rows):
    """conv_id -> turns in order."""
    out = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            out[c].append(((n is not None, n or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(made):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        sums[path] = (sum(sums[k][0] for k in kids[path]) or 1, own + sum(sums[k][1] for k in kids[path]))
    return sorted(
        (min(m), len(path), min(members[path[:-1]]) if path else -1, len(m), len(kids[path]), *sums[path], hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest())
        for path, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def conversations(seed=1):
    rnd, rows = random.Random(seed), []
    for c in range(3, 260):
        if c % 40 == 0:
            continue  # an absent first conversation
        start = rnd.choice("xyz") if rnd.random() < 0.6 else f"own {c}"
        for k in range(rnd.choice([1, 1, 2, 3, 5])):
            text = rnd.choice([start, "ok then", None, "", " two\twords "]) if k else start
            rows.append((c, rnd.choice([k, k, None]) if k == 0 else k, rnd.choice(["user", "assistant", None]), text))
    rows += [(c, k, "user", f"same {k}") for c in range(300, 400) for k in range(3)]  # one conversation many times
    rows += [(500, k, "user", f"long {k % 7} {k}") for k in range(2500)] + [(501, k, "user", f"long {k % 7} {k}") for k in range(2400)]
    rows += [(502, 1, "a", "tie"), (502, 1, "a", "tie"), (502, 1, None, "tie"), (-21, 0, "user", "x"), (-25, 0, "user", "x"), (None, 0, "user", "x"), (None, None, None, None)]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = conversations()
    assert rows_of(p.prefix_trie(table(spark, rows))) == brute(sequences(rows))


def test_rebuilt_conversations(spark):
    rows = conversations(2)
    found = p.trie(*p.with_shared_heads(p.ordered_turns(table(spark, rows, 7))))
    want = brute(rebuilt(sequences(rows)))
    assert rows_of(found) == want and any(n[4] > 20 for n in want)
    tour = found.select("tour_start", "tour_end").collect()
    assert sorted(x for r in tour for x in r) == list(range(2 * len(want)))


def test_empty_table(spark):
    assert p.prefix_trie(table(spark, [(1, 1, "a", "b")]).where("false")).collect() == []
    assert p.prefix_trie(table(spark, [(None, 1, "a", "b")])).collect() == []
    assert rows_of(p.prefix_trie(table(spark, [(4, None, None, None)]))) == brute({4: [("", "")]})


def test_pieces_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 3)
    ends = [(2, 5, 6, c) for c in range(1000)] + [(2, 5, 2**62 + 1, 7), (2, 5, 2**62, 8)]
    found = p._ends(spark.createDataFrame(ends, "depth long, k1 long, k2 long, conv_id long").repartition(5)).collect()
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert {r.k2: r.ends_sha256 for r in found} == {6: sha(range(1000)), 2**62 + 1: sha([7]), 2**62: sha([8])}


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(40)), st.integers(1, 40))
def test_walk(order, some):
    ids = np.array(sorted(order[:some]))
    follows = dict(zip(order, [*order[1:], -1]))
    nexts, weights = np.array([follows[i] for i in ids]), np.stack([ids * 3 + 1, ids * 0 + 1], axis=1)
    chain, before, last, total = lr.walk(ids, nexts, weights)
    for k, i in enumerate(ids.tolist()):
        at, path = order.index(i), []
        while at > 0 and order[at - 1] in ids:
            at -= 1
            path.append(order[at])
        assert ids[chain[k]] == (path[-1] if path else i)
        assert before[k].tolist() == [sum(3 * x + 1 for x in path), len(path)]
    for k in np.flatnonzero(chain == np.arange(len(ids))):
        own = [i for j, i in enumerate(ids.tolist()) if chain[j] == k]
        assert total[k].tolist() == [sum(3 * x + 1 for x in own), len(own)] and follows[ids[last[k]]] not in own


def test_lists_in_random_order(spark):
    """No locality at all: random mates shorten the list."""
    rnd = random.Random(5)
    order = rnd.sample(range(10**6), 6000)
    lists = [order[:4000], order[4000:5999], order[5999:]]
    rows = [(i, after, 1, i % 5) for x in lists for i, after in zip(x, [*x[1:], None])]
    found = lr.prefix_sums(spark.createDataFrame(rows, "id long, next long, one long, w long").repartition(3), ["one", "w"], block=700).collect()
    want = {}
    for x in lists:
        total = 0
        for k, i in enumerate(x):
            want[i] = (k, total)
            total += i % 5
    assert {r.id: (r.one, r.w) for r in found} == want and len(found) == 6000
    assert lr.prefix_sums(spark.createDataFrame([], "id long, next long, one long"), ["one"]).collect() == []
