"""Plain Python versions of the operators, for comparison, and frames of small documents."""

import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = "digest string, part int, text_key string, score string, votes string, component string, id int, hash int, bucket int, tokens int, piece_ids string, decoded string, depth int, kept int, n int, _text string, _digest string, _runs int, _id string, _key string, _own_score string, _part int, row string, runs int, gone int, key string, start int, own_id string"


def frame(spark, texts, parts=3):
    """Documents of (doc_id, text) pairs or of texts, with columns of clashing names."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    width = CLASH.count(",") + 1
    return spark.createDataFrame([(k, t, None, "s", None, *[None] * width) for k, t in rows], f"{DOCS}, {CLASH}").repartition(parts)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def near(docs):
    """doc_id -> (n_shingles, component_id) for (doc_id, text) pairs with distinct ids."""
    sets = {k: shingles(t) for k, t in docs}
    holders = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            holders[x].add(k)
    links = [(a, b) for a in sets for b in {o for x in sets[a] for o in holders[x]} if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    named = components(links)
    return {k: (len(s), named.get(k, k)) for k, s in sets.items()}
