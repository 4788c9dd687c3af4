import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodequery.llm import wavelet as V

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in own]
    n_docs, total = sum(n > 0 for n in size), sum(size)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(own, size):
            s = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += times * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus(seed, n=250):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdéf" for b in "XYzw12"]
    text = lambda m: "".join(vocabulary[min(int(r.expovariate(0.12)), 35)] + r.choice([" ", ", ", "-", "\n"]) for _ in range(m))
    copy = text(20)
    docs = [(k, copy if r.random() < 0.3 else text(r.randrange(0, 40))) for k in range(n)]
    docs += [(None, "aX bY"), (900, None), (901, ""), (902, "?!"), (3, "aX aX"), (3, "aX aX"), (903, text(2000)), (None, copy)]
    items = [(k, text(r.choice([1, 2, 8, 30]))) for k in range(20)] + [(None, "aX"), (50, None), (51, ""), (52, "unknown"), (4, "aX AX ax"), (4, "aX AX ax"), (53, copy)]
    r.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed, shard, leaf", [(1, 300, 0), (2, 1 << 24, 2), (3, 4000, 4)])
def test_search_against_brute_force(spark, seed, shard, leaf):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, score string, rank int").repartition(3)
    i = spark.createDataFrame([(*x, 2.0) for x in items], "item_id long, text string, score double")
    got = V.ranked_search(d, i, shard_bytes=shard, leaf_bits=leaf).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 10)
    if seed == 1:
        assert sorted(map(tuple, V.ranked_search(d, i, k=3, shard_bytes=shard).collect()), key=str) == brute(docs, items, 3)
        assert V.ranked_search(d.limit(0), i).collect() == [] and V.ranked_search(d, i.limit(0)).collect() == []
        assert V.ranked_search(d.where("doc_id = 902"), i).collect() == []


def tree_of(docs, leaf):
    counts = [len(terms(t)) for _, t in docs]
    ids = np.array([i or 0 for i, _ in docs])
    arrays = V.build(ids, np.array([i is not None for i, _ in docs]), pa.array([t for _, t in docs], pa.string()), sum(c > 0 for c in counts), sum(counts), leaf)
    return V.Tree(arrays)


def test_ranges_are_dual_sorted():
    docs, _ = corpus(5, 120)
    for leaf in (0, 1, 3):
        tree = tree_of(docs, leaf)
        for k in range(len(tree.terms)):
            ranges = [(0, *map(int, tree.begins[k : k + 2]))]
            for level in range(tree.levels + 1):
                assert sum(hi - lo for _, lo, hi in ranges) == tree.begins[k + 1] - tree.begins[k]
                for _, lo, hi in ranges:
                    assert (np.diff(tree.carried[level, lo:hi]) <= 0).all()  # by impact in every node
                if level < tree.levels:
                    halves = [(f, tree.down(np.array([level]), np.array([lo]), np.array([hi]))) for f, lo, hi in ranges]
                    ranges = [(2 * f + h, int(a[0]), int(b[0])) for f, two in halves for h, (a, b) in enumerate(two) if a[0] < b[0]]
            found = sorted((f << leaf) + int(x) for f, lo, hi in ranges for x in tree.low[lo:hi])
            assert len(set(found)) == len(found)  # navigable by document: each once, in its own block


def test_best_first_opens_few_nodes(monkeypatch):
    r = random.Random(7)
    docs = [(k, " ".join(f"w{r.randrange(400)}" for _ in range(30))) for k in range(4096)]
    docs[1234] = (1234, "needle w1 w2 w3")
    tree = tree_of(docs, 2)
    opened = []
    for name in ("_children", "_blocks"):
        monkeypatch.setattr(V.Tree, name, lambda self, nodes, *rest, f=getattr(V.Tree, name): (opened.append(len(nodes)), f(self, nodes, *rest)))
    hashes = V.split(pa.array(["needle w1 w2 w3"]), V.ALNUM).hashes
    lo, hi = tree.lookup(hashes)
    which, doc, score = tree.search([(np.full(4, 1000), lo, hi)], np.zeros(1, np.int64), 1)
    assert tree.ids[doc].tolist() == [1234] and sum(opened) < 100  # of 2,047 nodes
    assert len(tree.search([(np.full(4, 1000), lo, hi)], score + 1, 1)[0]) == 0  # a floor above everything


def test_counts_and_norms():
    texts = ["a b", None, "", "?", "A1-b é", "x", "x"]
    assert V.word_counts(pa.array(texts)).tolist() == [len(terms(t)) for t in texts]
    assert V.word_counts(pa.array([], pa.string())).tolist() == []
    n = np.array([10**7, 1])
    assert V.length_norms(n, 10**12, 10**13).tolist() == [25 + 75 * 10**6, 25 + 7]


def test_ids_must_be_numbers(spark):
    d = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError):
        V.build_index(d)
