import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.llm import components as C
from lodequery.llm import jaccard as J
from lodequery.llm.components import components, spread_join


def sets(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, percent=80):
    s = [sets(t) for _, t in docs]
    root = list(range(len(docs)))
    links = set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                links.add((i, j))
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc, _) in enumerate(docs):
        ids = [docs[k][0] for k in range(len(docs)) if find(k) == find(i) and docs[k][0] is not None]
        out.append((doc, len(s[i]), min(ids, default=None)))
    return sorted(out, key=str), links, s


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstu")
    common = [word() for _ in range(40)]
    docs = []
    for _ in range(n):
        kind = r.random()
        if docs and kind < 0.5 and r.choice(docs)[1]:
            w = (r.choice(docs)[1] or "x").split()
            for _ in range(r.randrange(0, 1 + len(w) // 20)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.choice([0, 1])] = [word()] * r.choice([0, 1])
        else:
            w = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 30, 60, 120]))] + (common if kind > 0.8 else [])
        docs.append((len(docs), " ".join(w)))
    return docs + [(None, docs[0][1]), (n, None), (n + 1, ""), (n + 2, " \n"), (3, docs[5][1]), (0, docs[0][1]), (n + 3, " ".join(word() for _ in range(9000)))]


@pytest.mark.parametrize("seed,tile,size", [(1, 1 << 15, 1 << 24), (2, 6, 4000)])
def test_groups_and_links_against_brute_force(spark, seed, tile, size):
    docs = corpus(seed, 200)
    want, links, s = brute(docs)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n int").repartition(3)
    got = J.jaccard_groups(d, tile=tile, segment_bytes=size).collect()
    assert sorted(map(tuple, got), key=str) == want
    join = J.JaccardJoin(d, tile=tile, segment_bytes=size)
    row = {r["place"]: r for r in join.rows().collect()}
    text = {}
    for doc, t in docs:
        text.setdefault(doc, []).append(frozenset(sets(t)))
    found = join.links().collect()
    assert len({(r.a, r.b) for r in found}) == len(found)
    distinct = {frozenset((frozenset(s[i]), frozenset(s[j]))) for i, j in links if s[i] != s[j]}
    assert len(found) == len(distinct) and all(row[r.a]["rep"] == r.a for r in found)
    assert J.jaccard_groups(d.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [1, 30, 50, 100])
def test_links_at_other_percents(spark, percent):
    r = random.Random(percent)
    docs = corpus(7, 70)[:-1] + [(500 + k, f"{a} {b} c d e f"[: 9 + 2 * (k % 2)]) for k, (a, b) in enumerate((r.choice("xyz"), r.choice("uvw")) for _ in range(40))]
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    _, links, s = brute(docs, percent)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    join = J.JaccardJoin(d, percent=percent)
    of = {r.rep: frozenset(s[r.doc_id]) for r in join.rows().collect() if r.rep is not None}
    found = {frozenset((of[r.a], of[r.b])) for r in join.links().collect()}
    assert found == {frozenset((frozenset(s[i]), frozenset(s[j]))) for i, j in links if s[i] != s[j]}
    assert sorted(map(tuple, J.jaccard_groups(d, percent=percent).collect()), key=str) == brute(docs, percent)[0]


def test_a_small_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "SKETCH", 64)
    monkeypatch.setattr(J, "MOST_SKETCH", 64)
    docs = corpus(11, 150)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.jaccard_groups(d, tile=4).collect()), key=str) == brute(docs)[0]
    # What rare shingles add to a counter doesn't split them, however many there are; a shingle far over it is split.
    r = np.random.default_rng(3)
    for usual in (3, 10**4, 10**8):
        counts = r.poisson(usual, 64)
        counts[5] += 1000 * 32
        split = J.sketch_levels(counts, 1000)[1]
        assert (np.delete(split, 5) == 1).all() and split[5] in range(30, 34) or usual == 10**8 and split[5] < 34


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        J.jaccard_groups(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(900)], "k long, v long")
    lookup = rows.groupBy("k").agg(F.max("v").alias("m"), F.count("*").alias("_c")).where("k <> 9")
    got = sorted(map(tuple, spread_join(rows, lookup, "k", 900).collect()))
    assert got == sorted((0, k, 899) if k % 3 else (k, k, 899 if k == 0 else k) for k in range(900) if k != 9)


def test_documents_that_share_their_least_shingle(spark, monkeypatch):
    """Half of the rows of a band have one min-hash, more than a task's share: they are spread, and stars are what they are without that."""
    texts = [f"a b c d e f x{k}" for k in range(3000)] + [f"{' '.join(f'y{j}' for j in range(40))} z{k % 2}" for k in range(4)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = J.JaccardJoin(d)
    n = join.classes.count()
    few = J.star_links(join.classes, join.folder, 80, n).collect()
    monkeypatch.setattr(J, "FEW", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spread = J.star_links(join.classes, join.folder, 80, n).collect()
        most = join.classes.groupBy("m0").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert most > 4 * n // 16  # a hot key
    assert sorted(few) == sorted(spread) and len(few) == 1
    assert J.JaccardJoin(d.limit(0)).links().collect() == []


def test_bitmap_bound_never_undercounts():
    r = np.random.default_rng(0)
    for _ in range(50):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[: len(x) // 2], r.integers(0, 2**63, r.integers(1, 600)).astype(np.uint64)]))
        a, b = (J._bitmaps(z, np.array([0, len(z)]))[0] for z in (x, y))
        w = min(len(a), len(b))
        bound = (len(x) + len(y) - int(np.bitwise_count(J._fold(a[None], w) ^ J._fold(b[None], w)).sum())) // 2
        assert len(np.intersect1d(x, y)) <= bound


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 200), (None, 3), (150, 120), (150, 120)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 151)} | {200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
