import math
import random

import numpy as np
import pytest

from lodequery.llm import balltree as B


def brute(vectors, queries, k):
    q = lambda v: [math.floor(1024 * x) for x in v]
    ok = [(i, q(v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in queries:
        if i is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        v = q(v)
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_against_brute_force(spark, seed):
    r = random.Random(seed)
    unit = lambda: [r.gauss(0, 0.4) for _ in range(8)]
    hot = unit()
    vectors = [(k, hot if r.random() < 0.3 else unit()) for k in range(700)]
    vectors += [(None, unit()), (900, None), (901, [*unit()[:7], None]), (902, [*unit()[:7], float("nan")]), (903, [*unit()[:7], float("inf")]), (900, [1.0, 2.0]), (1000, [0.5, -3.0]), (1001, []), (800, unit()), (5, hot)]
    d = spark.createDataFrame([(*x, 1) for x in vectors], "vec_id long, embedding array<double>, rank int").repartition(3)
    queries = [v for v in vectors if v[0] is not None and v[0] % 100 == 0]
    got = B.top_k(d, d.where("vec_id % 100 = 0"), shard=90, leaf=7, block=3, seeds=3).collect()
    assert sorted(map(tuple, got)) == brute(vectors, queries, 10)
    waves = B.top_k(d, d.where("vec_id % 100 = 0"), shard=11, leaf=3, block=4, seeds=2).collect()
    assert sorted(map(tuple, waves)) == brute(vectors, queries, 10)
    assert B.top_k(d.limit(0), d).collect() == [] and B.top_k(d, d.limit(0)).collect() == []


def test_large_numbers_stay_exact_or_are_refused():
    q, x = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**22, -(2.0**30)]])
    s = B._scores(q, x)
    assert s.tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, (2**40 + 1) * 2**22 - 3 * 2**30]]
    for huge in (2.0**60, -(2.0**60)):
        with pytest.raises(OverflowError):
            B._scores(q, np.array([[huge, 1.0]]))


def test_ids_must_be_numbers(spark):
    d = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    with pytest.raises(TypeError):
        B.top_k(d, d)


def test_shards_hold_neighbours(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 5) for _ in range(8)] for _ in range(6)]
    rows = [(k, [c + r.gauss(0, 0.1) for c in centres[r.randrange(6)]]) for k in range(1200)]
    d = B._usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), "vec_id", "embedding")
    got = B._by_pivot(d).collect()
    assert sorted((x.id, x.v) for x in got) == sorted(rows)
    cluster = [min(range(6), key=lambda c: math.dist(x.v, centres[c])) for x in got]
    groups = 1 + sum(a != b for a, b in zip(cluster, cluster[1:]))
    assert groups <= B.PIVOTS < 600  # in the order of the input there would be about a thousand
