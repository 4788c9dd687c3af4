"""Best-first cells, seconds of each call, distributions by transforms, histograms without pairs."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.functions import distributions
from lodequery.operators import grid as G
from lodequery.operators import hamming, sswr, timed
from lodequery.operators.multiprobe import MultiProbe


def test_best_first_cells_are_a_prefix(spark):
    g = G.Grid([0.0, -1.0, 5.0], [6.0, 1.0, 9.0], [4, 3, 5])
    r = random.Random(4)
    points = [(k, [r.uniform(0, 6), r.uniform(-1, 1), r.uniform(5, 9)]) for k in range(5)] + [(7, [3.0, -1.0, 5.0]), (8, [1.5, 1 / 3, 7.0])]
    q = spark.createDataFrame(points, "q int, point array<double>")
    want = {}
    for x in G.GridSearch(g).ordered_cells(q).collect():
        want.setdefault(x.q, []).append((x.lb, tuple(x.cell)))
    search = G.GridSearch(g)
    for most in (1, 17, None):
        got = {}
        for x in search.best_first_cells(q, most).orderBy("q", "rank").collect():
            got.setdefault(x.q, []).append((x.lb, tuple(x.cell)))
        assert got == {k: sorted(v)[:most] for k, v in want.items()}
    reach = q.withColumn("far", F.when(F.col("q") < 7, F.col("q") * 0.8))
    got = search.best_first_cells(reach, None, "far").groupBy("q").count().collect()
    assert {x.q: x["count"] for x in got} == {k: n for k, v in want.items() if (n := sum(k >= 7 or lb < k * 0.8 for lb, _ in v))}
    with pytest.raises(Exception, match="out of bounds"):
        search.best_first_cells(spark.createDataFrame([(1, [9.0, 0.0, 6.0])], "q int, point array<double>"), 3).collect()


def test_best_first_touches_the_frontier_only(monkeypatch):
    pushed = []
    monkeypatch.setattr(G.heapq, "heappush", lambda heap, x, f=G.heapq.heappush: (pushed.append(x[1]), f(heap, x)))
    g = G.Grid([0.0] * 3, [1.0] * 3, [50] * 3)
    got = list(itertools.islice(g.best_first([0.51, 0.31, 0.77]), 200))
    assert [lb for lb, _ in got] == sorted(lb for lb, _ in got) and len(set(pushed)) == len(pushed) < 1000  # of 125,000 cells


def test_times_are_those_of_the_steps(spark):
    def slow(label, pauses):
        for k, p in enumerate(pauses):
            time.sleep(p)
            yield {10 * label + k, 10 * label}
        time.sleep(0.05)

    pauses = {1: [0.2, 0.05, 0.12], 2: [0.01, 0.3], 3: []}
    q = spark.createDataFrame([(k, k, v) for k, v in pauses.items()], "label int, q long, pauses array<double>").select("label", "q", "pauses")
    rows = timed.timed_calls(q, slow).collect()
    for k, v in pauses.items():
        own = sorted((x.step, x.seconds, x.docs) for x in rows if x.q == k)
        assert [d for _, _, d in own] == [sorted({10 * k + j, 10 * k}) for j in range(len(v))] + [None]
        for (_, seconds, _), pause in zip(own, [*v, 0.05]):
            assert pause <= seconds < pause * 1.05 + 0.01
    assert {x.step for x in timed.timed_calls(q, slow, 1).collect()} == {0}
    c = timed.timed_candidates(timed.timed_calls(q, slow).where("docs is not null"))
    got = {(x.q, x.doc): (x.step, x.seconds) for x in c.collect()}
    assert set(got) == {(k, 10 * k + j) for k, v in pauses.items() for j in range(len(v))}
    assert got[1, 11][1] == pytest.approx(0.05, rel=0.3) and got[1, 10][0] == 0
    rel = spark.createDataFrame([(1, 12), (2, 21)], "q long, doc long")
    ratio = {x.q: x.ratio for x in sswr.work_ratio(c, rel, 100, cost=F.col("seconds")).collect()}
    assert ratio[2] * 50.5 == pytest.approx(0.31 + 1 + 1, rel=0.05)  # both look-ups' time, what the first found, and the last's one document


def test_lookups_are_timed_where_they_are_made(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(6)] if k % 3 else [9.0] * 6) for k in range(300)], "doc long, logits array<double>")
    q = docs.where("doc % 20 = 0").withColumnRenamed("doc", "q")
    s = MultiProbe(spark, 6, 2, 3).insert(docs)
    for rows in (10_000, 25):  # with 25, the hundred equal documents are split
        calls = timed.timed_lookups(s.probes(q, 5), s.index, rows)
        got = {(x.q, x.step): x for x in calls.collect()}
        assert len(got) == q.count() * 10 and all(x.seconds > 0 for x in got.values()) and len({x.seconds for x in got.values()}) > 10
        first = {}
        for (k, step), x in sorted(got.items()):
            for d in x.docs:
                first.setdefault((k, d), step)
        assert {(x.q, x.doc): x.step for x in s.candidates(q, 5).collect()} == first
        assert {(x.q, x.doc): x.step for x in timed.timed_candidates(calls).collect()} == first
    none = timed.timed_lookups(s.probes(q, 1), s.index.limit(0))
    assert {tuple(x.docs) for x in none.collect()} == {()}


def recurrence(q):
    f = np.ones(1)
    for p in q:
        f = np.convolve(f, [1 - p, p])
    return f


def test_distribution_of_a_sum_by_transform(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 2000):
        q = rng.random((3, n))
        q[0, : n // 2] = rng.choice([0.0, 1.0], n // 2)
        got = distributions.pmf_by_transform(q)
        assert got.shape == (3, n + 1) and max(np.abs(g - recurrence(v)).max() for g, v in zip(got, q)) < 1e-9
    values = [(1, rng.random(2000).tolist()), (2, []), (3, None), (4, [0.25]), (5, rng.random(2000).tolist())]
    df = spark.createDataFrame(values, "id int, q array<double>")
    got = {x.id: x.p for x in df.select("id", distributions.poisson_binomial_fft(F.col("q")).alias("p")).collect()}
    assert got[2] == [1.0] and got[3] is None and got[4] == pytest.approx([0.75, 0.25])
    assert all(np.abs(np.asarray(got[k]) - recurrence(v)).max() < 1e-9 for k, v in values if k in (1, 5))
    with pytest.raises(Exception, match="0..1"):
        spark.createDataFrame([([0.5, None],)], "q array<double>").select(distributions.poisson_binomial_fft(F.col("q"))).collect()


@pytest.mark.parametrize("nbits", [1, 2, 5, 9])
def test_histogram_without_pairs(spark, nbits):
    r = random.Random(nbits)
    q = spark.createDataFrame([(k, r.randrange(1 << nbits)) for k in range(40)] + [(50, None)], "q long, code long")
    d = spark.createDataFrame([(k, r.randrange(1 << nbits) if k % 3 else 1) for k in range(90)], "d long, code long")
    rel = spark.createDataFrame([(k, r.randrange(90)) for k in range(40) for _ in range(3)], "q long, d long")
    narrow = {tuple(x) for x in hamming.narrow_distance_histogram(q, d, rel, nbits).collect()}
    assert narrow == {tuple(x) for x in hamming.distance_histogram(q.where("code is not null"), d, rel, nbits).collect()}
    labelled = lambda df, name: df.withColumn("label", F.when(F.col(name) % 5 > 0, F.concat(F.lit("l"), F.col(name) % 3)))
    ql, dl = labelled(q, "q"), labelled(d, "d")
    same = ql.join(dl.select("d", "label"), "label").select("q", "d")
    assert {tuple(y) for y in hamming.narrow_label_histogram(ql, dl, nbits).collect()} == {tuple(y) for y in hamming.distance_histogram(q.where("code is not null"), d, same, nbits).collect()}
    x = {i: r.randrange(-5, 9) for i in range(1 << nbits)}
    got = {y.code: y.value for y in hamming.walsh(spark.createDataFrame(list(x.items()), "code long, value long"), nbits).collect()}
    assert got == {u: sum(v * (-1) ** (u & i).bit_count() for i, v in x.items()) for u in range(1 << nbits)}
    none = hamming.narrow_distance_histogram(q.limit(0), d, rel, nbits).collect()
    assert sorted(tuple(x) for x in none) == [(k, 0, 0) for k in range(nbits + 1)]
    with pytest.raises(ValueError):
        hamming.narrow_distance_histogram(q, d, rel, 25)
