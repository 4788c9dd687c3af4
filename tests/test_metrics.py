"""Metrics against loops over pairs and simulated searches."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodequery.operators import hamming, oracle_calls, sswr


@pytest.mark.parametrize("nbits", [5, 7, 9])
def test_precision_and_recall(spark, nbits):
    r = random.Random(nbits)
    q, d = ([r.getrandbits(nbits) | 1 << (nbits - 1) * side for _ in range(n)] for side, n in ((0, 7), (1, 11)))
    matters = {(r.randrange(7), r.randrange(11)) for _ in range(14)}
    rel = spark.createDataFrame([*matters, *list(matters)[:3]], "q long, d long")  # repeated ones count once
    queries, docs = (spark.createDataFrame(list(enumerate(x)), f"{name} long, code long") for x, name in ((q, "q"), (d, "d")))
    near = [[(i, j) for i, a in enumerate(q) for j, b in enumerate(d) if (a ^ b).bit_count() <= dist] for dist in range(nbits + 1)]
    got = hamming.hamming_pr_curve(queries, docs, rel, nbits).orderBy("dist").collect()
    assert len(got) == nbits + 1
    for x, pairs in zip(got, near):
        assert x.recall == pytest.approx(len(matters & set(pairs)) / len(matters))
        assert math.isnan(x.prec) if not pairs else x.prec == pytest.approx(len(matters & set(pairs)) / len(pairs))
    valid = hamming.hamming_pr_curve(queries, docs, rel, nbits, True).orderBy("dist").collect()
    assert [x.dist for x in valid] == [k for k, pairs in enumerate(near) if pairs]
    none = hamming.distance_histogram(queries, docs, rel.limit(0), nbits).collect()
    assert sum(x.n_rel for x in none) == 0 and sum(x.n_irrel for x in none) == 77


def stream(spark, deltas):
    return spark.createDataFrame([(0, s, d) for s, x in enumerate(deltas) for d in x], "q long, step long, doc long")


def relevant(spark, n):
    return spark.createDataFrame([(0, d) for d in range(n)], "q long, doc long")


def draws(n, rel, k):
    """Expected draws until the k-th of rel among n turns up, over all orders."""
    places = [c[k - 1] + 1 for c in itertools.combinations(range(n), rel)]
    return sum(places) / len(places)


def simulate(steps, rel, n, recall=1.0, halt=None, cost=lambda k: 1.0):
    """The ratio by its definition: calls made, candidates looked through in random order, then the rest of the documents."""
    need, seen, found, spent = math.ceil(recall * len(rel)), set(), 0, 0.0
    base = draws(n, len(rel), need)
    for k, step in enumerate(steps[:halt]):
        spent += cost(k)
        new = set(step) - seen
        hit = len(new & rel)
        if found + hit >= need:
            return (spent + len(seen) + draws(len(new), hit, need - found)) / base, False
        found, seen = found + hit, seen | new
    return (spent + len(seen) + draws(n - len(seen), len(rel) - found, need - found)) / base, True


def drawn_stream(seed, n, n_rel, repeats):
    r = random.Random(seed)
    docs = r.sample(range(n), r.randrange(n_rel, n))
    steps = []
    while docs:
        k = r.randrange(1, 4)
        steps.append(set(docs[:k]) | ({r.choice(sorted(steps[-1]))} if repeats and steps else set()))
        docs = docs[k:]
    return steps


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("recall", [1.0, 0.6, 0.3])
def test_work_ratio_against_its_definition(spark, seed, recall):
    steps, rel = drawn_stream(seed, 13, 4, seed % 2), set(range(4))
    o = {"recall": recall, "on_duplicate": "ignore" if seed % 2 else "raise"}
    r = sswr.work_ratio(stream(spark, steps), relevant(spark, 4), 13, allow_halt=True, **o).first()
    want, halted = simulate(steps, rel, 13, recall)
    assert (r.ratio, r.halted) == (pytest.approx(want), halted)
    timed = sswr.work_ratio(stream(spark, steps), relevant(spark, 4), 13, allow_halt=True, cost=(1 + F.col("step") % 3) * 0.25, **o).first()
    assert timed.ratio == pytest.approx(simulate(steps, rel, 13, recall, cost=lambda k: (1 + k % 3) * 0.25)[0])
    got = sswr.halting_work_ratio(stream(spark, steps), relevant(spark, 4), 13, 5, **o).orderBy("halt").collect()
    assert [(x.halt, x.ratio, x.halted) for x in got] == [(h, pytest.approx(w[0]), w[1]) for h in range(6) for w in [simulate(steps, rel, 13, recall, h)]]


def test_work_ratio_refusals(spark):
    rel = relevant(spark, 5)
    for deltas in ([{0, 1}], []):
        with pytest.raises(Exception, match="end before"):
            sswr.work_ratio(stream(spark, deltas), rel, 20).collect()
    with pytest.raises(Exception, match="twice"):
        sswr.work_ratio(stream(spark, [{0, 1}, {1, 2, 3, 4}]), rel, 20).collect()
    with pytest.raises(ValueError):
        sswr.work_ratio(stream(spark, [{0}]), rel, 20, on_duplicate="what")
    with pytest.raises(Exception, match="nothing to find"):
        sswr.work_ratio(stream(spark, [{0}]), rel, 20, recall=0.0).collect()


def test_call_monitors():
    c = sswr.CountedCalls([{1}, {2}], 2.0)
    assert list(c) == [{1}, {2}] and c.value() == 4
    t = sswr.TimedCalls(iter([{1}]))
    assert list(t) == [{1}] and t.value() > 0
    assert sswr.needed(100, 0.07) == 8  # 7.000000000000001


def test_oracle_calls(spark):
    rows = [(1, s, d) for s, d in enumerate([9, 1, 1, 8, 2, 3])] + [(2, s, d) for s, d in enumerate([7, 4, 6, 5])]
    c = spark.createDataFrame(rows, "q long, step long, doc long")
    rel = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)], "q long, doc long")
    at = {(r.q, r.j): r.calls for r in oracle_calls.found_at(c, rel).collect()}
    assert at == {(1, 1): 2, (1, 2): 5, (1, 3): 6, (2, 1): 2, (2, 2): 4}
    timed = c.withColumn("s", (1 + F.col("step")) * 0.5)
    spent = {(r.q, r.j): (r.calls, r.seconds) for r in oracle_calls.found_at(timed, rel, seconds="s").collect()}
    assert spent == {k: (n, n * (n + 1) / 4) for k, n in at.items()}
    e = oracle_calls.calls_experiment(timed, rel, 50, [0.5], "s").first()
    assert (e.calls, e.seconds) == (pytest.approx(3.5), pytest.approx((7.5 + 1.5) / 2))
    tied = c.withColumn("step", F.floor(F.col("step") / 3))  # ties within a step go by document
    assert {(r.q, r.j): r.calls for r in oracle_calls.found_at(tied, rel).collect()} == {(1, 1): 1, (1, 2): 4, (1, 3): 5, (2, 1): 1, (2, 2): 4}
    e = oracle_calls.calls_experiment(c, rel, 50, [0.5]).first()
    assert e.calls == pytest.approx(3.5) and e.baseline == pytest.approx(21.25)
    seconds = spark.createDataFrame([(0.5, 2.0)], "recall double, expected double")
    ex = oracle_calls.calls_experiment(c, rel, 50, [0.5])
    assert oracle_calls.time_per_saved_call(ex, seconds).first().tocr == pytest.approx(2 / (21.25 - 3.5))
    assert oracle_calls.time_per_saved_call(ex.withColumn("baseline", ex.calls), seconds).first().tocr == float("inf")
    with pytest.raises(Exception, match="end before"):
        oracle_calls.found_at(c.where("step < 3"), rel).collect()
