"""Training over partitions against the same steps on one matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.operators import learned, training
from lodequery.operators.multiprobe import MultiProbe

OPTIONS = {"hashnet": {"p": 0.3}, "mihash": {"p": 0.3}, "hbkl": {"p_pos": 0.1, "p_neg": 0.5}, "fbeta": {"log_p": math.log(0.3), "log2_beta": -2.0, "nindex": 2, "match_dist": 1, "l2_ratio": 0.05}}


def rows(spark, n=160, dim=5, partitions=7):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    labels = rng.integers(0, 4, n)
    return x, labels, spark.createDataFrame([(k, x[k].tolist(), int(labels[k])) for k in range(n)], "id long, x array<double>, label int").repartition(partitions)


@pytest.mark.parametrize("kind", OPTIONS)
def test_sums_over_partitions_are_the_whole(spark, monkeypatch, kind):
    monkeypatch.setattr(training, "BLOCK", 2000)  # several blocks in a partition
    x, labels, df = rows(spark)
    assert max(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < len(x) / 3  # no partition holds the batch
    rng = np.random.default_rng(5)
    params = [rng.normal(size=(6, 5)), rng.normal(size=6), rng.normal(size=(6, 5)), rng.normal(size=6)]
    block = training.Block(x[:30], labels[:30].tolist())
    got, grads = training.loss_and_gradients(df, block, params, kind, OPTIONS[kind])
    zq, zd = x[:30] @ params[0].T + params[1], x @ params[2].T + params[3]
    r = (labels[:30, None] == labels[None]).astype(float)
    loss, gq, gd = learned.loss_and_gradient(kind, zq, zd, r, **OPTIONS[kind])
    assert got == pytest.approx(loss, abs=1e-9)
    for a, b in zip(grads, (gq.T @ x[:30], gq.sum(0), gd.T @ x, gd.sum(0))):
        assert np.abs(a - b).max() < 1e-9
    if kind != "mihash":  # whose slopes jump
        for g, p in zip(grads, range(4)):
            moved = [q.copy() for q in params]
            at = (1,) * moved[p].ndim
            sides = []
            for s in (1e-6, -1e-6):
                moved[p] = params[p].copy()
                moved[p][at] += s
                sides.append(learned.loss_and_gradient(kind, x[:30] @ moved[0].T + moved[1], x @ moved[2].T + moved[3], r, **OPTIONS[kind])[0])
            pulled = 0 if kind != "fbeta" else None  # the coefficient of the pull is held fixed in its gradient
            if pulled == 0:
                assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-3, abs=1e-6)


def test_training_on_partitions(spark):
    eye = spark.createDataFrame([(k, [float(k == j) for j in range(12)], k) for k in range(12)] + [(90, None, 1), (91, [1.0] * 12, None)], "id long, x array<double>, label long").repartition(4)
    q, d, losses = training.train_on_cluster(eye, "fbeta", 10, steps=30, rate=0.2, batch=64, log_p=math.log(1 / 12), beta_ramp=(0, 25, -16, -4))
    assert q == d and len(losses) == 30
    docs = eye.where("x is not null")
    s = learned.LearnedSearch(q, d, MultiProbe(spark, 10, 1, 1)).insert(docs.select(F.col("id").alias("doc"), F.col("x").alias("features")))
    found = {r.q: r.docs for r in s.search(docs.select(F.col("id").alias("q"), F.col("x").alias("features"))).collect()}
    assert all(k in found[k] for k in range(12))
    fixed = learned.Encoder([[0.1 * (i - j) for j in range(12)] for i in range(10)])
    q, d, losses = training.train_on_cluster(eye, "hashnet", 10, steps=12, rate=0.1, batch=64, p=1 / 12, shared=False, start=(fixed, fixed), freeze="doc")
    assert d == fixed != q and losses[-1] < losses[0]


def test_queries_and_stripes(spark):
    _, _, df = rows(spark, 100)
    blocks = [training.query_block(df, t, 100, 30, 7) for t in range(4)]
    seen = {tuple(x) for b in blocks for x in b.x}
    assert all(len(b.x) <= 30 for b in blocks) and len(seen) == sum(len(b.x) for b in blocks) >= 90  # another stretch each step
    again = df.withColumn("id", F.lit(5))  # one id for all rows: still no more than a batch
    assert sum(len(training.query_block(again, t, 100, 30, 7).x) for t in range(4)) == 30
    _, _, losses = training.train_on_cluster(df, "hashnet", 4, steps=3, batch=50, stripes=3, p=0.25)
    assert 1 <= len(losses) <= 3 and np.isfinite(losses).all()
    with pytest.raises(ValueError):
        training.train_on_cluster(df.limit(0), "hashnet", 4, p=0.25)
    with pytest.raises(ValueError):
        training.train_on_cluster(df, "hashnet", 4, p=0.25, freeze="doc")
