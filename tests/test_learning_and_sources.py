"""Learned codes, dataset views, saved state, streams and the entry point."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.operators import learned
from lodequery.operators.multiprobe import MultiProbe
from lodequery.sources import datasets, state

OPTIONS = {"hashnet": {"p": 0.3}, "mihash": {"p": 0.3}, "hbkl": {"p_pos": 0.1, "p_neg": 0.5}, "fbeta": {"log_p": math.log(0.3), "log2_beta": -2.0, "nindex": 2, "match_dist": 1}}


@pytest.mark.parametrize("kind", OPTIONS)
def test_gradients_and_losses(spark, kind):
    rng = np.random.default_rng(1)
    zq, zd = rng.normal(size=(3, 6)), rng.normal(size=(4, 6))
    r = (rng.random((3, 4)) < 0.4).astype(float)
    r[0, 0], r[1, 1] = 1, 0
    loss, gq, gd = learned.loss_and_gradient(kind, zq, zd, r, **OPTIONS[kind])
    for z, g in ((zq, gq), (zd, gd)):
        for i, j in ((0, 0), (1, 3), (2, 5)):
            e = np.zeros_like(z)
            e[i, j] = 1e-6
            up, down = (learned.loss_and_gradient(kind, *((zq + s * e, zd) if z is zq else (zq, zd + s * e)), r, **OPTIONS[kind])[0] for s in (1, -1))
            assert g[i, j] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)
    pairs = spark.createDataFrame([(zq[i].tolist(), zd[j].tolist(), bool(r[i, j])) for i in range(3) for j in range(4)], "zq array<double>, zd array<double>, r boolean")
    o = OPTIONS[kind]
    got = {
        "hashnet": lambda: learned.hashnet_loss(pairs, o["p"]), "mihash": lambda: learned.mihash_loss(pairs, 6, o["p"]),
        "hbkl": lambda: learned.hbkl_loss(pairs, 6, **o), "fbeta": lambda: learned.fbeta_loss(pairs, 6, o["log_p"], -2.0, 2, 1),
    }[kind]().first().loss
    assert got == pytest.approx(loss, rel=1e-6)


def test_training_lowers_the_loss_and_retrieves(spark):
    eye = spark.createDataFrame([(k, [float(k == j) for j in range(16)], k) for k in range(16)], "id long, x array<double>, label long")
    for kind, o in (("hashnet", {"p": 1 / 16}), ("mihash", {"p": 1 / 16}), ("hbkl", {"p_pos": 0.05, "p_neg": 0.5}), ("fbeta", {"log_p": math.log(1 / 16), "beta_ramp": (0, 150, -16, -4)})):
        q, d, losses = learned.train(eye, kind, 12, steps=200, rate=0.05, **o)
        assert len(losses) == 200 and (losses[-1] < losses[0] or kind == "fbeta")
        s = learned.LearnedSearch(q, d, MultiProbe(spark, 12, 1, 1)).insert(eye.select(F.col("id").alias("doc"), F.col("x").alias("features")))
        got = {r.q: r.docs for r in s.search(eye.select(F.col("id").alias("q"), F.col("x").alias("features"))).collect()}
        assert all(k in got[k] for k in range(16))  # one encoder: every item finds itself
    again = learned.LearnedSearch.from_state(*s.state(), MultiProbe(spark, 12, 1, 1))
    assert again.fq == q and again.structure.index.count() == s.structure.index.count() == 16
    fixed = learned.Encoder([[0.1 * (i - j) for j in range(16)] for i in range(12)])
    for side in ("query", "doc"):
        q, d, losses = learned.train(eye, "hashnet", 12, steps=60, rate=0.05, p=1 / 16, shared=False, start=(fixed, fixed), freeze=side)
        kept, moved = (q, d) if side == "query" else (d, q)
        assert kept == fixed != moved and losses[-1] < losses[0]
    for wrong in ({"freeze": "query"}, {"freeze": "doc", "start": (fixed, fixed)}, {"freeze": "both", "shared": False, "start": (fixed, fixed)}):
        with pytest.raises(ValueError):
            learned.train(eye, "hashnet", 12, steps=1, p=0.5, **wrong)
    with pytest.raises(ValueError):
        learned.log_match(F.col("a"), F.col("b"), 16, 3)
    with pytest.raises(ValueError):
        learned.Encoder([[1.0]], [1.0, 2.0])


def test_dataset_views(spark):
    df = spark.range(1000).withColumn("label", F.col("id") % 7)
    s = datasets.with_split(df, "id")
    assert sum(datasets.split(s, n).count() for n in datasets.SPLITS) == 1000
    with pytest.raises(ValueError):
        datasets.split(s, "all")
    with pytest.raises(ValueError):
        datasets.relation(df, df, "x")
    b = datasets.full_batches(df.repartition(5), "id", 64).collect()
    assert len(b) == 960 and all(r.batch * 64 + r.place == r.id for r in b)
    assert datasets.full_batches(df.limit(3), "id", 64).count() == 0
    draws = datasets.sample_with_replacement(df.limit(10), "id", 50).collect()
    assert len(draws) == 50 and len({r.id for r in draws}) < 11
    assert len({r.id for r in datasets.choose(df, "id", 20, 1).collect()}) == 20
    for r in datasets.class_pairs(df, "id", "label").collect():
        assert r.query_id != r.doc_id and r.query_id % 7 == r.doc_id % 7 == r.label
    v = df.limit(200).select("id", F.array(*[F.lit(0.0)] * 16).alias("x"))
    one, two = (datasets.noisy(v.repartition(n), "id", "x", 1.0, 5).orderBy("id").collect() for n in (1, 7))
    x = np.asarray([r.x for r in one])
    assert one == two and abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05
    q, d, rel = datasets.noisy_pairs(v, "id", "x", 0.1)
    assert rel.count() == 200 and q.join(d, F.col("q") == F.col("doc")).where(q.x == d.x).count() == 0
    m = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 5)], "doc long, part long")
    assert {r.part: r.docs for r in datasets.inverted_index(m, "doc", "part").collect()} == {5: [1, 2], 6: [1]}
    assert {tuple(r) for r in datasets.mosaic_relation(spark.createDataFrame([(9, 5)], "q long, part long"), m).collect()} == {(9, 1), (9, 2)}


def test_state_paths_and_stopwatch(spark, tmp_path, monkeypatch):
    df, path = spark.range(3), str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        state.load(spark, path)
    assert state.load(spark, path, "ignore") is None
    state.save(df, path)
    with pytest.raises(FileExistsError):
        state.save(df, path, "raise")
    state.save(spark.range(9), path, "skip")
    assert state.load(spark, path).count() == 3
    state.save(spark.range(9), path)
    assert state.load(spark, path).count() == 9
    monkeypatch.setenv("DATASETS_DIR", "/a:/b:/a")
    assert state.directories("dataset", "/x", "/pkg")[:4] == ["/x", "/a", "/b", "/pkg/datasets"]
    assert state.expand(["a", "b"], ["c"]) == ["a/c", "b/c"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f").write_text("")
    assert state.existing("f", "dataset", str(tmp_path), ["sub"]) == [str(tmp_path / "sub" / "f")]
    for bad in (lambda: state.directories("picture"), lambda: state.Stopwatch().stop(), lambda: state.Stopwatch().start().start()):
        with pytest.raises(ValueError):
            bad()
    w = state.Stopwatch().start()
    time.sleep(0.05)
    assert 0.04 < w.stop().time() < 1 and w.reset().time() == 0
    assert "<table" in state.html_table(df)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 65
    assert set(e.oracle_sql()) <= set(e.queries())
    for name in ("hamming_hist", "mb_search", "grid_knn", "counter_sswr", "unique_list"):
        assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
