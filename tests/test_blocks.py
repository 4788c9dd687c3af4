"""Jobs over all pairs that are done block by block: the same figures as from rows of pairs, and no such row."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery import queries as Q
from lodequery.operators import grid, hamming, learned, oracle_calls, search
from lodequery.operators.multiprobe import MultiProbe
from lodequery.sources import augment

from .test_whole import by_sql


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """320 vectors of 4 labels, some of them null."""
    path, rng = str(tmp_path_factory.mktemp("blocks")), np.random.default_rng(11)
    rows = [(i, None if i % 37 == 5 else int(rng.integers(0, 4)), (rng.normal(size=64) / 8).tolist()) for i in range(320)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def no_pairs(df) -> None:
    assert "NestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df)


FBETA = {"log_p": np.log(0.1), "log2_beta": -8.0, "nindex": 2, "match_dist": 1, "l2_ratio": 0.01}


@pytest.mark.parametrize("scale", [1.0, 20.0])
def test_losses_by_blocks(spark, scale):
    """With null labels, an id twice, and logits whose products are under the smallest double."""
    rng = np.random.default_rng(5)
    rows = [(i if i != 21 else 20, None if i % 11 == 3 else i % 3, (rng.normal(size=6) * scale * 4).tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "i long, label int, z array<double>")
    q, d = v.where("i % 4 = 0").withColumnRenamed("i", "q"), v.withColumnRenamed("i", "d")
    pairs = q.select("q", F.col("z").alias("zq"), F.col("label").alias("lq")).crossJoin(d.select("d", F.col("z").alias("zd"), F.col("label").alias("ld"))).where("q <> d").withColumn("r", F.col("lq") == F.col("ld"))
    want = {
        "hashnet": (learned.hashnet_loss(pairs, 0.1), {"p": 0.1}), "mihash": (learned.mihash_loss(pairs, 6, 0.1), {"p": 0.1}),
        "hbkl": (learned.hbkl_loss(pairs, 6, 0.1, 0.5), {"p_pos": 0.1, "p_neg": 0.5}), "fbeta": (learned.fbeta_loss(pairs, 6, **FBETA), FBETA),
    }
    for kind, (loss, o) in want.items():
        got = learned.loss_of_all(q, d, kind, 6, 4, 16, **o)
        no_pairs(got)
        assert got.first().loss == pytest.approx(loss.first().loss, rel=1e-9)
    empty = learned.loss_of_all(q.limit(0), d, "hashnet", 6, p=0.1)
    assert [r.loss for r in empty.collect()] == [None]


@pytest.mark.parametrize("kind", ["hashnet", "mihash", "hbkl", "fbeta"])
def test_registered_losses_make_no_pairs(spark, folder, kind):
    no_pairs(Q.QUERIES[f"loss_{kind}"](spark, folder))


@pytest.mark.parametrize("upto", [True, False])
def test_finds_by_distance_are_those_of_the_pairs(spark, upto):
    """Stripes of few documents, against the operator that is given all pairs; a label that no document has, and null ones."""
    rng = np.random.default_rng(3)
    rows = [(i * 7, int(rng.integers(0, 64)), None if i % 13 == 4 else int(rng.integers(0, 5))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc long, code long, label int").withColumn("s", F.col("doc") % 5 * 0.5)
    queries = spark.createDataFrame([(i, c, label) for i, c, label in rows if i % 2] + [(-1, 3, 99)], "q long, code long, label int")
    recalls = [0.3, 0.7]
    got = oracle_calls.found_by_distance(queries, docs, 6, recalls, upto, "s", 8, 16)
    no_pairs(got)
    c = hamming.pair_distances(queries, docs.withColumnRenamed("doc", "d")).withColumnRenamed("d", "doc").join(docs.select("doc", "s"), "doc").select("q", F.col("dist").alias("step"), "doc", "s")
    rel = queries.join(docs, "label").select("q", "doc")
    want = {(r.q, r.n_rel, r.j, r.calls): r.seconds for r in oracle_calls.found_at(c, rel, 0.7, "s").collect()}
    if not upto:
        want = {k: v for k, v in want.items() if k[2] in {int(np.ceil(r * k[1])) for r in recalls}}
    assert {(r.q, r.n_rel, r.j, r.calls): r.seconds for r in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("name", ["oracle_calls_at", "oracle_times_at", "oracle_experiment", "oracle_experiment_times", "oracle_expectation", "oracle_random_baseline", "tocr"])
def test_registered_oracle_calls_make_no_pairs(spark, folder, name):
    df = Q.QUERIES[name](spark, folder)
    got = sorted(tuple(r) for r in df.collect())
    want = by_sql(folder, name)
    assert len(got) == len(want) > 0
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), atol=2e-6)
    pairs = [line for line in plan(df).splitlines() if "Join" in line and "label" in line]
    assert not any("doc#" in line for line in pairs)


def test_histogram_by_labels_is_that_of_the_pairs(spark):
    """64 bits, so negative codes too; codes that come often, null labels and codes."""
    rng = np.random.default_rng(2)
    codes = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    rows = [(i, codes[int(rng.integers(0, 40))], None if i % 9 == 2 else int(rng.integers(0, 3))) for i in range(140)]
    docs = spark.createDataFrame([*rows, (200, None, 1)], "d long, code long, label int")
    queries = docs.where("d % 3 = 0").withColumnRenamed("d", "q")
    got = hamming.label_histogram(queries, docs, 64, 16, 16)
    no_pairs(got)
    rel = queries.select("q", "label").join(docs.select("d", "label"), "label").select("q", "d")
    keep = F.col("code").isNotNull()
    want = hamming.distance_histogram(queries.where(keep).select("q", "code"), docs.where(keep).select("d", "code"), rel, 64)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("most", [3, 2000])
def test_first_hits_and_counts_without_groups(spark, most, monkeypatch):
    """A bucket of many rows is dealt over tasks; ids inserted twice, with other codes, are in both buckets."""
    monkeypatch.setattr(search.spread_join, "__defaults__", (most,))
    rng = np.random.default_rng(4)
    rows = [(i % 90, rng.normal(size=4).tolist(), int(rng.integers(0, 3))) for i in range(100)]
    v = spark.createDataFrame(rows, "doc long, logits array<double>, label int")
    labels = v.groupBy("doc").agg(F.min("label").alias("label"))
    s = MultiProbe(spark, 4, 3).insert(v.select("doc", "logits"))
    q = v.where("doc % 7 = 3").select(F.col("doc").alias("q"), "logits").dropDuplicates(["q"])
    hits = {tuple(r) for r in s.candidates(q, 5).collect()}
    assert hits == {tuple(r) for r in search.SearchStructure.candidates(s, q, 5).collect()} and hits
    assert "earlier" not in plan(s.candidates(q, 40))  # many probes a query: grouped as before
    own = {r.doc: r.label for r in labels.collect()}
    steps = s.label_steps(q.join(labels.withColumnRenamed("doc", "q"), "q"), labels, 5).collect()
    every = {tuple(r) for r in s.probes(q, 5).join(s.index, ["table_no", "code"]).select("q", "step", "doc").collect()}
    for of, rows in (("n_all", every), ("n_new", hits), ("n_hit", {h for h in hits if own[h[0]] == own[h[2]]})):
        want = Counter((a, b) for a, b, _ in rows)
        assert {(r.q, r.step): r[of] for r in steps if r[of]} == want


def test_images_of_a_slice_hold_few_angles(monkeypatch):
    """What is drawn for an image is many times its 64 pixels, so that bounds how many are worked on at once."""
    assert augment.together(8, 8, augment.Amounts()) * 3 * 129**2 <= augment.SLICE
    assert augment.together(4096, 4096, augment.Amounts()) == 1


def test_copies_of_points_cost_a_search_nothing(spark):
    """Queries and points of few places: each pair of places is measured once, and the results are those of all points."""
    rng = np.random.default_rng(8)
    places = rng.integers(0, 20, (12, 2)) / 2.0
    rows = [(i, places[int(rng.integers(0, 12))].tolist()) for i in range(200)]
    points = spark.createDataFrame(rows, "doc long, point array<double>")
    s = grid.GridSearch(grid.Grid([0.0, 0.0], [10.0, 10.0], [4, 4])).insert(points)
    q = points.where("doc % 5 = 0").withColumnRenamed("doc", "q")
    of = {(a, b): float(np.hypot(*np.subtract(p, r))) for a, p in rows if a % 5 == 0 for b, r in rows}
    assert {(r.q, r.doc): r.dist for r in s.within(q, 3.0, together=2).collect()} == pytest.approx({k: d for k, d in of.items() if d < 3})
    got = {(r.q, r["rank"]): r.doc for r in s.nearest(q, 7).collect()}
    assert got == {(a, n + 1): b for a in range(0, 200, 5) for n, (_, b) in enumerate(sorted((of[a, b], b) for b in range(200))[:7])}
    assert s._spots().points.count() == s._places(q).count() <= 12


def test_pairs_are_made_in_a_stage_of_their_own(spark, folder):
    """Between the documents' packed bits and the loop over pairs there is a shuffle into tasks of equal size."""
    text = Q.hamming_pairs(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in text[text.index("Join") :]
