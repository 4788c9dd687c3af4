"""Dataset views at their edges: batches over many slices, triplets, pairs of a class, grids."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from lodequery.sources import datasets


def test_batches_over_many_slices(spark):
    r = random.Random(2)
    values = [r.choice([r.uniform(-9, 9), 2.5, None]) for _ in range(900)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double").repartition(5)
    rows = datasets.full_batches(df, "v", 32, slice_rows=20).collect()
    assert len(rows) == 900 // 32 * 32 and sorted((x.batch, x.place) for x in rows) == [(b, p) for b in range(28) for p in range(32)]
    in_order = [x.v for x in sorted(rows, key=lambda x: (x.batch, x.place))]
    assert in_order == sorted(values, key=lambda v: (v is not None, v or 0.0))[: len(rows)]
    assert set(rows[0].asDict()) == {"id", "v", "batch", "place"}


def test_stretches_are_found_by_halving(spark):
    for bounds in ([4.0], [1.0, 2.0], [float(k * k) for k in range(1, 24)]):
        xs = [0.0, 0.5, *bounds, 9.5, 1e9]
        df = spark.createDataFrame([(x, bounds) for x in xs], "x double, b array<double>")
        got = df.select("x", datasets.stretch_of(F.col("x"), F.col("b"), len(bounds)).alias("k")).collect()
        assert all(x.k == bisect.bisect_right(bounds, x.x) for x in got)


def test_triplets_are_drawn_from_their_sides(spark):
    r = random.Random(4)
    docs = [(k, r.choice([1, 1, 1, 2, 3, None])) for k in range(80)] + [(100, 9)]
    queries = [*docs, (200, 77), (201, None)]
    d, q = spark.createDataFrame(docs, "d long, label int"), spark.createDataFrame(queries, "q long, label int")
    label, asked = dict(docs), dict(queries)
    got = datasets.relation(q, d, "relational_triplets", 5).collect()
    assert sorted(x.q for x in got) == sorted(asked)
    for x in got:
        assert label[x.other] != asked[x.q] and (x.d is None if asked[x.q] == 77 else label[x.d] == asked[x.q])
    assert len({x.other for x in got}) > 20 and len({x.d for x in got if asked[x.q] == 1}) > 5
    alone = datasets.relation(q.where("label = 9"), d.where("label = 9"), "relational_triplets").collect()
    assert [(x.d, x.other) for x in alone] == [(100, None)]
    plan = datasets.relation(q, d, "relational_triplets")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1  # of the one row that counts all


def test_pairs_of_a_class(spark):
    rows = [(k, k % 5 if k % 7 else None) for k in range(200)] + [(500, 40), (3, 3), (3, 3)]
    df = spark.createDataFrame(rows, "id long, label int")
    got = {x.label: (x.query_id, x.doc_id) for x in datasets.class_pairs(df, "id", "label", F.col("id")).collect()}
    for lab in (*range(5), 40, None):
        own = sorted(i for i, v in rows if v == lab)
        assert got[lab] == (own[0], own[1] if len(own) > 1 else None)
    assert len(got) == 7
    assert "WindowGroupLimit" in datasets.class_pairs(df, "id", "label")._jdf.queryExecution().executedPlan().toString()


def test_grids_of_several_sizes(spark):
    got = datasets.image_grids(spark.createDataFrame([("a", 1, 3), ("b", 4, 1), ("c", 0, 5), ("d", 2, 2)], "k string, h int, w int")).collect()
    want = {(k, i, j, 2 * j / (w - 1) - 1 if w > 1 else 0.0, 2 * i / (h - 1) - 1 if h > 1 else 0.0) for k, h, w in (("a", 1, 3), ("b", 4, 1), ("d", 2, 2)) for i in range(h) for j in range(w)}
    assert {tuple(x) for x in got} == want and len(got) == 11
    assert datasets.image_grid(spark, 3, 2).count() == 6


def test_no_scratch_folder_on_a_cluster(spark, monkeypatch):
    from lodequery import queries

    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        queries._scratch(Session, "x")
