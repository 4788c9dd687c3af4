"""Soft Hamming distances block by block, held against the column expression on odd vectors."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodequery import queries as Q
from lodequery.functions import bits
from lodequery.operators import hamming

SCHEMA = "{} long, v array<double>"


def exact(rows):
    return sorted((repr(r.q), repr(r.d), repr(r.dist)) for r in rows)


def test_odd_vectors_in_small_blocks(spark):
    r = random.Random(4)
    odd = [None, [], [1.0, None, 2.0], [1.0, 2.0], [math.nan, 1.0, 0.0], [math.inf, 1.0, 0.0], [0.0, -0.0, 0.0], [1e300, 1e300, 1.0], [1e12, 3.3, 1.0], [0.25, 0.000003, 2.0]]
    rows = [(k, v) for k, v in enumerate(odd + [[r.gauss(0, 1) for _ in range(3)] for _ in range(25)])] + [(None, [1.0, 1.0, 1.0])]
    q, d = spark.createDataFrame(rows[:20] + rows[-1:], SCHEMA.format("q")), spark.createDataFrame(rows, SCHEMA.format("d"))
    pairs = q.withColumnRenamed("v", "a").crossJoin(d.withColumnRenamed("v", "b"))
    want = pairs.select("q", "d", (F.round(bits.soft_hamming(F.col("a"), F.col("b")), 6) + F.lit(0.0)).alias("dist")).collect()
    got = hamming.soft_distances(q, d, 6, q_rows=5, d_rows=7, piece=8).collect()
    assert exact(got) == exact(want) and len(got) == 21 * 36
    assert any(x.dist is None for x in got) and any(x.dist is not None and math.isnan(x.dist) for x in got)
    assert hamming.soft_distances(q.limit(0), d, 6).count() == hamming.soft_distances(q, d.limit(0), 6).count() == 0


def test_halves_go_up_as_in_spark(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([(r.integers(-(10**9), 10**9, 3000) + 0.5) / 1e6, r.normal(size=1000) * 40, [0.0, -0.0, -1e-9, 1e17, 2.5e-7, 5e-7, -5e-7, 1e308, -1e308]])
    want = [a[0] for a in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").orderBy("i").select(F.round("x", 6) + F.lit(0.0)).collect()]
    assert [repr(float(v)) for v in hamming.half_up(x, 6)] == [repr(v) for v in want]


def test_no_join_makes_the_pairs(spark, tmp_path):
    spark.createDataFrame([(k, 0, [0.5] * 64) for k in range(150)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.QUERIES["soft_hamming"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 2 * 150 and got.schema.simpleString() == "struct<q:bigint,d:bigint,dist:double>"
