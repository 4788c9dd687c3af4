"""The registered queries that do the whole job, held against numpy and their SQL on small tables."""

import numpy as np
import pytest

from lodequery import queries as Q

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with 230 vectors, so three whose ids are divisible by 100, and the vectors."""
    folder, rng = str(tmp_path_factory.mktemp("whole")), np.random.default_rng(7)
    x, label = rng.normal(size=(230, 64)) / 8, rng.integers(0, 4, 230)
    rows = [(i, int(label[i]), x[i].tolist()) for i in range(230)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder, x.astype(np.float32).astype(float), label


def by_sql(folder: str, name: str, *names: str) -> list[tuple]:
    c = duckdb.connect()
    for t in names or ("embeddings",):
        c.execute(f"CREATE TABLE {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(c.execute(Q.ORACLE[name]).fetchall())


def rows_of(spark, folder: str, name: str) -> list[tuple]:
    return sorted(tuple(r) for r in Q.QUERIES[name](spark, folder).collect())


def same(a: list[tuple], b: list[tuple]) -> None:
    assert len(a) == len(b) > 0
    np.testing.assert_allclose(np.array(a, dtype=float), np.array(b, dtype=float), atol=2e-6)


@pytest.mark.parametrize("kind", ["hashnet", "mihash", "hbkl", "fbeta"])
def test_losses_take_all_pairs(spark, tables, kind):
    folder, x, label = tables
    assert Q.loss_pairs(spark, folder).count() == 3 * 229
    got = rows_of(spark, folder, f"loss_{kind}")
    same(got, by_sql(folder, f"loss_{kind}"))
    if kind == "hashnet":
        t = np.tanh(10 * x)
        want = [(np.log1p(np.exp(s)) - s) / 0.1 if label[q] == label[d] else np.log1p(np.exp(s)) / 0.9 for q in (0, 100, 200) for d in range(230) if d != q for s in [t[q] @ t[d]]]
        assert got[0][0] == pytest.approx(np.mean(want), abs=1e-6)


@pytest.mark.parametrize("name", ["kbest_subsets", "kbest_outcomes"])
def test_kbest_takes_every_vector(spark, tables, name):
    folder, x, _ = tables
    got = rows_of(spark, folder, f"{name}")
    same(got, by_sql(folder, f"{name}"))
    assert {r[0] for r in got} == set(range(230)) and len(got) == 230 * 12
    bits = (np.arange(4096)[:, None] >> np.arange(12)) & 1
    for i in (1, 229):  # not divisible by 5
        small = np.argsort(np.abs(x[i, :63]))[:12]  # the 12 cheapest subsets hold no larger component
        best = np.argsort(bits @ np.abs(x[i, small]), kind="stable")[:12]
        masks = [sum(1 << int(k) for k, b in zip(small, bits[j]) if b) for j in best]
        mode = sum(1 << k for k in range(63) if x[i, k] > 0)
        assert [r[-1] for r in got if r[0] == i] == [m ^ (mode if name == "kbest_outcomes" else 0) for m in masks]


def test_soft_hamming_meets_all_documents(spark, tables):
    folder, x, _ = tables
    got = rows_of(spark, folder, "soft_hamming")
    same(got, by_sql(folder, "soft_hamming"))
    same(got, [(q, d, (64 - x[q] @ x[d]) / 2) for q in (0, 100, 200) for d in range(230)])


@pytest.mark.parametrize("name", ["log_prob_any", "mb_equality", "mb_subset", "mb_act_equality", "mb_act_subset"])
def test_all_components(spark, tables, name):
    got = rows_of(spark, tables[0], f"{name}")
    same(got, by_sql(tables[0], f"{name}"))
    assert name == "log_prob_any" or {r[1] for r in got} == set(range(64))


@pytest.mark.parametrize("name", ["poisson_binomial", "poisson_binomial_linear", "hamming_binomial"])
def test_distributions_of_all_components(spark, tables, name):
    folder, x, _ = tables
    p = 1 / (1 + np.exp(-x))
    if name == "hamming_binomial":
        p = p[:-1] * (1 - p[1:]) + (1 - p[:-1]) * p[1:]
    want = []
    for i, row in enumerate(p):
        pmf = np.ones(1)
        for q in row:
            pmf = np.convolve(pmf, [1 - q, q])
        want += [(i, j, v if name.endswith("linear") else np.log(v)) for j, v in enumerate(pmf)]
    same(rows_of(spark, folder, f"{name}"), want)


def test_parts_and_labels_are_all_taken(spark, tables, tmp_path):
    folder, _, label = tables
    rng, here = np.random.default_rng(3), str(tmp_path)
    parts = [(k, int(rng.integers(1, 51)), float(rng.uniform(900, 2000))) for k in range(1, 231)]
    lines = [(int(o), int(p)) for o, p in rng.integers(1, 231, (500, 2))]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{here}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{here}/lineitem.parquet")
    got = rows_of(spark, here, "mosaic_relation")
    assert got == sorted({(p, o) for o, p in lines}) == by_sql(here, "mosaic_relation", "part", "lineitem")
    got = rows_of(spark, here, "grid_cell_dists")
    same(got, by_sql(here, "grid_cell_dists", "part"))
    assert {r[0] for r in got} == {100, 200} and len(got) == 2 * 17 * 250
    got = rows_of(spark, folder, "match_rate")
    same(got, by_sql(folder, "match_rate"))
    same(got, [(np.mean(label[:, None] == label), np.log(np.mean(label[:, None] == label)))])
