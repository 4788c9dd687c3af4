"""Search structures against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodequery.operators import grid as G
from lodequery.operators.multiprobe import MultiProbe
from lodequery.operators.radius import RadiusSearch, masks, within_radius
from lodequery.operators.search import SearchStructure
from lodequery.streaming import ingest


def found(df):
    return {r.q: set(r.docs) for r in df.collect()}


NBITS, RADIUS = 6, 2


@pytest.fixture
def radius_sides(spark):
    r = random.Random(17)
    docs, queries = [r.getrandbits(NBITS) for _ in range(14)], [r.getrandbits(NBITS) for _ in range(5)]
    frames = [spark.createDataFrame(list(enumerate(x)), f"{name} long, code long") for x, name in ((docs, "doc"), (queries, "q"))]
    return docs, queries, *frames


def test_radius_search(spark, radius_sides):
    codes, asked, docs, queries = radius_sides
    within = lambda radius: {q: {d for d, b in enumerate(codes) if (a ^ b).bit_count() <= radius} for q, a in enumerate(asked)}
    s = RadiusSearch(spark, NBITS, RADIUS).insert(docs)
    assert [m.bit_count() for m in s.masks] == [w for w in range(RADIUS + 1) for _ in range(math.comb(NBITS, w))] and len(set(s.masks)) == len(s.masks)
    assert len(masks(64, 2)) == 1 + 64 + math.comb(64, 2)
    assert found(s.search(queries)) == within(RADIUS)
    for q, a in enumerate(asked):
        want = [sorted(d for d, b in enumerate(codes) if a ^ b == m) for m in s.masks]
        assert [r.docs for r in s.iterate(queries, q, yield_empty=True)] == want
        assert [r.docs for r in s.iterate(queries, q)] == [x for x in want if x]
    assert found(s.reset().search(queries)) == {q: set() for q in range(len(asked))}
    assert found(RadiusSearch(spark, NBITS, 0).insert(docs).search(queries)) == within(0)
    with pytest.raises(ValueError):
        RadiusSearch(spark, NBITS, NBITS + 1)


def test_radius_with_more_tables_and_wide_codes(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    codes = [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(6)]
    docs = spark.createDataFrame([(k, signed(c)) for k, c in enumerate(codes)], "doc long, code long")
    queries = spark.createDataFrame([(k, signed(c)) for k, c in enumerate(base)], "q long, code long")
    m = [x % (1 << 64) for x in masks(64, 1)]
    for tables in (1, 3):
        want = {q: {d for d, c in enumerate(codes) if any((b ^ c ^ m[t]).bit_count() <= 1 for t in range(tables))} for q, b in enumerate(base)}
        assert found(RadiusSearch(spark, 64, 1, tables).insert(docs).search(queries)) == want
    for n in (1, 10**9):  # both plans
        got = {(r.q, r.doc, r.dist) for r in within_radius(queries, docs, 64, 2, n).collect()}
        assert got == {(q, d, (b ^ c).bit_count()) for q, b in enumerate(base) for d, c in enumerate(codes) if (b ^ c).bit_count() <= 2}


BITS, TABLES, LOOKUPS = 4, 3, 5


@pytest.fixture
def probes(spark):
    r = random.Random(23)
    sides = [[[r.uniform(-3, 3) for _ in range(BITS)] for _ in range(n)] for n in (12, 4)]
    return *sides, *[spark.createDataFrame(list(enumerate(x)), f"{name} long, logits array<double>") for x, name in zip(sides, ("doc", "q"))]


def likeliest(z):
    """All codes, the likeliest first."""
    return sorted(range(1 << len(z)), key=lambda c: sum(math.log1p(math.exp(-v if c >> i & 1 else v)) for i, v in enumerate(z)))


def test_multi_probe(spark, probes, tmp_path):
    held, asked, docs, queries = probes
    tables = [{} for _ in range(TABLES)]
    for d, z in enumerate(held):
        for t, c in enumerate(likeliest(z)[:TABLES]):
            tables[t].setdefault(c, set()).add(d)
    steps = {}
    for q, z in enumerate(asked):
        seen, steps[q] = set(), []
        for c in likeliest(z)[:LOOKUPS]:
            for t in tables:
                steps[q].append(sorted(t.get(c, set()) - seen))
                seen |= t.get(c, set())
    s = MultiProbe(spark, BITS, TABLES, LOOKUPS).insert(docs)
    want = {q: {d for x in steps[q] for d in x} for q in steps}
    assert found(s.search(queries)) == want
    for q in steps:
        assert [r.docs for r in s.iterate(queries, q, LOOKUPS, True)] == steps[q]
        assert [r.docs for r in s.iterate(queries, q, LOOKUPS)] == [x for x in steps[q] if x]
    assert {(r.table_no, r.n_buckets, round(r.avg_size, 9), r.max_size) for r in s.bucket_sizes().collect()} == {(k, len(t), round(len(held) / len(t), 9), max(map(len, t.values()))) for k, t in enumerate(tables)}
    assert found(s.insert(docs).search(queries)) == want  # buckets are sets
    again = MultiProbe(spark, BITS, TABLES, LOOKUPS).set_state(s.state())
    assert found(again.search(queries)) == want
    with pytest.raises(Exception, match="logits"):
        MultiProbe(spark, BITS + 1, TABLES).insert(docs).index.collect()
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, s, str(tmp_path / "index"), str(tmp_path / "offsets")).awaitTermination()
    assert set(map(tuple, ingest.read_index(spark, str(tmp_path / "index")).collect())) == set(map(tuple, s.index.collect()))


def test_interface_defaults(spark):
    s = SearchStructure(spark)
    for f in (s.keys, lambda d: s.probes(d, None)):
        with pytest.raises(NotImplementedError):
            f(None)

    class Exact(SearchStructure):
        def keys(self, docs):
            return docs.select(F.lit(0).alias("table_no"), F.col("code"), "doc")

        def probes(self, queries, limit=None):
            return queries.select("q", F.lit(0).cast("long").alias("step"), F.lit(0).alias("table_no"), "code")

    e = Exact(spark).insert(spark.createDataFrame([(1, 5), (2, 6), (3, 5)], "doc long, code long"))
    assert found(e.search(spark.createDataFrame([(0, 5), (1, 7)], "q long, code long"))) == {0: {1, 3}, 1: set()}


LOW, HIGH, DIV = [0.0, 10.0, -5.0], [6.0, 12.0, 4.0], [3, 5, 6]


def test_grid_arithmetic(spark):
    g, r = G.Grid(LOW, HIGH, DIV), random.Random(31)
    points = [[r.uniform(a, b) for a, b in zip(LOW, HIGH)] for _ in range(20)] + [LOW]
    p = F.col("p")
    got = spark.createDataFrame([(x,) for x in points], "p array<double>").select("p", g.scaled(p).alias("s"), g.cell(p).alias("c"), g.place_in_cell(p).alias("r"), g.in_bounds(p).alias("ok"), g.cell_in_bounds(g.cell(p)).alias("cell_ok")).collect()
    for x in got:
        units = [n * (v - a) / (b - a) for v, a, b, n in zip(x.p, LOW, HIGH, DIV)]
        assert x.s == pytest.approx(units) and x.c == [math.floor(u) for u in units] and x.r == pytest.approx([u - math.floor(u) for u in units]) and x.ok and x.cell_ok
    for axis in range(3):
        for v, cell in ((HIGH[axis], DIV[axis]), (LOW[axis] - 0.01, -1)):  # half open
            point, at = [*LOW], [0, 0, 0]
            point[axis], at[axis] = v, cell
            assert not any(spark.range(1).select(g.in_bounds(arr(point)), g.cell_in_bounds(F.array(*map(F.lit, at)))).first())
    with pytest.raises(ValueError):
        G.Grid([2.0], [1.0], [4])


def arr(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_grid_search_against_brute_force(spark):
    r = random.Random(37)
    pts = [[r.uniform(a, b) for a, b in zip(LOW, HIGH)] for _ in range(280)]
    pts += pts[:3]
    qs = [[r.uniform(a, b) for a, b in zip(LOW, HIGH)] for _ in range(8)]
    points = spark.createDataFrame(list(enumerate(pts)), "doc long, point array<double>")
    queries = spark.createDataFrame(list(enumerate(qs)), "q long, point array<double>")
    s = G.GridSearch(G.Grid(LOW, HIGH, DIV)).insert(points)
    order = {q: sorted((math.dist(a, b), d) for d, b in enumerate(pts)) for q, a in enumerate(qs)}
    for k in (1, 30, 400):
        got = s.nearest(queries, k).orderBy("q", "rank").collect()
        for q in range(len(qs)):
            mine = [(x.dist, x.doc) for x in got if x.q == q]
            assert [d for _, d in mine] == [d for _, d in order[q][:k]] and [x for x, _ in mine] == pytest.approx([x for x, _ in order[q][:k]])
    for most in (0.0, 1.2, -1.0):
        assert sorted((x.q, x.doc) for x in s.nearest(queries, 30, most).collect()) == sorted((q, d) for q in order for x, d in order[q][:30] if x < most)
    for most in (0.0, 1.0, -1.0):
        assert {(x.q, x.doc) for x in s.within(queries, most).collect()} == {(q, d) for q in order for x, d in order[q] if x < most}
    assert s.ordered_cells(queries).count() == 8 * 90 and s.grid.all_cells(spark).distinct().count() == 90
    for q in (0, 5):
        every = s.ordered_cells(queries).where(F.col("q") == q).orderBy("lb", "cell").collect()
        assert [(x.cell, x.lb) for x in s.iterate_cells(queries, q)] == [(x.cell, x.lb) for x in every]
        assert [x.cell for x, _ in zip(s.iterate_cells(queries, q), range(3))] == [x.cell for x in every[:3]]
        assert {tuple(x.cell) for x in s.near_cells(queries, 1.5).where(F.col("q") == q).collect()} == {tuple(x.cell) for x in every if x.lb < 1.5}
    out = spark.createDataFrame([(0, [9.0, 11.0, 0.0])], "q long, point array<double>")
    for f in (lambda: s.within(out, 1.0).collect(), lambda: G.GridSearch(s.grid).insert(out.withColumnRenamed("q", "doc")).points.collect()):
        with pytest.raises(Exception, match="out of bounds"):
            f()


def test_inserts_shuffle_nothing_and_a_stored_index_is_not_shuffled_again(spark):
    docs = spark.createDataFrame([(k, k % 7) for k in range(60)], "doc long, code long")
    queries = docs.select((F.col("doc") + 100).alias("q"), "code").limit(9)
    s = RadiusSearch(spark, 4, 1, 2).insert(docs).insert(docs)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(s._rows) and s.index.count() == 120
    want = found(s.search(queries))
    at, small = spark.conf.get("spark.sql.warehouse.dir"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert found(s.store("stored_index", 3).search(queries)) == want and s.index.count() == 120
        hits = s.probes(queries, None).join(s._rows, ["table_no", "code"])
        assert plan(hits).count("Exchange hashpartitioning") == 1, at  # of the probes
        assert found(s.insert(docs.select((F.col("doc") + 60).alias("doc"), "code")).search(queries)) == {q: x | {d + 60 for d in x} for q, x in want.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        spark.sql("DROP TABLE IF EXISTS stored_index")
