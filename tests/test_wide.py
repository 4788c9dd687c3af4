"""Codes of any length, subsets of any number of values."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequery.operators import subsets
from lodequery.operators.multi_index import MultiIndex, mask_array, part_code
from pyspark.sql import functions as F


def words(bits: int, nbits: int) -> list[int]:
    out = [(bits >> at) & ((1 << 64) - 1) for at in range(0, nbits, 64)]
    return [w - (1 << 64) if w >= 1 << 63 else w for w in out]


@pytest.mark.parametrize("nbits, radius, parts", [(128, 12, 8), (128, 12, None), (64, 9, 5), (200, 3, 7), (10, 10, 2), (70, 0, 3)])
def test_multi_index_against_all_pairs(spark, nbits, radius, parts):
    r = random.Random(nbits + radius)
    seeds = [r.getrandbits(nbits) for _ in range(6)]
    near = lambda c: c ^ sum(1 << b for b in r.sample(range(nbits), r.randrange(0, min(nbits, 2 * radius + 1) + 1)))
    docs = [(k, near(r.choice(seeds))) for k in range(150)] + [(k, r.getrandbits(nbits)) for k in range(150, 180)]
    docs += [(3, near(seeds[0])), docs[0], docs[0]]
    queries = [(k, near(c)) for k, c in enumerate(seeds)] + [(9, r.getrandbits(nbits))]
    d = spark.createDataFrame([(k, words(c, nbits)) for k, c in docs] + [(999, None)], "doc long, code array<bigint>")
    q = spark.createDataFrame([(k, words(c, nbits)) for k, c in queries] + [(8, None)], "q long, code array<bigint>")
    index = MultiIndex(spark, nbits, radius, parts, 180).insert(d.limit(100)).insert(d.subtract(d.limit(100)))
    least = {}
    for (i, a), (j, b) in itertools.product(queries, docs):
        dist = (a ^ b).bit_count()
        if dist <= radius:
            least[i, j] = min(dist, least.get((i, j), dist))
    assert {(x.q, x.doc): x.step for x in index.candidates(q).collect()} == least
    if nbits == 64:
        found = {x.q: x.docs for x in index.search(q).collect()}
        assert found == {i: sorted(j for a, j in least if a == i) for i in [*range(6), 8, 9]}
        assert index.reset().candidates(q).collect() == []


def test_parts_and_masks(spark):
    code = random.Random(1).getrandbits(190)
    df = spark.createDataFrame([(words(code, 190),)], "c array<bigint>")
    cuts = [(0, 10), (60, 10), (63, 2), (64, 62), (120, 20), (128, 62), (2, 62)]
    got = df.select(*[part_code(F.col("c"), a, n) for a, n in cuts]).first()
    assert list(got) == [(code >> a) & ((1 << n) - 1) for a, n in cuts]
    for size, radius in ((5, 0), (5, 2), (4, 4), (1, 1), (12, 3)):
        masks = spark.range(1).select(mask_array(F.lit(size), F.lit(radius)).alias("m")).first().m
        assert sorted(masks) == sorted(sum(1 << b for b in c) for w in range(radius + 1) for c in itertools.combinations(range(size), w))
    assert MultiIndex(spark, 128, 12, 8).n_probes() < 1500 < 10**15
    for wrong in ((0, 0, 1), (8, 9, 1), (8, 2, 9)):
        with pytest.raises(ValueError):
            MultiIndex(spark, *wrong)
    with pytest.raises(ValueError):
        MultiIndex(spark, 60, 30, 1)  # too many masks
    with pytest.raises(Exception, match="2 words"):
        MultiIndex(spark, 128, 2, 8).insert(spark.createDataFrame([(1, [5])], "doc long, code array<bigint>")).index.collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40).map(lambda x: x / 8), max_size=9))
def test_all_subsets_in_order(values):
    got = list(subsets.cheapest_first(values))
    every = [c for n in range(len(values) + 1) for c in itertools.combinations(range(len(values)), n)]
    assert sorted(tuple(s) for _, s in got) == sorted(every)
    assert [c for c, _ in got] == sorted(sum(values[i] for i in s) for s in every)
    assert all(c == sum(values[i] for i in s) for c, s in got)


def test_a_thousand_values(spark):
    r = random.Random(2)
    values = [r.random() for _ in range(1000)]
    df = spark.createDataFrame([(1, values, "x"), (2, [3.0, 1.0], "y"), (3, [], "z"), (4, None, "w")], "id long, v array<double>, rank0 string")
    got = subsets.cheapest_subsets(df, "v", 10_000).orderBy("id", "rank").collect()
    first = [x for x in got if x.id == 1]
    assert len(first) == 10_000 and [x.rank for x in first] == list(range(10_000)) and len({tuple(x["items"]) for x in first}) == 10_000
    costs = [x.cost for x in first]
    assert costs == sorted(costs) and all(abs(x.cost - sum(values[i] for i in x["items"])) < 1e-9 for x in first)
    low = sorted(values)
    # Nothing cheaper is left out: whatever costs less than the last lies among its cheap values, and can be counted.
    cheap, last = [v for v in low if v < costs[-1]], costs[-1]
    count = lambda at, room: 1 + sum(count(i + 1, room - cheap[i]) for i in range(at, len(cheap)) if cheap[i] < room)
    assert count(0, last - 1e-12) <= 10_000 <= count(0, last + 1e-12)
    assert [(x.cost, x["items"]) for x in got if x.id == 2] == [(0.0, []), (1.0, [1]), (3.0, [0]), (4.0, [0, 1])]
    assert [(x.cost, x["items"]) for x in got if x.id == 3] == [(0.0, [])] and not [x for x in got if x.id == 4]
    with pytest.raises(ValueError):
        list(subsets.cheapest_first([1.0, -1.0], 3))
    with pytest.raises(ValueError):
        list(subsets.cheapest_first([1.0, None], 3))
