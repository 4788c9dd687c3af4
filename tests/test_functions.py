"""Kernels against enumeration, closed forms and the standard library."""

import colorsys
import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodequery.functions import bits, colour, distributions, kbest
from lodequery.functions import logspace as L

sigmoid = lambda z: 1 / (1 + math.exp(-z))


def one(spark, **columns):
    """The columns' values in a frame of one row."""
    r = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return r[0] if len(columns) == 1 else r


def arr(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("n", [1, 5, 63, 64])
def test_pack_and_unpack(spark, n):
    flags = [random.Random(n).random() < 0.5 for _ in range(n - 1)] + [True]
    code = one(spark, c=bits.pack(F.array(*[F.lit(f) for f in flags]), n))
    assert code % (1 << 64) == sum(1 << i for i, f in enumerate(flags) if f)
    assert one(spark, c=bits.unpack(F.lit(code).cast("long"), n)) == flags
    assert one(spark, c=bits.sign_code(arr([1 if f else -1 for f in flags]), n)) == code
    with pytest.raises(ValueError):
        bits.pack(F.array(), 65)


def test_distances_refuse_unequal_lengths(spark):
    a, b = F.array(F.lit(1), F.lit(0)), F.array(F.lit(1))
    assert one(spark, c=bits.hamming_arrays(a, F.array(F.lit(0), F.lit(0)))) == 1
    assert one(spark, c=bits.hamming_words(F.array(F.lit(-1).cast("long"), F.lit(3).cast("long")), F.array(F.lit(0).cast("long"), F.lit(0).cast("long")))) == 66
    for f in (bits.hamming_arrays, bits.hamming_words):
        with pytest.raises(Exception, match="length"):
            one(spark, c=f(a.cast("array<long>"), b.cast("array<long>")))


probabilities = st.floats(0.01, 0.99)


@settings(max_examples=8, deadline=None)
@given(st.lists(probabilities, min_size=1, max_size=7))
def test_poisson_binomial_equals_enumeration(spark, q):
    want = [0.0] * (len(q) + 1)
    for s in itertools.product([0, 1], repeat=len(q)):
        want[sum(s)] += math.prod(p if b else 1 - p for p, b in zip(q, s))
    r = one(spark, lp=distributions.log_poisson_binomial(F.transform(arr(q), lambda p: F.ln(1 - p)), F.transform(arr(q), F.ln)), p=distributions.poisson_binomial(arr(q)))
    assert [math.exp(x) for x in r.lp] == pytest.approx(want) and r.p == pytest.approx(want)


def test_unequal_arrays_are_refused(spark):
    with pytest.raises(Exception, match="length"):
        one(spark, c=distributions.log_poisson_binomial(arr([0.4]), arr([0.6, 0.9])))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(probabilities, probabilities), min_size=1, max_size=6))
def test_hamming_binomial_and_any(spark, pairs):
    logit = lambda p: math.log(p / (1 - p))
    p1, p2 = zip(*pairs)
    none, some = distributions.log_any(F.transform(arr(p1), lambda p: F.ln(1 - p)), F.transform(arr(p1), F.ln))
    r = one(spark, h=distributions.log_hamming_binomial(arr(map(logit, p1)), arr(map(logit, p2))), n=none, s=some)
    want = [0.0] * (len(pairs) + 1)
    for a, b in itertools.product(itertools.product([0, 1], repeat=len(pairs)), repeat=2):
        want[sum(x != y for x, y in zip(a, b))] += math.prod((p if x else 1 - p) * (q if y else 1 - q) for x, y, p, q in zip(a, b, p1, p2)) if len(pairs) < 5 else 0
    if len(pairs) < 5:
        assert [math.exp(x) for x in r.h] == pytest.approx(want)
    assert sum(math.exp(x) for x in r.h) == pytest.approx(1)
    assert math.exp(r.n) == pytest.approx(math.prod(1 - p for p in p1)) and math.exp(r.n) + math.exp(r.s) == pytest.approx(1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-4, 4)] * 3), min_size=1, max_size=5))
def test_bit_algebra(spark, rows):
    x, y, a = zip(*rows)
    cases = [
        (L.bits_equal(arr(x), arr(y)), lambda p, q, s: p == q), (L.bits_subset(arr(x), arr(y)), lambda p, q, s: p <= q),
        (L.bits_equal_or(arr(x), arr(y), arr(a)), lambda p, q, s: p == q or s), (L.bits_subset_or(arr(x), arr(y), arr(a)), lambda p, q, s: p <= q or s),
    ]
    got = one(spark, **{f"{side}{k}": c for k, (pair, _) in enumerate(cases) for side, c in zip(("no", "yes"), pair)})
    for k, (_, holds) in enumerate(cases):
        want = [sum(math.prod(sigmoid(v) if b else 1 - sigmoid(v) for v, b in zip(z, bits_)) for bits_ in itertools.product([False, True], repeat=3) if holds(*bits_)) for z in rows]
        assert [math.exp(v) for v in got[f"yes{k}"]] == pytest.approx(want)
        assert [math.exp(v) for v in got[f"no{k}"]] == pytest.approx([1 - w for w in want])


def test_log_arithmetic_at_the_edges(spark):
    inf = float("inf")
    assert one(spark, c=L.logsumexp(F.lit(-inf), F.lit(-inf))) == -inf
    assert one(spark, c=L.logaddexp(F.lit(-inf), F.lit(-inf))) == -inf and one(spark, c=L.logaddexp(F.lit(-inf), F.lit(2.0))) == 2
    assert one(spark, c=L.logsumexp_array(arr([-inf, -inf]))) == -inf
    assert one(spark, c=L.logsumexp(F.lit(1000.0), F.lit(1000.0))) == pytest.approx(1000 + math.log(2))
    assert one(spark, c=L.logsubexp(F.lit(1.0), F.lit(1.0))) == -inf and math.isnan(one(spark, c=L.logsubexp(F.lit(0.0), F.lit(1.0))))
    assert one(spark, c=L.categorical_entropy(arr([-inf, 0.0]))) == 0
    assert one(spark, c=L.maximum(F.lit(1.0), F.lit(None).cast("double"))) is None
    r = one(spark, a=L.log_sigmoid_pair(F.lit(-800.0))[0], b=L.log_sigmoid_pair(F.lit(-800.0))[1])
    assert r.a == 0 and r.b == -800
    ramp = [one(spark, c=L.ramp(F.lit(v).cast("double"), 10, 30, 6, 2)) for v in (-4, 10, 15, 30, 99, None)]
    assert ramp == [6, 6, 5, 2, 2, 2]
    drawn = random.Random(11).choices(range(6), k=25)
    assert one(spark, c=L.unique_in_order(F.array(*map(F.lit, drawn)))) == list(dict.fromkeys(drawn))
    assert one(spark, c=L.complex_exp(*L.complex_log(F.lit(-3.0), F.lit(4.0)))[0]) == pytest.approx(-3)


@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.integers(0, 9), min_size=1, max_size=6), k=st.integers(1, 80))
def test_cheapest_subsets_equal_enumeration(spark, values, k):
    got = one(spark, c=kbest.cheapest_subsets(arr(values), len(values), k))
    want = sorted((float(sum(v for i, v in enumerate(values) if m >> i & 1)), m) for m in range(1 << len(values)))[:k]
    assert [(x.cost, x.mask) for x in got] == want


def test_outcomes_descend_in_probability(spark):
    z = [3.1, -0.4, 0.2, -7.0, 1.5, 0.9, -2.2, 0.05]
    got = one(spark, c=kbest.likeliest_outcomes(arr(z), 8))
    prob = lambda c: math.prod(sigmoid(x) if c >> i & 1 else 1 - sigmoid(x) for i, x in enumerate(z))
    ps = [prob(x.code) for x in got]
    assert len({x.code for x in got}) == 256 and all(a >= b - 1e-15 for a, b in zip(ps, ps[1:]))
    assert one(spark, c=kbest.logits_of(arr([math.log(1 - sigmoid(v)) for v in z[:3]]))) == pytest.approx(z[:3])
    with pytest.raises(Exception, match="negative"):
        one(spark, c=kbest.cheapest_subsets(arr([-1.0]), 1))
    with pytest.raises(ValueError):
        kbest.cheapest_subsets(arr([1.0] * 20), 20)


def test_hypergeometric_family(spark):
    sizes = spark.createDataFrame([("a", 9, 4), ("b", 31, 0), ("c", 40, 40), ("d", 1, 1), ("e", 0, 0), ("f", 120, 17), ("g", None, 3)], "k string, n_all int, n_white int")
    numbers = {r.k: (r.n_all, r.n_white) for r in sizes.collect()}
    got = distributions.hypergeometric_of(sizes).collect()
    assert len(got) == sum((n + 1) * (w + 1) for k, (n, w) in numbers.items() if k != "g")
    for r in got:
        n, w = numbers[r.k]
        want = math.comb(w, r.whites) * math.comb(n - w, r.draws - r.whites) / math.comb(n, r.draws) if r.whites <= r.draws else 0
        assert r.p == pytest.approx(want, abs=1e-12)
    few = distributions.hypergeometric_of(sizes.where("k = 'f'"), 5).collect()
    assert {r.draws for r in few} == set(range(6)) and len(few) == 6 * 18
    with pytest.raises(Exception, match="n_white"):
        distributions.hypergeometric_of(spark.createDataFrame([(3, 4)], "n_all int, n_white int")).collect()
    with pytest.raises(ValueError):
        distributions.hypergeometric(spark, 3, 4)


@pytest.mark.parametrize("n, w", [(260, 9), (10_000, 125)])
def test_draws_needed_have_their_expectation(spark, n, w):
    need = distributions.draws_needed(spark, n, w)
    by = {r.whites: (r.e, r.p) for r in need.groupBy("whites").agg(F.sum(F.col("draws") * F.col("p")).alias("e"), F.sum("p").alias("p")).collect()}
    expected = {r.whites: r.draws for r in distributions.draws_expected(spark, n, w).collect()}
    assert set(by) == set(expected) == set(range(w + 1))
    for k, (e, p) in by.items():
        assert p == pytest.approx(1, abs=1e-10) and e == pytest.approx(expected[k], rel=1e-10, abs=1e-8) and expected[k] == pytest.approx((n + 1) / (w + 1) * k)


def test_log_factorials(spark):
    n = [*range(40), 1000, 10**6, 10**12]
    got = spark.createDataFrame([(k,) for k in n], "n long").select(distributions.log_factorial(F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(k + 1) for k in n], rel=1e-14, abs=1e-13)


def test_colours_agree_with_the_library(spark):
    r = random.Random(1)
    px = [tuple(r.random() for _ in range(3)) for _ in range(30)] + [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, 1.0)]
    df = spark.createDataFrame(px, "r double, g double, b double")
    h, l, s = colour.rgb_to_hls(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    df = df.select("*", h.alias("h"), l.alias("l"), s.alias("s"))
    back = colour.hls_to_rgb(F.col("h"), F.col("l"), F.col("s"))
    for x in df.select("*", *[c.alias(n) for c, n in zip(back, ("r2", "g2", "b2"))]).collect():
        assert (x.h, x.l, x.s) == pytest.approx(colorsys.rgb_to_hls(x.r, x.g, x.b))
        assert (x.r2, x.g2, x.b2) == pytest.approx((x.r, x.g, x.b))
