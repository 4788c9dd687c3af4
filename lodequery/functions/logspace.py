"""Log-space arithmetic, entropies and Bernoulli-vector algebra as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def let(x: Column, f) -> Column:
    """f(x) with x computed once: inside a lambda, an expression from outside would be computed for every element."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def total(xs: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def maximum(*xs: Column) -> Column:
    """Largest of the columns, row by row; null if any is null."""
    return F.when(reduce(lambda a, b: a | b, (x.isNull() for x in xs)), None).otherwise(F.greatest(*xs))


def logaddexp(a: Column, b: Column) -> Column:
    """log(e**a + e**b); two -inf give -inf."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(hi == NEG_INF, F.lit(NEG_INF)).otherwise(hi + F.log1p(F.exp(lo - hi)))


def logsumexp(*xs: Column) -> Column:
    """log of the sum of exponentials of the columns."""
    top = F.greatest(*xs)
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.ln(reduce(lambda a, b: a + b, (F.exp(x - top) for x in xs))))


def logsumexp_array(xs: Column) -> Column:
    """logsumexp of an array's elements."""
    value = lambda top: F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.ln(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))))
    return let(F.array_max(xs), value)


def logsubexp(a: Column, b: Column) -> Column:
    """log(e**a - e**b); NaN where a < b, -inf where they are equal."""
    return F.when(a > b, a + F.log1p(-F.exp(b - a))).when(a == b, F.lit(NEG_INF)).otherwise(F.lit(float("nan")))


def log_sigmoid_pair(logit: Column) -> tuple[Column, Column]:
    """(log P(0), log P(1)) of a bit with this logit, without overflow."""
    tail = F.log1p(F.exp(-F.abs(logit)))
    return -(F.greatest(logit, F.lit(0.0)) + tail), -(F.greatest(-logit, F.lit(0.0)) + tail)


def categorical_entropy(log_p: Column) -> Column:
    """Entropy of an array of log probabilities; -inf adds nothing."""
    return F.aggregate(log_p, F.lit(0.0), lambda a, x: a - F.when(x == NEG_INF, 0.0).otherwise(F.exp(x) * x))


def share_entropy(p: Column) -> Column:
    """Entropy of an array of non-negative weights after normalising."""
    return let(total(p), lambda s: F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / s * F.ln(x / s)).otherwise(0.0)))


def bernoulli_entropy(lp0: Column, lp1: Column) -> Column:
    """Sum of the entropies of independent bits."""
    return categorical_entropy(lp0) + categorical_entropy(lp1)


def kl_divergence(log_p: Column, log_q: Column) -> Column:
    """Sum of e**p (p - q) over two arrays."""
    return total(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q)))


# Bits given by logits; each gives arrays of (log P(no), log P(yes)).


def _two(z: Column, w: Column, no, yes) -> tuple[Column, Column]:
    def at(f):
        def g(x, y):
            (x0, x1), (y0, y1) = log_sigmoid_pair(x), log_sigmoid_pair(y)
            return f(x0, x1, y0, y1)

        return F.zip_with(z, w, g)

    return at(no), at(yes)


def bits_equal(x: Column, y: Column) -> tuple[Column, Column]:
    """Per bit: log P(they differ), log P(they agree)."""
    return _two(x, y, lambda x0, x1, y0, y1: logaddexp(x0 + y1, x1 + y0), lambda x0, x1, y0, y1: logaddexp(x0 + y0, x1 + y1))


def bits_subset(x: Column, y: Column) -> tuple[Column, Column]:
    """Per bit: log P(x without y), log P(x implies y)."""
    return _two(x, y, lambda x0, x1, y0, y1: x1 + y0, lambda x0, x1, y0, y1: logaddexp(x0, x1 + y1))


def _or_active(pair: tuple[Column, Column], active: Column) -> tuple[Column, Column]:
    no = F.zip_with(pair[0], active, lambda n, a: n + log_sigmoid_pair(a)[0])
    yes = F.zip_with(pair[1], F.zip_with(pair[0], active, lambda n, a: n + log_sigmoid_pair(a)[1]), logaddexp)
    return no, yes


def bits_equal_or(x: Column, y: Column, active: Column) -> tuple[Column, Column]:
    """Per bit: agree, or the third bit is set."""
    return _or_active(bits_equal(x, y), active)


def bits_subset_or(x: Column, y: Column, active: Column) -> tuple[Column, Column]:
    """Per bit: x implies y, or the third bit is set."""
    return _or_active(bits_subset(x, y), active)


# Complex numbers as (re, im) columns.


def complex_polar(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)


def complex_log(re: Column, im: Column) -> tuple[Column, Column]:
    r, angle = complex_polar(re, im)
    return F.ln(r), angle


def complex_exp(re: Column, im: Column) -> tuple[Column, Column]:
    return F.exp(re) * F.cos(im), F.exp(re) * F.sin(im)


def complex_product(re: Column, im: Column) -> tuple[Column, Column]:
    """Aggregate: the product of a group's numbers, through the sum of their logarithms."""
    log_r, angle = complex_log(re, im)
    return complex_exp(F.sum(log_r), F.sum(angle))


def group_logsumexp(x: Column, top: Column) -> Column:
    """Aggregate: logsumexp of a group, whose maximum is the column top."""
    return F.when(F.max(top) == NEG_INF, F.lit(NEG_INF)).otherwise(F.max(top) + F.ln(F.sum(F.exp(x - top))))


def ramp(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """y0 up to x0, y1 from x1 on, straight between; null gives y1."""
    return F.when(x.isNull() | (x >= x1), F.lit(float(y1))).when(x <= x0, F.lit(float(y0))).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))


def unique_in_order(xs: Column) -> Column:
    """An array's elements at their first occurrences."""
    return F.array_distinct(xs)


def loss_with_relative_l2(loss: Column, ratio: float) -> Column:
    """Value of a positive loss plus an L2 term scaled to ratio times the loss."""
    return loss * (1 + ratio)
