"""The k cheapest subsets of a row's values, and the k likeliest outcomes of its bits, in one expression.

A beam over the values: after each one, the k cheapest subsets of those seen so
far are kept.  That is exact, as a k-cheapest subset restricted to a prefix is
among the k cheapest of the prefix.  Subsets are bit masks; equal sums go by mask.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logspace import let


def cheapest_subsets(values: Column, n: int, k: int | None = None) -> Column:
    """array<struct<cost double, mask long>> of the k subsets of n non-negative values with the least sums, ascending.

    k None means all 2**n, for n up to 16.  A negative value is an error.
    """
    if not 1 <= n <= 63:
        raise ValueError("1 to 63 values")
    if k is None and n > 16:
        raise ValueError("all subsets of more than 16 values: give k")
    k = 1 << n if k is None else min(k, 1 << n)
    empty = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("mask")))

    def add(beam: Column, value: Column) -> Column:
        more = F.transform(beam, lambda x: F.struct((x["cost"] + value["v"]).alias("cost"), x["mask"].bitwiseOR(value["bit"]).alias("mask")))
        return F.slice(F.array_sort(F.concat(beam, more)), 1, k)

    # Each value is worked out once, beside its bit; lambdas work out what they name anew at each call.
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(n)])
    given = F.coalesce(F.slice(values, 1, n), F.array().cast("array<double>"))  # what is missing is null
    best = F.aggregate(F.arrays_zip(given.alias("v"), bits.alias("bit")), empty, add)
    return F.when(F.exists(values, lambda v: v < 0), F.raise_error(F.lit("values must not be negative")).cast("array<struct<cost:double,mask:bigint>>")).otherwise(best)


def likeliest_outcomes(logits: Column, n: int, k: int | None = None) -> Column:
    """array<struct<cost double, code long>> of the k likeliest settings of n bits, descending; cost is log P(first) - log P.

    The likeliest sets each bit with a positive logit; others flip a cheap subset of |logit|.
    """
    mode = F.lit(0).cast("long")
    for i in range(n):
        mode = mode.bitwiseOR(F.when(F.get(logits, F.lit(i)) > 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return let(mode, lambda m: F.transform(cheapest_subsets(F.transform(logits, F.abs), n, k), lambda x: F.struct(x["cost"].alias("cost"), x["mask"].bitwiseXOR(m).alias("code"))))


def logits_of(lp0: Column, lp1: Column | None = None) -> Column:
    """log P(1) - log P(0) of each bit; log P(1) defaults to log(1 - P(0))."""
    if lp1 is None:
        return F.transform(lp0, lambda a: F.log1p(-F.exp(a)) - a)
    return F.zip_with(lp1, lp0, lambda a, b: a - b)


