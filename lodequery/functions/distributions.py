"""Discrete distributions: Poisson-binomial, Hamming-binomial and the hypergeometric family."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logspace as L


def log_poisson_binomial(lp0: Column, lp1: Column) -> Column:
    """log P(j of the independent bits are one), j = 0..n, as an array; arrays of unequal length are an error."""
    neg = F.lit(L.NEG_INF)

    def add(acc: Column, b: Column) -> Column:
        stay = F.concat(F.transform(acc, lambda a: a + b["p0"]), F.array(neg))
        rise = F.concat(F.array(neg), F.transform(acc, lambda a: a + b["p1"]))
        return F.zip_with(stay, rise, L.logaddexp)

    bits = F.zip_with(lp0, lp1, lambda a, b: F.struct(a.alias("p0"), b.alias("p1")))
    pmf = F.aggregate(bits, F.array(F.lit(0.0)), add)
    return F.when(F.size(lp0) == F.size(lp1), pmf).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("array<double>"))


def poisson_binomial(q: Column) -> Column:
    """P(j of the bits with these probabilities are one), j = 0..n."""

    def add(acc: Column, p: Column) -> Column:
        stay = F.concat(F.transform(acc, lambda a: a * (1 - p)), F.array(F.lit(0.0)))
        rise = F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda a: a * p))
        return F.zip_with(stay, rise, lambda a, b: a + b)

    return F.aggregate(q, F.array(F.lit(1.0)), add)


def pmf_by_transform(q: np.ndarray) -> np.ndarray:
    """Rows of n probabilities to rows of the n + 1 probabilities of their sum.

    The sum's characteristic function is the product over the bits of 1 + q (w - 1), taken at the roots of unity w;
    an inverse transform gives the distribution.  Half of the roots do, as the others are their conjugates.
    """
    rows, n = q.shape
    w = np.exp(2j * np.pi * np.arange((n + 1) // 2 + 1) / (n + 1)) - 1
    value = np.ones((rows, len(w)), complex)
    for j in range(n):
        value *= 1 + q[:, j, None] * w
    return np.maximum(np.fft.irfft(value.conj(), n + 1), 0.0) if n else np.ones((rows, 1))


#: Complex numbers held at once.
AT_ONCE = 1 << 18


def poisson_binomial_fft(q: Column) -> Column:
    """The same as poisson_binomial() by its characteristic function, for many bits: array operations over Arrow batches.

    Absolute errors are about 1e-15 a bit; small probabilities have no relative accuracy.  Null arrays give null; a null
    probability, or one that isn't in 0..1, is an error.
    """

    @F.pandas_udf("array<double>")
    def pmf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            sizes: dict[int, list[int]] = {}
            for i, v in enumerate(s):
                if v is not None:
                    sizes.setdefault(len(v), []).append(i)
            for n, own in sizes.items():
                step = max(1, AT_ONCE // (n + 1))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    x = np.asarray([s.iloc[i] for i in some], float).reshape(len(some), n)
                    if not ((x >= 0) & (x <= 1)).all():
                        raise ValueError("probabilities must be given and lie in 0..1")
                    for i, p in zip(some, pmf_by_transform(x)):
                        out[i] = p
            yield pd.Series(out, index=s.index)

    return pmf(q.cast("array<double>"))


def log_hamming_binomial(x: Column, y: Column) -> Column:
    """log-pmf of the Hamming distance of two codes of independent bits with these logits."""
    differ, agree = L.bits_equal(x, y)
    return log_poisson_binomial(agree, differ)


def log_any(lq0: Column, lq1: Column) -> tuple[Column, Column]:
    """(log P(no bit is one), log P(some bit is one))."""
    pmf = log_poisson_binomial(lq0, lq1)
    return F.element_at(pmf, 1), L.let(pmf, lambda p: L.logsumexp_array(F.slice(p, 2, F.size(p) - 1)))


def log_factorial(n: Column) -> Column:
    """log(n!) of a whole number: a table up to 15, then Stirling's series, whose next term is under 1e-14 there."""
    from math import lgamma

    few = F.array(*[F.lit(lgamma(k + 1)) for k in range(16)])
    x = F.greatest(n, F.lit(16)).cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < 16, F.get(few, n.cast("int"))).otherwise(series)


def _hypergeometric(n_all: Column, n_white: Column, draws: Column, whites: Column) -> Column:
    """P(whites among draws) of n_all marbles, n_white of them white; 0 where that can't be."""
    black, n_black = draws - whites, n_all - n_white
    ok = (whites >= 0) & (whites <= n_white) & (black >= 0) & (black <= n_black)
    up = [n_white, n_black, draws, n_all - draws]
    down = [whites, n_white - whites, black, n_black - black, n_all]
    log_p = sum((log_factorial(x) for x in up[1:]), log_factorial(up[0])) - sum((log_factorial(x) for x in down[1:]), log_factorial(down[0]))
    return F.when(ok, F.exp(log_p)).otherwise(0.0)


def _cells(sizes: DataFrame, draws: bool, most_draws: int | None = None) -> DataFrame:
    """sizes(.., n_all, n_white) with whites = 0..n_white, and draws = 0..n_all (or most_draws) if they are wanted."""
    good = (F.col("n_white") >= 0) & (F.col("n_white") <= F.col("n_all"))
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c)))
    out = sizes.where("n_all is not null and n_white is not null").withColumn("n_all", F.when(good, F.col("n_all").cast("long")).otherwise(F.raise_error(F.lit("need 0 <= n_white <= n_all")).cast("long"))).withColumn("n_white", F.col("n_white").cast("long"))
    if draws:
        last = F.col("n_all") if most_draws is None else F.least(F.col("n_all"), F.lit(most_draws).cast("long"))
        out = out.withColumn("_last", last).withColumn("draws", to("_last")).drop("_last")
    return out.withColumn("whites", to("n_white"))


def hypergeometric_of(sizes: DataFrame, most_draws: int | None = None) -> DataFrame:
    """(.., draws, whites, p) of sizes(.., n_all, n_white): P(whites among draws), for every number of draws up to most_draws.

    A row for each cell, from the row's own numbers: no table of factorials, no window and no shuffle.  Rows with a null
    number give none; n_white outside 0..n_all is an error.
    """
    keep = [c for c in sizes.columns if c not in ("n_all", "n_white")]
    p = _hypergeometric(*[F.col(c) for c in ("n_all", "n_white", "draws", "whites")])
    return _cells(sizes, True, most_draws).select(*keep, "draws", "whites", p.alias("p"))


def draws_needed_of(sizes: DataFrame, most_draws: int | None = None) -> DataFrame:
    """(.., draws, whites, p): P(exactly this many draws are needed to have so many whites)."""
    keep = [c for c in sizes.columns if c not in ("n_all", "n_white")]
    n_all, n_white, draws, whites = (F.col(c) for c in ("n_all", "n_white", "draws", "whites"))
    p = _hypergeometric(n_all, n_white, draws - 1, whites - 1) * (n_white - whites + 1) / (n_all - draws + 1)
    p = F.when(whites == 0, (draws == 0).cast("double")).when(draws == 0, 0.0).otherwise(p)
    return _cells(sizes, True, most_draws).select(*keep, "draws", "whites", p.alias("p"))


def draws_expected_of(sizes: DataFrame) -> DataFrame:
    """(.., whites, draws): the expected number of draws for 0..n_white whites, in closed form."""
    keep = [c for c in sizes.columns if c not in ("n_all", "n_white")]
    return _cells(sizes, False).select(*keep, "whites", ((F.col("n_all") + 1) / (F.col("n_white") + 1) * F.col("whites")).alias("draws"))


def _one(spark: SparkSession, n_all: int, n_white: int) -> DataFrame:
    if not 0 <= n_white <= n_all:
        raise ValueError("need 0 <= n_white <= n_all")
    return spark.range(1).select(F.lit(n_all).cast("long").alias("n_all"), F.lit(n_white).cast("long").alias("n_white"))


def hypergeometric(spark: SparkSession, n_all: int, n_white: int) -> DataFrame:
    """(draws, whites, p) of one pair of numbers."""
    return hypergeometric_of(_one(spark, n_all, n_white))


def draws_needed(spark: SparkSession, n_all: int, n_white: int) -> DataFrame:
    return draws_needed_of(_one(spark, n_all, n_white))


def draws_expected(spark: SparkSession, n_all: int, n_white: int) -> DataFrame:
    return draws_expected_of(_one(spark, n_all, n_white))
