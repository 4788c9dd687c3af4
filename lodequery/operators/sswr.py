"""Sequential-search work ratio: what a candidate stream costs against scanning everything in random order.

A stream is a table (q, step, doc); relevance is (q, doc).  One window per query
turns it into running counts, from which every variant follows.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DUPLICATES = ("raise", "ignore")


def matching_cost(n: Column, n_rel: Column, n_need: Column) -> Column:
    """Expected draws from n items, n_rel of them relevant, until n_need relevant ones are found."""
    return n_need * (n + 1.0) / (n_rel + 1.0)


def _needs(relevant: DataFrame, recall: float) -> DataFrame:
    """(q, n_rel, n_need); a query without relevant documents has no ratio and is refused."""
    return _asked_of(relevant.select("q", "doc").distinct().groupBy("q").agg(F.count("doc").alias("n_rel")), recall)


def _asked_of(sizes: DataFrame, recall: float) -> DataFrame:
    counts = sizes.select("q", F.col("n_rel").cast("double").alias("n_rel"))
    need = F.ceil(F.lit(float(recall)) * F.col("n_rel")).cast("double")
    return counts.select("q", "n_rel", F.when(need > 0, need).otherwise(F.raise_error(F.lit("nothing to find")).cast("double")).alias("n_need"))


def _steps(candidates: DataFrame, relevant: DataFrame, on_duplicate: str, count_empty: bool, cost: Column | None) -> DataFrame:
    """(q, s, n_new, n_hit, cost) of each step, numbered from 1.

    Without count_empty, steps that add nothing new but had candidates still count, and numbers without
    any row don't; with it, the step numbers as given (from 0) are calls made.
    """
    if on_duplicate not in DUPLICATES:
        raise ValueError(f"on_duplicate must be one of {DUPLICATES}")
    c = candidates.groupBy("q", "step", "doc").agg(F.max(cost if cost is not None else F.lit(0.0)).alias("cost"))
    nth = F.row_number().over(Window.partitionBy("q", "doc").orderBy("step"))
    c = c.withColumn("again", nth > 1)
    if on_duplicate == "raise":
        c = c.withColumn("again", F.when(F.col("again"), F.raise_error(F.lit("a candidate came twice")).cast("boolean")).otherwise(False))
    rel = relevant.select("q", "doc").distinct().withColumn("hit", F.lit(1))
    c = c.join(rel, ["q", "doc"], "left")
    new = ~F.col("again")
    per = c.groupBy("q", "step").agg(F.sum(new.cast("int")).cast("double").alias("n_new"), F.sum((new & F.col("hit").isNotNull()).cast("int")).cast("double").alias("n_hit"), F.max("cost").alias("cost"))
    return _numbered(per, count_empty)


def _numbered(per: DataFrame, count_empty: bool) -> DataFrame:
    s = F.col("step") + 1 if count_empty else F.dense_rank().over(Window.partitionBy("q").orderBy("step"))
    return per.select("q", s.cast("long").alias("s"), "n_new", "n_hit", "cost")


def _states(candidates: DataFrame, relevant: DataFrame, n: int, recall: float, on_duplicate: str, eta: float, count_empty: bool, cost: Column | None) -> DataFrame:
    """Running state after each step, with step 0; and whether the need was met by then."""
    return _run(_steps(candidates, relevant, on_duplicate, count_empty, cost), _needs(relevant, recall), n, eta, cost is not None)


def _counted(counts: DataFrame, sizes: DataFrame, n: int, recall: float, eta: float, count_empty: bool, cost: Column | None) -> DataFrame:
    """The same from counts(q, step, n_new, n_hit) of each step that counts and sizes(q, n_rel)."""
    per = counts.select("q", "step", F.col("n_new").cast("double").alias("n_new"), F.col("n_hit").cast("double").alias("n_hit"), (F.lit(0.0) if cost is None else cost).alias("cost"))
    return _run(_numbered(per, count_empty), _asked_of(sizes, recall), n, eta, cost is not None)


def _run(steps: DataFrame, needs: DataFrame, n: int, eta: float, costly: bool) -> DataFrame:
    first = needs.select("q", F.lit(0).cast("long").alias("s"), F.lit(0.0).alias("n_new"), F.lit(0.0).alias("n_hit"), F.lit(0.0).alias("cost"))
    upto = Window.partitionBy("q").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    calls = F.col("s") * F.lit(float(eta)) if not costly else F.sum("cost").over(upto)
    run = first.unionByName(steps).join(needs, "q").withColumn("seen", F.sum("n_new").over(upto)).withColumn("hits", F.sum("n_hit").over(upto)).withColumn("calls", calls)
    base = matching_cost(F.lit(float(n)), F.col("n_rel"), F.col("n_need"))
    before = F.col("n_need") - (F.col("hits") - F.col("n_hit"))
    done = matching_cost(F.col("n_new"), F.col("n_hit"), before) + F.col("seen") - F.col("n_new") + F.col("calls")
    short = matching_cost(n - F.col("seen"), F.col("n_rel") - F.col("hits"), F.col("n_need") - F.col("hits")) + F.col("seen") + F.col("calls")
    run = run.withColumn("met", F.col("hits") >= F.col("n_need"))
    return run.select("q", "s", "met", (F.when(F.col("met"), done).otherwise(short) / base).alias("ratio"))


def work_ratio(candidates: DataFrame, relevant: DataFrame, n: int, *, recall: float = 1.0, allow_halt: bool = False, on_duplicate: str = "raise", eta: float = 1.0, count_empty: bool = False, cost: Column | None = None) -> DataFrame:
    """(q, ratio, halted) of every query of relevant over n documents.

    A step's call costs eta, or the column cost (say, seconds measured) where given.  A stream that ends
    before the need is met is an error, or with allow_halt goes on by sequential scan.
    """
    return _ends(_states(candidates, relevant, n, recall, on_duplicate, eta, count_empty, cost), allow_halt)


def counted_work_ratio(counts: DataFrame, sizes: DataFrame, n: int, *, recall: float = 1.0, allow_halt: bool = False, eta: float = 1.0, count_empty: bool = False, cost: Column | None = None) -> DataFrame:
    """work_ratio() from counts(q, step, n_new, n_hit) of the stream's steps and sizes(q, n_rel), the number of each query's relevant documents."""
    return _ends(_counted(counts, sizes, n, recall, eta, count_empty, cost), allow_halt)


def _ends(states: DataFrame, allow_halt: bool) -> DataFrame:
    end = states.groupBy("q").agg(F.min(F.when(F.col("met"), F.struct("s", "ratio"))).alias("done"), F.max(F.struct("s", "ratio")).alias("last"))
    halted = F.col("done").isNull()
    halted = halted if allow_halt else F.when(halted, F.raise_error(F.lit("the candidates end before the recall is reached")).cast("boolean")).otherwise(False)
    return end.select("q", F.coalesce(F.col("done.ratio"), F.col("last.ratio")).alias("ratio"), halted.alias("halted"))


def halting_work_ratio(candidates: DataFrame, relevant: DataFrame, n: int, max_halt: int, *, recall: float = 1.0, on_duplicate: str = "raise", eta: float = 1.0, count_empty: bool = False, cost: Column | None = None) -> DataFrame:
    """(q, halt, ratio, halted) when the stream is left after halt = 0..max_halt steps."""
    return _halts(_states(candidates, relevant, n, recall, on_duplicate, eta, count_empty, cost), max_halt)


def counted_halting_work_ratio(counts: DataFrame, sizes: DataFrame, n: int, max_halt: int, *, recall: float = 1.0, eta: float = 1.0, count_empty: bool = False, cost: Column | None = None) -> DataFrame:
    """halting_work_ratio() from the same counts as counted_work_ratio()."""
    return _halts(_counted(counts, sizes, n, recall, eta, count_empty, cost), max_halt)


def _halts(states: DataFrame, max_halt: int) -> DataFrame:
    states = states.where(F.col("s") <= max_halt)
    ends = states.groupBy("q").agg(F.min(F.when(F.col("met"), F.col("s"))).alias("met_at"), F.max("s").alias("last"))
    spine = ends.withColumn("halt", F.explode(F.sequence(F.lit(0), F.lit(max_halt))))
    at = F.least(F.col("halt"), F.col("last"), F.coalesce("met_at", "halt")).cast("long")
    # With empty calls counted, step numbers have gaps: the state is that of the last step not after ``at``.
    lead = states.withColumn("next", F.lead("s").over(Window.partitionBy("q").orderBy("s")))
    got = spine.withColumn("at", at).alias("a").join(lead.alias("b"), (F.col("a.q") == F.col("b.q")) & (F.col("b.s") <= F.col("a.at")) & (F.col("b.next").isNull() | (F.col("b.next") > F.col("a.at"))))
    return got.select(F.col("a.q").alias("q"), "halt", "ratio", (F.col("met_at").isNull() | (F.col("halt") < F.col("met_at"))).alias("halted"))


class CountedCalls:
    """Wraps an iterator; value() is eta for every item it gave."""

    def __init__(self, items: Iterable, eta: float = 1.0):
        self.items, self.eta, self.n = iter(items), eta, 0

    def __iter__(self) -> Iterator:
        return self

    def __next__(self):
        item = next(self.items)
        self.n += 1
        return item

    def value(self) -> float:
        return self.n * self.eta


class TimedCalls(CountedCalls):
    """value() is eta for every second spent waiting for the next item, the end included."""

    spent = 0.0

    def __next__(self):
        began = time.perf_counter()
        try:
            return next(self.items)
        finally:
            self.spent += time.perf_counter() - began

    def value(self) -> float:
        return self.spent * self.eta


def needed(n_rel: int, recall: float) -> int:
    """How many of n_rel a recall asks for, in double arithmetic."""
    return ceil(float(recall) * n_rel)
