"""Mixing sources by temperature, realised as budgeted block permutations.

A source with share s of the tokens gets weight s**a / sum(s**a).  The exponent a
in [0, 1] is bisected: the largest whose weights have at least the target entropy
(a share of the most there can be), raised again where a source would then be
repeated more often than the limit allows: under a given budget as often as that
budget draws it, else relative to the source repeated least, which is then drawn
once.  Weights are rounded to millionths, so that everything after is whole numbers.

A budget of tokens is dealt by the weights.  Each source is a stream of epochs,
each epoch another permutation of its documents (by md5 of id, epoch and seed);
block b of the mixture takes the stretch of every source's stream that is its
share of the block, so every block is a small copy of the mixture.  Running token
counts come from counts per (source, epoch, slice of the permutation) and are
finished within each slice, so a hot source is spread over many tasks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

PPM = 1_000_000


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], a: float) -> list[float]:
    """Normalised s**a; sources without tokens stay at 0."""
    p = [s**a if s > 0 else 0.0 for s in shares]
    total = sum(p)
    return [x / total for x in p] if total else p


def bisect_exponent(shares: list[float], *, target_entropy: float = 0.97, repeat_limit: float = 4.0, steps: int = 50, times: float | None = None) -> float:
    """The exponent: the largest that reaches target_entropy * log(sources), unless repeat_limit asks for a larger one.

    times is the budget over the tokens there are.  At an exponent of 1 every source is drawn so often, which
    is the least that the source drawn most can get; a budget beyond repeat_limit is refused.
    """
    if times is not None and times > repeat_limit:
        raise ValueError(f"a budget of {times:.6g} times the tokens repeats some source over {repeat_limit:g} times, whatever the weights")
    live = [s for s in shares if s > 0]
    if len(live) < 2:
        return 1.0
    wanted = target_entropy * math.log(len(live))

    def largest(ok) -> float:
        if ok(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    a = largest(lambda x: entropy(tempered(live, x)) >= wanted)
    if times is not None:
        fits = lambda x: max(w / s for w, s in zip(tempered(live, 1 - x), live)) * times <= repeat_limit
        return a if fits(1 - a) else 1 - largest(fits)
    spread = max(live) / min(live)
    if spread ** (1 - a) > repeat_limit:  # repeats differ by s**(a - 1)
        a = 1 - largest(lambda x: spread**x <= repeat_limit)
    return a


def weights_ppm(shares: list[float], **options) -> list[int]:
    """The weights in millionths; at least 1 for a source with tokens."""
    a = bisect_exponent(shares, **options)
    return [max(1, math.floor(w * PPM + 0.5)) if w > 0 else 0 for w in tempered(shares, a)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


class _Plan(NamedTuple):
    """What all draws follow from: rows (_id, _source, _n, _tie) without texts, and source, tokens, quota and epochs of each source."""

    rows: DataFrame
    budget: int
    sources: list[tuple[str | None, int, int, int]]

    def planned(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(self.sources, "s string, a long, quota long, epochs long")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, budget: int | None, most_sources: int, options: dict) -> _Plan:
    """Texts are read once for this; what is kept of them is written to the shared folder."""
    spark, path = docs.sparkSession, store.new_folder(docs.sparkSession, "mixture")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), word_count(F.col(text_col)).alias("_n"), _tie(F.col(text_col)).alias("_tie"))
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    totals = rows.groupBy("_source").agg(F.sum("_n").alias("a")).orderBy("_source").limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    have = [int(r.a) for r in totals]
    whole = sum(have)
    limit = options.get("repeat_limit", 4.0)
    ppm = weights_ppm([x / whole if whole else 0.0 for x in have], **options, times=None if budget is None or not whole else budget / whole)
    if budget is None:
        budget = max([-(-x * PPM // w) for x, w in zip(have, ppm) if w], default=0)
        quota = [w * budget // PPM for w in ppm]
    else:  # rounded weights may pass the limit by less than a millionth
        quota = [min(w * budget // PPM, math.floor(limit * a)) for w, a in zip(ppm, have)]
    return _Plan(rows, budget, [(r["_source"], a, q, max(1, -(-q // a)) if a else 1) for r, a, q in zip(totals, have, quota)])


def _epochs(rows: DataFrame, planned: DataFrame, seed: int, slices: int) -> DataFrame:
    """Every row once for each epoch of its source, with its draw and slice."""
    drawn = rows.join(F.broadcast(planned), F.col("_source").eqNullSafe(F.col("s")))  # at most most_sources rows
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))).withColumn("draw", _draw(seed))
    return drawn.withColumn("slice", F.floor(F.conv(F.substring("draw", 1, 4), 16, 10).cast("int") * slices / 65536).cast("int"))


def _slice_sums(drawn: DataFrame) -> DataFrame:
    """(s2, e2, b2, before, n): the tokens of each slice of an epoch, and those of the slices before it."""
    sums = drawn.groupBy("_source", "epoch", "slice").agg(F.sum("_n").alias("n"))
    upto = Window.partitionBy("_source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("_source").alias("s2"), F.col("epoch").alias("e2"), F.col("slice").alias("b2"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.col("n").alias("inside"))


def _in_slice() -> Column:
    return F.col("_source").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2")) & (F.col("slice") == F.col("b2"))


def _drawn(plan: _Plan, seed: int, slices: int) -> DataFrame:
    """The draws with where each starts in its source's stream, without texts."""
    drawn = _epochs(plan.rows, plan.planned(), seed, slices)
    drawn = drawn.join(_slice_sums(drawn), _in_slice())
    within = Window.partitionBy("_source", "epoch", "slice").orderBy("draw", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("start", F.col("epoch") * F.col("a") + F.col("before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))


def _tie(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _draw(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("epoch").cast("string"), F.lit(str(seed))))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 7, slices: int = 256, most_sources: int = 100_000, **options) -> DataFrame:
    """The mixture's rows: the id, source, epoch (from 0), block (from 0), draw (orders a block) and n_tokens.

    budget None is the smallest that draws every document once at least; one that draws a source more often
    than repeat_limit whatever the weights is refused with a ValueError.  Tokens are words between
    blanks; documents without any have none, take no budget and lie where they fall; a source without
    any tokens is drawn once, in block 0.  A null source is a source; null ids are drawn like others;
    repeated rows are documents of their own; extra columns don't matter.
    An empty table gives an empty result.  There may be at most most_sources sources, whose totals
    (a row each) pass through the driver.
    """
    plan = _plan(docs, id_col, text_col, source_col, budget, most_sources, options)
    drawn = _drawn(plan, seed, slices)
    blocks = _blocks(plan, block_tokens)
    drawn = drawn.where((F.col("start") < F.col("quota")) | ((F.col("epoch") == 0) & ((F.col("a") == 0) | (F.col("_n") == 0))))
    block = F.least(F.lit(blocks - 1), F.coalesce(F.expr(f"try_divide(start * {blocks}, quota)").cast("long"), F.lit(0)))
    return drawn.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "epoch", block.cast("long").alias("block"), "draw", F.col("_n").alias("n_tokens"))


def _blocks(plan: _Plan, block_tokens: int) -> int:
    return max(1, -(-plan.budget // block_tokens))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 7, slices: int = 256, most_sources: int = 100_000, most_broadcast: int = 1_000_000, **options) -> DataFrame:
    """The rows of docs, each as often as mix_sources() draws it, in the mixture's order: by block, and by draw within one.

    The columns are those of docs, whatever they are called.  All epochs of a source but its last are drawn
    whole, and the last one up to a draw; where a draw lies in its source's stream is read from the tokens of
    the slices before its own and, within the slice, from the draw.  So texts are read again and shuffled once,
    into their order, and a document may lie in the block beside the one that mix_sources() gives it.  Rows of
    equal id and text at the last draw are all taken.  See mix_sources() for nulls, ties and empty tables.
    """
    spark, names = docs.sparkSession, docs.columns
    plan = _plan(docs, id_col, text_col, source_col, budget, most_sources, options)
    drawn = _drawn(plan, seed, slices)
    last = drawn.where((F.col("start") < F.col("quota")) & (F.col("epoch") == F.col("epochs") - 1)).groupBy("_source").agg(F.max(F.struct("draw", "_tie")).alias("x"))
    upto = {r["_source"]: (r["x"]["draw"], r["x"]["_tie"]) for r in last.collect()}  # a row for each source
    planned = spark.createDataFrame([(*p, *upto.get(p[0], ("", ""))) for p in plan.sources], "s string, a long, quota long, epochs long, last_draw string, last_tie string")
    sums = _slice_sums(_epochs(plan.rows, plan.planned(), seed, slices))
    if slices * sum(p[3] for p in plan.sources) <= most_broadcast:  # the most rows it can have
        sums = F.broadcast(sums)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))
    many = _epochs(held, planned, seed, slices)
    taken = (F.col("epoch") < F.col("epochs") - 1) | (F.col("draw") < F.col("last_draw")) | ((F.col("draw") == F.col("last_draw")) & (_tie(F.col("_text")) <= F.col("last_tie")))
    blank = (F.col("epoch") == 0) & ((F.col("a") == 0) | F.col("_text").isNull() | ~F.col("_text").rlike("[^\\x20\\x09-\\x0D]"))
    many = many.where(taken | blank).drop("_text").join(sums, _in_slice())
    inside = F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") / float(1 << 48) * slices - F.col("slice")  # 0 to 1
    start = F.col("epoch") * F.col("a") + F.col("before") + inside * F.col("inside")
    blocks = _blocks(plan, block_tokens)
    block = F.least(F.lit(blocks - 1), F.coalesce(F.try_divide(start * blocks, F.col("quota")).cast("long"), F.lit(0)))
    many = many.select("_row", block.alias("block"), "draw")
    many = many.repartitionByRange("block", "draw").sortWithinPartitions("block", "draw")
    return many.select(*[F.col("_row")[c].alias(c) for c in names])


def mixture_sql(*, target_entropy: float = 0.97, repeat_limit: float = 4.0, steps: int = 50, block_tokens: int = 1 << 20, seed: int = 7) -> str:
    """mix_sources() of documents, with budget None, in DuckDB's SQL."""
    half = lambda ok: f"SELECT i + 1, CASE WHEN {ok} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {ok} THEN hi ELSE (lo + hi) / 2 END"
    ent = lambda x: f"(SELECT -sum(w * ln(w)) FROM (SELECT pow(s, {x}) / sum(pow(s, {x})) OVER () AS w FROM live) AS q)"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
t AS (SELECT source, sum(n)::BIGINT AS a FROM d GROUP BY source),
live AS (SELECT source, a::DOUBLE / (SELECT sum(a) FROM t)::DOUBLE AS s FROM t WHERE a > 0),
g AS (SELECT {target_entropy}::DOUBLE * ln(count(*)) AS wanted, max(s) / min(s) AS spread, count(*) AS k FROM live),
e(i, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL {half(f"{ent('(lo + hi) / 2')} >= (SELECT wanted FROM g)")} FROM e WHERE i < {steps}),
r(i, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL {half(f"pow((SELECT spread FROM g), (lo + hi) / 2) <= {repeat_limit}::DOUBLE")} FROM r WHERE i < {steps}),
x AS (SELECT CASE WHEN k < 2 OR {ent('1::DOUBLE')} >= wanted THEN 1::DOUBLE ELSE (SELECT lo FROM e WHERE i = {steps}) END AS a, spread FROM g),
y AS (SELECT CASE WHEN pow(spread, 1 - a) > {repeat_limit}::DOUBLE THEN 1 - (SELECT lo FROM r WHERE i = {steps}) ELSE a END AS a FROM x),
w AS (SELECT source, greatest(1, floor(pow(s, (SELECT a FROM y)) / sum(pow(s, (SELECT a FROM y))) OVER () * {PPM} + 0.5))::BIGINT AS ppm FROM live),
b AS (SELECT coalesce(max((t.a * {PPM} + w.ppm - 1) // w.ppm), 0)::BIGINT AS budget FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source),
p AS (SELECT t.source, t.a, coalesce(w.ppm, 0) * (SELECT budget FROM b) // {PPM} AS quota FROM t LEFT JOIN w ON t.source IS NOT DISTINCT FROM w.source),
u AS (SELECT d.*, p.a, p.quota, epoch, md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), epoch::VARCHAR, '{seed}')) AS draw
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(CASE WHEN p.a > 0 THEN greatest(1, (p.quota + p.a - 1) // p.a) ELSE 1 END)) AS q(epoch)),
z AS (SELECT *, epoch * a + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY draw, md5(coalesce(text, '')), rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, source, epoch::BIGINT AS epoch, least(greatest(1, ((SELECT budget FROM b) + {block_tokens} - 1) // {block_tokens}) - 1,
       CASE WHEN quota > 0 THEN (start * greatest(1, ((SELECT budget FROM b) + {block_tokens} - 1) // {block_tokens})) // quota ELSE 0 END)::BIGINT AS block, draw, n AS n_tokens
FROM z WHERE start < quota OR (epoch = 0 AND (a = 0 OR n = 0))
"""
