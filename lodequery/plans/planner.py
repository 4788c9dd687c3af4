"""Choices between equivalent plans, made from counts before a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows of fixed width.
SMALL = 200_000


def is_small(df: DataFrame, most: int = SMALL) -> bool:
    """Whether df has at most ``most`` rows; stops counting beyond."""
    return df.limit(most + 1).count() <= most


def all_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Every row of a stated query set with every row of docs, for operators defined over all pairs.

    The smaller side is broadcast if its size is checked to be small; otherwise the pairs are made block
    by block (a cartesian product of partitions), without gathering a side anywhere.
    """
    if is_small(queries):
        return docs.crossJoin(F.broadcast(queries))
    if is_small(docs):
        return queries.crossJoin(F.broadcast(docs))
    return queries.crossJoin(docs)


def ball_size(nbits: int, radius: int) -> int:
    """Codes within radius of one: the probes of a mask-exploding lookup."""
    return sum(comb(nbits, i) for i in range(radius + 1))


def radius_by_probing(nbits: int, radius: int, n_docs: int) -> bool:
    """Whether exploding the masks (then an equi-join) beats comparing every pair."""
    return ball_size(nbits, radius) < n_docs


#: Rows of either side of a block of pairs.
QUERY_ROWS, DOC_ROWS = 8192, 4096


def dealt(rows: DataFrame, name: str, n_rows: int, most: int) -> tuple[Column, int]:
    """A number of a part for each row by a hash of the column name, so that a part has about ``most`` of n_rows rows; and how many parts there are."""
    parts = max(1, -(-n_rows // most))
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int"), parts


def in_blocks(queries: DataFrame, docs: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, q_part: tuple[Column, int], d_part: tuple[Column, int]) -> DataFrame:
    """What work(queries, docs) gives for every block of all pairs: each part of the queries meets each part of the documents in a task's group.

    No pair is a row.  Rows are sent once for each part of the other side, which is the block-nested-loop join's price.
    Both tables given to work end in the columns _qp and _dp, the numbers of their parts.
    """
    (own_q, nq), (own_d, nd) = q_part, d_part
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys, tasks = ["_qp", "_dp"], min(nq * nd, 4000)
    q = queries.withColumn("_qp", own_q).withColumn("_dp", every(nd)).repartition(tasks, *keys)
    d = docs.withColumn("_qp", every(nq)).withColumn("_dp", own_d).select(*docs.columns, *keys).repartition(tasks, *keys)
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(work, schema)
