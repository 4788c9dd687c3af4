"""Seconds of each call, taken on the executors where the call is made.

``timed_calls`` runs any candidate iterator per query with a clock around each of its steps.  ``timed_lookups`` does so
for the look-ups of a search structure: index and probes are dealt by key into the same groups, a group's
buckets are put in a table, and each probe is timed on it.  Seconds come out as a column, to be the cost
of a work ratio or of oracle calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Index rows that a group holds at most, but for what hashing deals unevenly.
GROUP_ROWS = 200_000


def timed_calls(queries: DataFrame, candidates: Callable[..., Iterable[Iterable[int]]], most: int | None = None) -> DataFrame:
    """(q, step, docs, seconds): what candidates(*other columns) of each row of queries gives, step by step, and the time each step took.

    candidates runs on the executors and gives the new ids of one look-up after the other.  A last row with null
    docs has the time of the call that found the end; with ``most``, the iterator is left after so many steps and there is none.
    """
    columns = ["q", *(c for c in queries.columns if c != "q")]
    rows = queries.select(*columns)
    kind = rows.schema["q"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                step, held = 0, []
                it = iter(candidates(*values[1:]))
                while most is None or step < most:
                    began = time.perf_counter()
                    docs = next(it, None)
                    held.append((values[0], step, None if docs is None else sorted(docs), time.perf_counter() - began))
                    step += 1
                    if docs is None or len(held) == 1024:
                        yield put(b, held)
                        held = []
                    if docs is None:
                        break
                if held:
                    yield put(b, held)

    def put(b, held):
        q, step, docs, seconds = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(q, b.schema.field(0).type), pa.array(step, pa.int64()), pa.array(docs, pa.list_(pa.int64())), pa.array(seconds, pa.float64())], names=["q", "step", "docs", "seconds"])

    return rows.mapInArrow(run, f"q {kind}, step long, docs array<bigint>, seconds double")


def timed_lookups(probes: DataFrame, index: DataFrame, group_rows: int = GROUP_ROWS, ids: bool = True) -> DataFrame:
    """(q, step, docs, seconds) of every probe(q, step, table_no, code) in index(table_no, code, doc); docs may be empty.

    Without ``ids`` there is n_docs in place of docs: answers are made and timed all the same, but not kept, so a task's memory
    is that of its index rows and probes.

    Keys are dealt by hash into groups of about ``group_rows`` index rows; a key with more is split over several groups, whose
    probes are made in each, and its seconds added.
    """
    keys = ["table_no", "code"]
    sizes = index.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    hot = F.broadcast(sizes.where(F.col("_n") > group_rows).select(*keys, F.ceil(F.col("_n") / group_rows).cast("int").alias("_salts")))  # at most total / group_rows keys
    salts = F.coalesce("_salts", F.lit(1))
    group = F.pmod(F.xxhash64(*keys, "_salt"), F.lit(groups)).alias("_group")
    own = index.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("doc"), salts).cast("int")).select(group, "_salt", *keys, "doc")
    asked = probes.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(group, "_salt", "q", "step", *keys)
    kind = probes.schema["q"].dataType.simpleString()

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_salt", *keys]
        left = left.sort_by([(c, "ascending") for c in (*names, "doc")])
        parts, own = [left.column(c).to_numpy() for c in names], left.column("doc").to_numpy()
        new = np.ones(len(own), bool)
        if len(own):
            new[1:] = np.any([p[1:] != p[:-1] for p in parts], axis=0)
        starts = np.flatnonzero(new)
        buckets = {tuple(int(p[a]) for p in parts): own[a:b] for a, b in zip(starts, [*starts[1:], len(own)])}
        docs, seconds = [], []
        for key in zip(*(right.column(c).to_pylist() for c in names)):
            began = time.perf_counter()
            found = buckets.get(key)
            found = found.tolist() if found is not None else []
            seconds.append(time.perf_counter() - began)
            docs.append(found if ids else len(found))
        return pa.table({"q": right.column("q"), "step": right.column("step"), given: pa.array(docs, pa.list_(pa.int64()) if ids else pa.int64()), "seconds": pa.array(seconds, pa.float64())})

    given, of = ("docs", "array<bigint>") if ids else ("n_docs", "long")
    found = own.groupBy("_group").cogroup(asked.groupBy("_group")).applyInArrow(look, f"q {kind}, step long, {given} {of}, seconds double")
    if not ids:
        return found.groupBy("q", "step").agg(F.sum("n_docs").alias("n_docs"), F.sum("seconds").alias("seconds"))
    return found.groupBy("q", "step").agg(F.array_sort(F.flatten(F.collect_list("docs"))).alias("docs"), F.sum("seconds").alias("seconds"))  # a probe's answer


def timed_candidates(calls: DataFrame) -> DataFrame:
    """(q, step, doc, seconds) of calls(q, step, docs, seconds): each document at its first step.

    A step that gives nothing new isn't seen by whoever asks for the next new documents, so its seconds are those of the next
    step that does.
    """
    spent = F.sum("seconds").over(Window.partitionBy("q").orderBy("step"))
    timed = calls.withColumn("_spent", spent)
    first = timed.select("q", "step", "_spent", F.explode("docs").alias("doc")).groupBy("q", "doc").agg(F.min(F.struct("step", "_spent")).alias("at")).select("q", "doc", "at.*")
    steps = first.groupBy("q", "step").agg(F.max("_spent").alias("_spent"))
    steps = steps.withColumn("seconds", F.col("_spent") - F.coalesce(F.lag("_spent").over(Window.partitionBy("q").orderBy("step")), F.lit(0.0)))
    return first.join(steps.select("q", "step", "seconds"), ["q", "step"]).select("q", "step", "doc", "seconds")


def timed_steps(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """steps(q, step, ..) that give something new with the seconds of timed_candidates(), from calls(q, step, seconds)."""
    order = Window.partitionBy("q").orderBy("step")
    spent = calls.select("q", "step", F.sum("seconds").over(order).alias("_spent"))
    return steps.join(spent, ["q", "step"]).withColumn("seconds", F.col("_spent") - F.coalesce(F.lag("_spent").over(order), F.lit(0.0))).drop("_spent")
