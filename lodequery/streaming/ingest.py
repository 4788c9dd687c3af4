"""Keeping an index current from a stream, and probing it with one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.search import SearchStructure


def ingest(docs: DataFrame, structure: SearchStructure, path: str, checkpoint: str, available_now: bool = True):
    """Append the keys of a stream of documents to the index table at path; returns the running query.

    A micro-batch goes to a folder of its own number, so one that is repeated after a failure replaces
    itself.  Read the index with read_index().
    """

    def put(batch: DataFrame, number: int) -> None:
        structure.keys(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_index(spark, path: str) -> DataFrame:
    """The rows of every micro-batch, each once."""
    return spark.read.parquet(path).select("table_no", "code", "doc").distinct()


def probe(queries: DataFrame, structure: SearchStructure, limit: int | None = None) -> DataFrame:
    """(q, step, doc) hits of a stream of queries in a static index; stateless, so a document may come at several steps."""
    return structure.probes(queries, limit).join(structure.index, ["table_no", "code"]).select("q", "step", "doc")


def first_hits(requests: DataFrame, structure: SearchStructure, limit: int | None = None, shards: int = 16, growing: bool = False) -> DataFrame:
    """(q, step, doc) of a stream of requests: each document of a query at the first step that gives it, whatever batch that is in.

    requests are queries with two columns more, first and after: the steps that are wanted now, from first up to but without
    after.  A reader goes on with a query by asking for its next steps; steps asked for again give nothing.  State survives a
    restart.  With few probes a query (``structure.few()``) it is the keys that the query has looked up, whatever the number of
    documents: one that holds any of them has been given.  That needs an index that stays as it is.  With many probes, or an
    index that is ``growing`` between batches, what has been given is kept, an array for each query and each of ``shards`` parts
    of the ids.
    """
    wanted = requests.withColumn("q", F.struct("q", "first", "after"))
    probes = structure.probes(wanted, limit).where((F.col("step") >= F.col("q.first")) & (F.col("step") < F.col("q.after")))
    probes = probes.select(F.col("q.q").cast("long").alias("q"), "step", "table_no", "code")
    return _by_documents(probes, structure, shards) if growing or not structure.few(limit) else _by_keys(probes, structure)


def _by_keys(probes: DataFrame, structure: SearchStructure) -> DataFrame:
    """first_hits() with the keys that each query has looked up as state."""

    def new_keys(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tables, codes = map(list, state.get) if state.exists else ([], [])
        seen, steps = set(zip(tables, codes)), [None] * len(codes)
        for q, step, table_no, code in sorted(row for rows in frames for row in zip(*(rows[c].tolist() for c in ("q", "step", "table_no", "code")))):
            if (table_no, code) not in seen:
                seen.add((table_no, code))
                steps.append(step)
                tables.append(table_no)
                codes.append(code)
        state.update((tables, codes))
        yield pd.DataFrame({"q": [q], "steps": [steps], "tables": [tables], "codes": [codes]})

    arrays = "tables array<int>, codes array<bigint>"
    asked = probes.groupBy("q").applyInPandasWithState(new_keys, f"q long, steps array<bigint>, {arrays}", arrays, "append", GroupStateTimeout.NoTimeout)
    keys = F.transform(F.arrays_zip("tables", "codes"), lambda x: structure.key(x["tables"], x["codes"]))
    each = asked.select("q", keys.alias("_keys"), F.posexplode(F.arrays_zip("steps", "tables", "codes")).alias("_at", "x")).where("x.steps is not null")  # no step: looked up in an earlier batch
    return structure.new_hits(each.select("q", F.col("x.steps").alias("step"), F.col("x.tables").alias("table_no"), F.col("x.codes").alias("code"), F.slice("_keys", F.lit(1), F.col("_at")).alias("earlier")))


def _by_documents(probes: DataFrame, structure: SearchStructure, shards: int) -> DataFrame:
    """first_hits() with the documents that each query has been given as state."""
    hits = probes.join(structure.index, ["table_no", "code"]).select("q", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard"), "step", "doc")

    def new_only(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(frames)).sort_values(["step", "doc"]).drop_duplicates("doc")
        rows = rows[~rows["doc"].isin(given)]
        state.update((sorted(given | set(rows["doc"].tolist())),))
        yield rows[["q", "step", "doc"]]

    return hits.groupBy("q", "shard").applyInPandasWithState(new_only, "q long, step long, doc long", "given array<bigint>", "append", GroupStateTimeout.NoTimeout)
