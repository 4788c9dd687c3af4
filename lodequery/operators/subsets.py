"""The cheapest subsets of any number of values, one after the other, best first.

With the values sorted, every subset but the empty one is a smaller one whose last value is moved on
by one place, or that value kept and the next one added; so each subset has one predecessor, which costs no more, and
a heap of successors gives all of them in order without looking at any twice.  A state is a
number, its cost without its last value, its last place and the state before: no mask, so no limit of 64 bits.
The states of a row are inherently one after the other; rows are spread over the tasks as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch that leaves a task.
ROWS = 4096


def cheapest_first(values: list[float], k: int | None = None) -> Iterator[tuple[float, list[int]]]:
    """(cost, places) of subsets of values by rising cost, ties by the sorted places' order of being reached; lazily.

    A negative or missing value is a ValueError.
    """
    v = np.asarray([np.nan if x is None else x for x in values], float)
    if not (v >= 0).all():
        raise ValueError("values must be given and not be negative")
    return islice(_states(v), k) if k is not None else _states(v)


def _states(v: np.ndarray) -> Iterator[tuple[float, list[int]]]:
    order = np.argsort(v, kind="stable")
    sorted_values, places = v[order].tolist(), order.tolist()
    yield 0.0, []
    chain: list[tuple[int, int]] = []  # last place and the state before it, by state
    heap = [(sorted_values[0], 0, 0.0, -1)] if sorted_values else []
    while heap:
        cost, last, base, before = heapq.heappop(heap)
        state = len(chain)
        chain.append((last, before))
        out, at = [], state
        while at >= 0:
            place, at = chain[at]
            out.append(places[place])
        yield cost, sorted(out)
        if last + 1 < len(sorted_values):
            heapq.heappush(heap, (base + sorted_values[last + 1], last + 1, base, before))
            heapq.heappush(heap, (cost + sorted_values[last + 1], last + 1, cost, state))


def cheapest_subsets(df: DataFrame, values: str, k: int | None) -> DataFrame:
    """df's other columns with (rank, cost, items): the k subsets of each row's values with the least sums, ascending.

    items are places in the array, from 0.  Fewer than k rows where there are fewer subsets; k None is all 2**n of them.
    A null array has no rows, an empty one has the empty subset; a negative or null value is an error.
    """
    keep = [c for c in df.columns if c != values]
    rows = df.select(*keep, df[values].cast("array<double>").alias(values)).where(df[values].isNotNull())
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, rank, cost, items = [], [], [], []
            for i, v in enumerate(b.column(n).to_pylist()):
                for r, (c, own) in enumerate(cheapest_first(v, k)):
                    row.append(i), rank.append(r), cost.append(c), items.append(own)
                    if len(row) == ROWS:
                        yield put(b, row, rank, cost, items)
                        row, rank, cost, items = [], [], [], []
            if row:
                yield put(b, row, rank, cost, items)

    def put(b, row, rank, cost, items):
        own = pa.array(row)
        columns = [c.take(own) for c in b.columns[:n]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(rank, pa.int32()), pa.array(cost, pa.float64()), pa.array(items, pa.list_(pa.int32()))], names=[*keep, "rank", "cost", "items"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{kinds}rank int, cost double, items array<int>")
