"""Hashed-text features of labelled documents, for the classifiers.

A document's features are the (even) 64-bit hashes of its distinct words, and of a few
coarse shape marks (share of capitals, of symbols, of words like the one before,
variety of words, in tenths).  A model keeps the hashes that the labels show to
matter, sorted, with a weight each, so hashes of different words don't meet.

A model may be fitted on a bounded sample of the labelled rows: the ``most`` rows
with the smallest hash of their id.  What is sampled is hashed on the executors;
the driver gets at most ``most`` rows of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .wordhash import ALNUM, BLANK, U64, cut_rows, mix, runs, split, text_bytes

_UPPER, _SYMBOL = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_SYMBOL[[*range(33, 44), 47, *range(58, 65), *range(91, 97), *range(123, 127)]] = 1  # ASCII punctuation but , - .
#: Bytes of text taken at once.
SLICE = 1 << 20


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x between neighbouring bounds, without an array as wide as x."""
    out = np.zeros(len(bounds) - 1, float if x.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(x, bounds[full], dtype=out.dtype)
    return out


def document_features(texts, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of every text, concatenated, and where each text's begin.

    Without shapes, words are runs of letters and digits; with them, whatever stands between blanks, marks
    and punctuation included, as quality shows in those, and a text's shape marks come after its words.
    """
    w = split(texts, BLANK if shapes else ALNUM)
    n = np.diff(w.bounds)
    h = w.hashes & ~U64(1)
    for a, b in zip(w.bounds.tolist(), w.bounds[1:].tolist()):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[w.bounds[:-1][n > 0]] = True
    own = _sums(first.view(np.uint8), w.bounds)
    h = h[first]
    if not shapes:
        return h, np.concatenate([[0], np.cumsum(own)])
    data, offs = text_bytes(texts)
    again = np.zeros(len(w.hashes), np.uint8)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again[w.bounds[:-1][n > 0]] = 0
    size, one = np.maximum(np.diff(offs), 1), np.maximum(n, 1)
    marks = (_sums(_UPPER[data], offs) / size, _sums(_SYMBOL[data], offs) / size, _sums(again, w.bounds) / one, np.where(n > 20, own / one, 1.0))
    begins = np.concatenate([[0], np.cumsum(own + len(marks))])
    out = np.empty(begins[-1], U64)
    out[np.arange(len(h)) + np.repeat(len(marks) * np.arange(len(n)), own)] = h
    for k, share in enumerate(marks):
        out[begins[1:] - len(marks) + k] = mix(U64(1 + k) * U64(1 << 8) + np.ceil(share * 10).astype(U64)) & ~U64(1)
    return out, begins


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str, text_col: str, most: int, train=None) -> DataFrame:
    """(text, y) of at most ``most`` labelled ids: those with the smallest hash, where train holds.

    The ids are drawn first, so texts of rows outside the sample don't move.  Of several rows of an id
    the smallest text counts, of several labels the highest.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        ids = ids.where(train)
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("double")).alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), "_id")  # most rows of two numbers
    return rows.groupBy("_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y")).select("text", "y")


def fetch(sample: DataFrame, hashing) -> tuple[list[np.ndarray], np.ndarray]:
    """hashing(texts) of the sample's rows as arrays, and the labels, in an order that doesn't depend on partitions."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cut_rows((b.select(["y", "text"]) for b in batches), SLICE):
            values, begins = hashing(t.column("text"))
            yield pa.RecordBatch.from_pydict({"y": pa.array(t.column("y").to_pylist(), pa.float64()), "h": pa.array([values[a:b].tobytes() for a, b in zip(begins, begins[1:])], pa.binary())})
        store.release_memory()

    got = sample.mapInArrow(put, "y double, h binary").toArrow()
    rows = sorted(zip(got["h"].to_pylist(), got["y"].to_pylist()))
    return [np.frombuffer(h, U64) for h, _ in rows], np.asarray([y for _, y in rows])


def telling(rows: list[np.ndarray], positive: np.ndarray, least: float, fewest: int, most: int) -> np.ndarray:
    """The sorted hashes whose presence the label depends on: in ``fewest`` documents at least, signed root of G at least ``least`` either way, and the ``most`` strongest of them."""
    if not rows or not len(positive):
        return np.zeros(0, U64)
    # Hashes are even, so a label fits beside each and one sort in place is all.
    h = np.concatenate(rows)
    h |= np.repeat(np.asarray(positive, bool).astype(U64), [len(r) for r in rows])
    h.sort()
    y = (h & U64(1)).astype(np.uint8)
    h &= ~U64(1)
    keys, starts = runs(h)
    if not len(keys):
        return keys
    n = np.diff(starts).astype(float)
    a = np.add.reduceat(y, starts[:-1], dtype=float)
    del h, y
    total, plus = len(positive), float(positive.sum())
    g = np.zeros(len(keys))
    for seen, margin in ((a, plus), (n - a, total - plus)):  # present and of either label, absent and of either label
        for cell, row in ((seen, n), (margin - seen, total - n)):
            expected = row * margin / total
            g += 2 * np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-300) / np.maximum(expected, 1e-300)), 0)
    keep = np.flatnonzero((np.sqrt(np.maximum(g, 0)) >= least) & (n >= fewest))
    keep = keep[np.argsort(-g[keep], kind="stable")[:most]]
    return np.sort(keys[keep])


class Sparse:
    """Which of the keys each row has, as a matrix of 0 and 1."""

    def __init__(self, rows: list[np.ndarray], keys: np.ndarray):
        found = []
        for r in rows:
            at = np.minimum(np.searchsorted(keys, r), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
            found.append(at[keys[at] == r].astype(np.int32) if len(keys) else at.astype(np.int32))
        self.col = np.concatenate(found) if found else np.zeros(0, np.int32)
        self.row_begins = np.cumsum([0, *map(len, found)])
        self.shape = len(found), len(keys)
        row = np.repeat(np.arange(len(found), dtype=np.int32), np.diff(self.row_begins))
        self.row = row[np.argsort(self.col, kind="stable")]
        self.col_begins = np.concatenate([[0], np.cumsum(np.bincount(self.col, minlength=len(keys)))])

    def dot(self, x: np.ndarray) -> np.ndarray:
        """The sum of x over each row's keys."""
        return _sums(x[self.col], self.row_begins)

    def back(self, d: np.ndarray) -> np.ndarray:
        """The sum of d over the rows that have each key."""
        return _sums(d[self.row], self.col_begins)


def linear(h: np.ndarray, begins: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's features."""
    if not len(keys):
        return np.zeros(len(begins) - 1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return _sums(np.where(keys[at] == h, weights[at], 0.0), begins)


def adam(gradient, x: np.ndarray, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Full-batch descent with a falling rate."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return x


def score_texts(docs: DataFrame, keep: list, names_types: str, text_col: str, score) -> DataFrame:
    """keep's columns and those that score(texts) gives, for every row, whole texts a few MB at a time."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    n = len(keep)
    names = [*rows.columns[:n], *(x.split()[0] for x in names_types.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(n)], names=["row", "text"])
            parts = [score(t.column("text")) for t in cut_rows(iter([whole]), SLICE)]
            if parts:
                got = [np.concatenate(p) for p in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *map(pa.array, got)], names=names)
        store.release_memory()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{kinds}, {names_types}")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
