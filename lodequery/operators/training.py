"""Training encoders where the rows are.

A step has a block of queries, a bounded number of rows, and meets them with all documents of a
stripe of the table, partition by partition.  Weights and queries are broadcast; a first job adds
up the sums that the loss is a function of, a second one, which is told those, the gradients.  Tasks
send sums only, merged by a grouped shuffle over their positions, so neither the documents nor the
pairs are ever in one place, and what comes back is as long as the parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.datasets import hashed
from .learned import Adam, Encoder, loss_of, pair_gradient, pair_sums, query_pull

#: Numbers of a block of pairs held at once: queries * documents * bits.
BLOCK = 1 << 19


class Block:
    """A step's queries: features and labels (by number)."""

    def __init__(self, x: np.ndarray, labels: list):
        self.x, self.numbers = x, {}
        self.labels = np.asarray([self.numbers.setdefault(v, len(self.numbers)) for v in labels], np.int64)

    def matches(self, labels: list) -> np.ndarray:
        own = np.asarray([self.numbers.get(v, -1) if v is not None else -1 for v in labels], np.int64)
        return (self.labels[:, None] == own[None]).astype(float)


def query_block(rows: DataFrame, step: int, n_rows: int, batch: int, seed: int) -> Block:
    """The queries of a step: at most ``batch`` rows (a parameter), the first of the step's stretch of hashes."""
    stretches = max(1, -(-n_rows // batch))
    place = F.pmod(hashed(F.col("id"), F.lit(seed)), F.lit(stretches))
    got = rows.where(F.col("label").isNotNull() & (place == step % stretches)).orderBy(hashed(F.col("id"), F.lit(seed)), "id", "x").limit(batch).collect()
    return Block(np.asarray([r.x for r in got], float), [r.label for r in got])


def add_up(rows: DataFrame, work: Callable[[np.ndarray, list], np.ndarray], length: int) -> np.ndarray:
    """The sum over all rows(x, label) of what work gives for a batch of them, an array of ``length`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                flat = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
                total += work(flat.reshape(b.num_rows, -1), b.column("label").to_pylist())
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(length), pa.int32()), "value": pa.array(total)})

    got = rows.select("x", "label").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(length)
    out[got.column("place").to_numpy()] = got.column("value").to_numpy()
    return out


def loss_and_gradients(docs: DataFrame, block: Block, params: list[np.ndarray], kind: str, o: dict) -> tuple[float, list[np.ndarray]]:
    """A loss over all pairs of the block's queries and docs(x, label), and its gradients by the weights and biases of both encoders.

    params are the queries' weights and bias and the documents'; a null label matches nothing.
    """
    wq, bq, wd, bd = params
    nbits, dim = wd.shape
    zq = block.x @ wq.T + bq
    sent = docs.sparkSession.sparkContext.broadcast((block, zq, wd, bd))
    size = max(1, BLOCK // max(1, len(zq) * (nbits + 1)))
    n_sums = {"hashnet": 2, "mihash": 2 * (nbits + 1), "hbkl": 4, "fbeta": 7}[kind]

    def pieces(x: np.ndarray, labels: list):
        own, zq, wd, bd = sent.value
        zd = x @ wd.T + bd
        for at in range(0, len(x), size):
            yield own, zq, x[at : at + size], zd[at : at + size], own.matches(labels[at : at + size])

    def sums(x: np.ndarray, labels: list) -> np.ndarray:
        return sum(pair_sums(kind, zq, zd, r, o) for _, zq, _, zd, r in pieces(x, labels))

    loss, known = loss_of(kind, add_up(docs, sums, n_sums), zq, o)

    def slopes(x: np.ndarray, labels: list) -> np.ndarray:
        out = [np.zeros((nbits, dim)), np.zeros(nbits), np.zeros((nbits, dim)), np.zeros(nbits)]
        for own, zq, part, zd, r in pieces(x, labels):
            gq, gd = pair_gradient(kind, zq, zd, r, o, known)
            for total, g in zip(out, (gq.T @ own.x, gq.sum(0), gd.T @ part, gd.sum(0))):
                total += g
        return np.concatenate([g.reshape(-1) for g in out])

    flat = add_up(docs, slopes, 2 * nbits * (dim + 1))
    sent.unpersist()
    ends = np.cumsum([nbits * dim, nbits, nbits * dim])
    grads = [g.reshape(p.shape) for g, p in zip(np.split(flat, ends), (wq, bq, wd, bd))]
    pull = query_pull(zq, known)
    return loss, [grads[0] + pull.T @ block.x, grads[1] + pull.sum(0), grads[2], grads[3]]


def first_parameters(nbits: int, dim: int, shared: bool, seed: int, start: tuple[Encoder, Encoder] | None) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    if start is not None:
        given = [[np.asarray(e.w), np.asarray(e.b)] for e in start]
        return given[0] + given[0 if shared else 1]
    new = lambda: [rng.normal(size=(nbits, dim)) / np.sqrt(dim), rng.normal(size=nbits) * 0.01]
    q = new()
    return q + (q if shared else new())


def train_on_cluster(features: DataFrame, kind: str, nbits: int, *, steps: int = 20, rate: float = 1e-2, seed: int = 7, batch: int = 256, stripes: int = 1, shared: bool = True, beta_ramp: tuple[float, float, float, float] = (0, 1024, -64, -8), start: tuple[Encoder, Encoder] | None = None, freeze: str | None = None, **options) -> tuple[Encoder, Encoder, list[float]]:
    """Encoders fitted to features(id, x, label), pairs matching on equal labels; and the loss of every step.

    A step's queries are at most ``batch`` rows, another stretch of the hashed ids each step; its documents are all rows
    of one of ``stripes`` parts, in turn, so after as many steps every row has been one.  A query meets itself too.  The other
    arguments are those of learned.train.  Null labels match nothing, and rows that have one aren't queries; rows without features
    aren't used; a table without labelled rows is a ValueError.
    """
    if freeze not in (None, "query", "doc") or freeze and (shared or start is None):
        raise ValueError("freeze is 'query' or 'doc', of two encoders to start from")
    rows = features.select("id", F.col("x").cast("array<double>").alias("x"), "label").where("x is not null")
    n = rows.where("label is not null").count()
    if not n:
        raise ValueError("no labelled rows to train on")
    params, still = None, {"query": (0, 1), "doc": (2, 3)}.get(freeze, ())
    adam, losses = Adam(rate), []
    for t in range(steps):
        block = query_block(rows, t, n, batch, seed)
        if params is None:
            params = first_parameters(nbits, len(rows.first().x), shared, seed, start)
        if not len(block.x):  # a stretch of hashes that no id has
            continue
        o = dict(options)
        if kind == "fbeta":
            x0, x1, y0, y1 = beta_ramp
            o.setdefault("log2_beta", y0 if t <= x0 else y1 if t >= x1 else y0 + (t - x0) * (y1 - y0) / (x1 - x0))
        docs = rows.where(F.pmod(hashed(F.col("id"), F.lit(seed + 1)), F.lit(stripes)) == t % stripes) if stripes > 1 else rows
        loss, grads = loss_and_gradients(docs, block, params, kind, o)
        losses.append(loss)
        if shared:
            one = adam.step(params[:2], [grads[0] + grads[2], grads[1] + grads[3]])
            params = one + one
        else:
            params = [old if k in still else new for k, (old, new) in enumerate(zip(params, adam.step(params, grads)))]
    q = Encoder(params[0].tolist(), params[1].tolist())
    return q, q if shared else Encoder(params[2].tolist(), params[3].tolist()), losses
