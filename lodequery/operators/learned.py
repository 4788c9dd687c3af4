"""Learned codes: linear encoders, the losses they are trained with, and training.

Encoders are a weight matrix and a bias, fixed values in a plan; logits are array
columns.  The losses are DataFrame aggregations over pairs.  Every loss is a function of
sums over pairs, and so is its gradient once those are known; both are numpy kernels here.
``training.train_on_cluster`` adds them up over partitions; ``train`` is the same on one
batch after the other of a bounded sample, on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logspace as L
from ..functions.distributions import log_any, log_hamming_binomial, log_poisson_binomial
from ..plans.planner import DOC_ROWS, QUERY_ROWS, dealt, in_blocks
from .search import SearchStructure


@dataclass
class Encoder:
    """logits = W x + b; W has a row per bit."""

    w: list[list[float]]
    b: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.w = [[float(x) for x in r] for r in self.w]
        self.b = [float(x) for x in self.b] or [0.0] * len(self.w)
        if len(self.b) != len(self.w):
            raise ValueError("a bias per row of weights")

    def logits(self, x: Column) -> Column:
        rows = F.array(*[F.struct(F.array(*[F.lit(v) for v in r]).alias("w"), F.lit(b).alias("b")) for r, b in zip(self.w, self.b)])
        return F.transform(rows, lambda r: L.total(F.zip_with(r["w"], x, lambda a, c: a * c)) + r["b"])

    def to_json(self) -> str:
        return json.dumps({"w": self.w, "b": self.b})

    @staticmethod
    def from_json(s: str) -> Encoder:
        return Encoder(**json.loads(s))


class LearnedSearch:
    """Query and document encoders in front of a search structure that takes logits."""

    def __init__(self, query_encoder: Encoder, doc_encoder: Encoder, structure: SearchStructure):
        self.fq, self.fd, self.structure = query_encoder, doc_encoder, structure

    def insert(self, docs: DataFrame) -> LearnedSearch:
        """docs(doc, features)."""
        self.structure.insert(docs.select("doc", self.fd.logits(F.col("features")).alias("logits")))
        return self

    def _queries(self, queries: DataFrame) -> DataFrame:
        return queries.select("q", self.fq.logits(F.col("features")).alias("logits"))

    def search(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        return self.structure.search(self._queries(queries), limit)

    def candidates(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(q, step, doc): each document at the first probe that finds it."""
        return self.structure.candidates(self._queries(queries), limit)

    def deltas(self, queries: DataFrame, limit: int | None = None, yield_empty: bool = False) -> DataFrame:
        return self.structure.deltas(self._queries(queries), limit, yield_empty)

    def state(self) -> tuple[str, DataFrame]:
        """Both encoders as JSON, and the structure's index."""
        return json.dumps([self.fq.to_json(), self.fd.to_json()]), self.structure.state()

    @staticmethod
    def from_state(encoders: str, index: DataFrame, structure: SearchStructure) -> LearnedSearch:
        fq, fd = map(Encoder.from_json, json.loads(encoders))
        return LearnedSearch(fq, fd, structure.set_state(index))


# Losses of pairs(zq, zd, r): logits of both and whether they match.


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_match(zq: Column, zd: Column, nbits: int, nindex: int = 1, match_dist: int = 0) -> Column:
    """log P(the codes are within match_dist in at least one of nindex equal parts)."""
    if nbits % nindex:
        raise ValueError(f"{nbits} bits don't divide into {nindex} indexes")
    size = nbits // nindex
    differ, agree = L.bits_equal(zq, zd)

    def sides(p: Column) -> Column:
        near = L.logsumexp_array(F.slice(p, 1, match_dist + 1))
        far = L.logsumexp_array(F.slice(p, match_dist + 2, size - match_dist)) if match_dist < size else F.lit(L.NEG_INF)
        return F.struct(near.alias("near"), far.alias("far"))

    def parts(d: Column, a: Column) -> Column:
        cut = lambda x, i: F.slice(x, i * size + 1, F.lit(size))
        return F.array(*[L.let(log_poisson_binomial(cut(a, i), cut(d, i)), sides) for i in range(nindex)])

    both = L.let(F.struct(differ.alias("d"), agree.alias("a")), lambda x: parts(x["d"], x["a"]))
    return L.let(both, lambda ps: log_any(F.transform(ps, lambda p: p["far"]), F.transform(ps, lambda p: p["near"]))[1])


def fbeta_loss(pairs: DataFrame, nbits: int, log_p: float, log2_beta: float, nindex: int = 1, match_dist: int = 0, l2_ratio: float = 0.0) -> DataFrame:
    """(loss): minus the log F-beta bound, where matches have prior exp(log_p)."""
    p = pairs.select("r", log_match(F.col("zq"), F.col("zd"), nbits, nindex, match_dist).alias("lm"))
    rate = p.agg(F.avg(F.col("r").cast("double")).alias("rate"))
    p = p.crossJoin(F.broadcast(rate))  # one row
    log_q = np.log1p(-np.exp(log_p))
    x = F.col("lm") + F.when(F.col("r"), log_p - F.ln("rate")).otherwise(log_q - F.ln(1 - F.col("rate")))
    top = p.agg(F.max(x).alias("top"))
    sums = p.crossJoin(F.broadcast(top)).agg(F.avg(F.when(F.col("r"), F.col("lm"))).alias("rho"), (F.max("top") + F.ln(F.avg(F.exp(x - F.col("top"))))).alias("m"))
    log_b2 = 2 * log2_beta * float(np.log(2))
    gamma = float(np.log1p(np.exp(log_b2))) - log_b2 - _softplus(F.col("m") - (log_p + log_b2))
    return sums.select(L.loss_with_relative_l2(-(F.col("rho") + gamma), l2_ratio).alias("loss"))


def _log_binomial(n: int, p: float) -> list[float]:
    from math import lgamma, log

    return [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p) for k in range(n + 1)]


def hbkl_loss(pairs: DataFrame, nbits: int, p_pos: float, p_neg: float) -> DataFrame:
    """(loss): mean KL of the wanted distance distribution to the pairs' for matches, and from theirs for others."""
    wanted = lambda p: F.array(*[F.lit(x) for x in _log_binomial(nbits, p)])
    p = pairs.select("r", log_hamming_binomial(F.col("zq"), F.col("zd")).alias("h"))
    pos, neg = L.kl_divergence(wanted(p_pos), F.col("h")), L.kl_divergence(F.col("h"), wanted(p_neg))
    return p.agg((F.avg(F.when(F.col("r"), pos)) + F.avg(F.when(~F.col("r"), neg))).alias("loss"))


def triangular(x: Column, n: int, width: float = 1.0) -> Column:
    """Soft histogram of a distance over centres 0..n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda c: F.greatest(1 - F.abs(c - x) / width, F.lit(0.0)))


def mutual_information(hists: DataFrame, p: float) -> DataFrame:
    """(mi) between match and distance from hists(r, bin, weight): entropy of the mix less those of its parts."""
    w = hists.groupBy("bin").agg(F.sum(F.when(F.col("r"), F.col("weight")).otherwise(0.0)).alias("pos"), F.sum(F.when(~F.col("r"), F.col("weight")).otherwise(0.0)).alias("neg"))
    s = w.agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    w = w.crossJoin(F.broadcast(s)).select((F.col("pos") / F.col("sp")).alias("a"), (F.col("neg") / F.col("sn")).alias("b"))
    h = lambda x: F.sum(F.when(x > 0, -x * F.ln(x)).otherwise(0.0))
    mix = p * F.col("a") + (1 - p) * F.col("b")
    return w.agg((h(mix) - p * h(F.col("a")) - (1 - p) * h(F.col("b"))).alias("mi"))


def mihash_loss(pairs: DataFrame, nbits: int, p: float) -> DataFrame:
    """(loss): minus the mutual information of match and the soft Hamming distance of tanh codes."""
    v = lambda z: F.transform(z, F.tanh)
    dist = (nbits - L.total(F.zip_with(v(F.col("zq")), v(F.col("zd")), lambda a, b: a * b))) / 2
    low = F.floor("x")  # of triangular()'s weights only those of the two centres beside a distance aren't 0
    beside = F.array(*[F.struct(b.alias("bin"), w.alias("weight")) for b, w in ((low, 1 - (F.col("x") - low)), (low + 1, F.col("x") - low))])
    bins = pairs.select("r", F.least(F.greatest(dist, F.lit(0.0)), F.lit(float(nbits))).alias("x")).select("r", F.explode(beside).alias("b")).select("r", "b.*")
    return mutual_information(bins, p).select((-F.col("mi")).alias("loss"))


def hashnet_loss(pairs: DataFrame, p: float, alpha: float = 1.0, beta: float = 1.0, stage: float = 1.0) -> DataFrame:
    """(loss): weighted pairwise logistic loss of the similarity of tanh codes."""
    v = lambda z: F.transform(z, lambda x: F.tanh(x * stage * beta))
    sh = L.total(F.zip_with(v(F.col("zq")), v(F.col("zd")), lambda a, b: a * b))
    r = F.col("r").cast("double")
    return pairs.agg(F.avg((r / p + (1 - r) / (1 - p)) * (_softplus(alpha * sh) - r * alpha * sh)).alias("loss"))


# The same losses of all pairs of two tables, block by block: no pair is a row.

#: Numbers of a piece of a block: pairs times bits.
PIECE = 1 << 18


def _log_sides(zq: np.ndarray, zd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(differs) and log P(agrees) of each bit of each pair, (bits, queries, docs)."""
    a1, a0 = (-np.logaddexp(0, s * zq.T)[:, :, None] for s in (-1, 1))
    b1, b0 = (-np.logaddexp(0, s * zd.T)[:, None] for s in (-1, 1))
    return np.logaddexp(a1 + b0, a0 + b1), np.logaddexp(a1 + b1, a0 + b0)


def _log_counts(zq: np.ndarray, zd: np.ndarray, most: int) -> np.ndarray:
    """log P(k bits differ), k = 0..most, of each pair: (most + 1, queries, docs).

    In plain numbers where no product of them comes near the smallest double, else in logarithms.
    """
    n = zq.shape[1]
    if n * (np.abs(zq).max(initial=0) + np.abs(zd).max(initial=0)) > 600:
        differ, agree = _log_sides(zq, zd)
        add, times, zero, one = np.logaddexp, np.add, -np.inf, 0.0
    else:
        (a1, a0), (b1, b0) = ((sigmoid(z.T), sigmoid(-z.T)) for z in (zq, zd))
        differ, agree = (a1[:, :, None] * x[:, None] + a0[:, :, None] * y[:, None] for x, y in ((b0, b1), (b1, b0)))
        add, times, zero, one = np.add, np.multiply, 0.0, 1.0
    f = [np.full(differ.shape[1:], one)]
    for i in range(n):
        here = [times(x, agree[i]) for x in f]
        if len(f) <= most:
            here.append(np.full(differ.shape[1:], zero))
        for k in range(len(here) - 1):
            here[k + 1] = add(here[k + 1], times(f[k], differ[i]))
        f = here
    f += [np.full(differ.shape[1:], zero)] * (most + 1 - len(f))
    with np.errstate(divide="ignore"):
        return np.stack(f) if zero < 0 else np.log(np.stack(f))


def _sums_of(kind: str, zq: np.ndarray, zd: np.ndarray, r: np.ndarray, o: dict) -> np.ndarray:
    """What pairs add to the sums that a loss is a function of; r says which match."""
    n = zq.shape[1]
    if kind == "hashnet":
        sh = np.tanh(zq) @ np.tanh(zd).T
        return np.array([r.size, (np.where(r, 1 / o["p"], 1 / (1 - o["p"])) * (np.logaddexp(0, sh) - r * sh)).sum()])
    if kind == "mihash":
        x = np.clip((n - np.tanh(zq) @ np.tanh(zd).T) / 2, 0, n)
        low = np.floor(x)
        at, share = (low + (n + 2) * ~r).astype(np.int64).ravel(), (x - low).ravel()
        count, upper = (np.bincount(at, w, 2 * (n + 2)) for w in (None, share))
        upper[[n + 1, 2 * n + 3]] = 0  # nothing lies beyond the last centre
        return count - upper + np.roll(upper, 1)
    if kind == "hbkl":
        lp, wanted = _log_counts(zq, zd, n), [np.asarray(_log_binomial(n, o[k])) for k in ("p_pos", "p_neg")]
        pos = np.exp(wanted[0]) @ wanted[0] - np.tensordot(np.exp(wanted[0]), lp, 1)
        p = np.exp(lp)
        neg = np.where(p > 0, p * lp, 0).sum(0) - np.tensordot(wanted[1], p, 1)
        return np.array([r.sum(), r.size - r.sum(), pos[r].sum(), neg[~r].sum()])
    if kind == "fbeta":
        m, dist = o.get("nindex", 1), o.get("match_dist", 0)
        if n % m:
            raise ValueError(f"{n} bits don't divide into {m} indexes")
        size = n // m
        with np.errstate(divide="ignore"):
            far = [np.log1p(-np.minimum(np.exp(_log_counts(zq[:, k : k + size], zd[:, k : k + size], min(dist, size))).sum(0), 1)) for k in range(0, n, size)]
            match = -np.expm1(sum(far))
            return np.array([r.sum(), r.size, np.log(match[r]).sum(), match[r].sum(), match[~r].sum()])
    raise ValueError(f"unknown loss {kind!r}")


def _loss_from(kind: str, t: np.ndarray, n: int, o: dict) -> float | None:
    """The loss from the sums over all pairs; None where a mean is of nothing.  t ends in the number of pairs whose labels are known."""
    *t, known = t
    if kind == "hashnet":
        return t[1] / t[0] if t[0] else None
    if kind == "mihash":
        hists = np.maximum(np.reshape(t, (2, n + 2)), 0)
        if not hists.sum(1).all():
            return 0.0
        a, b = hists / hists.sum(1, keepdims=True)
        h = lambda f: -sum(x * np.log(x) for x in f if x > 0)
        return -(h(o["p"] * a + (1 - o["p"]) * b) - o["p"] * h(a) - (1 - o["p"]) * h(b))
    if kind == "hbkl":
        return t[2] / t[0] + t[3] / t[1] if t[0] and t[1] else None
    if not t[0]:
        return None
    log_b2, rate, p = 2 * o["log2_beta"] * np.log(2), t[0] / known, np.exp(o["log_p"])
    mean = (p / rate * t[3] + ((1 - p) / (1 - rate) * t[4] if rate < 1 else 0)) / t[1]
    gamma = np.log1p(np.exp(log_b2)) - log_b2 - np.logaddexp(0, np.log(mean) - (o["log_p"] + log_b2))
    return -(t[2] / t[0] + gamma) * (1 + o.get("l2_ratio", 0.0))


def loss_of_all(queries: DataFrame, docs: DataFrame, kind: str, nbits: int, q_rows: int = QUERY_ROWS, d_rows: int = DOC_ROWS, **o) -> DataFrame:
    """(loss) of kind hashnet, mihash, hbkl or fbeta, of every pair of queries(q, z, label) and docs(d, z, label) with q <> d, matching on equal labels.

    As the losses of pairs above, null labels included: such a pair is neither a match nor none, but for the second mean of
    fbeta, where it counts as none.  Rows whose logits are null or hold a null take no part.  Tasks hold a block of
    the two tables and send sums.
    """
    length = {"hashnet": 2, "mihash": 2 * (nbits + 2), "hbkl": 4, "fbeta": 5}[kind]
    full = F.col("z").isNotNull() & (F.size("z") == nbits) & ~F.exists("z", F.isnull)
    q, d = (df.select(c, "z", "label").where(full if kind == "fbeta" else full & F.col("label").isNotNull()) for df, c in ((queries, "q"), (docs, "d")))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(length + 1)
        if left.num_rows and right.num_rows:
            (iq, zq, lq), (ii, zd, ld) = (_block(t) for t in (left, right))
            marks = {v: k for k, v in enumerate(dict.fromkeys([*lq, *ld]))}
            lq, ld, none = np.array([marks[v] for v in lq]), np.array([marks[v] for v in ld]), marks.get(None, -1)
            match = lambda a, b: (a[:, None] == b[None]) & (a != none)[:, None]
            rows = max(1, min(len(zq), 256))
            step = max(1, PIECE // (rows * max(1, nbits if kind in ("hbkl", "fbeta") else 4)))
            for i in range(0, len(zq), rows):
                for k in range(0, len(zd), step):
                    total[:-1] += _sums_of(kind, zq[i : i + rows], zd[k : k + step], match(lq[i : i + rows], ld[k : k + step]), o)
            total[-1] = int((lq != none).sum()) * int((ld != none).sum())
            place: dict = {}
            for i, v in enumerate(iq):
                place.setdefault(v, []).append(i)
            for k, v in enumerate(ii):
                for i in place.get(v, ()):  # a row doesn't meet itself
                    total[:-1] -= _sums_of(kind, zq[i : i + 1], zd[k : k + 1], match(lq[i : i + 1], ld[k : k + 1]), o)
                    total[-1] -= lq[i] != none and ld[k] != none
        return pa.table({"place": pa.array(np.arange(length + 1), pa.int32()), "value": total})

    def ended(t: pa.Table) -> pa.Table:
        total = np.zeros(length + 1)
        total[t.column("place").to_numpy()] = t.column("value").to_numpy()
        return pa.table({"loss": pa.array([_loss_from(kind, total, nbits, o)], pa.float64())})

    sums = in_blocks(q, d, work, "place int, value double", dealt(q, "q", q.count(), q_rows), dealt(d, "d", d.count(), d_rows))
    nothing = queries.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(0.0).alias("value"))
    return sums.unionByName(nothing).groupBy("place").agg(F.sum("value").alias("value")).groupBy().applyInArrow(ended, "loss double")  # a row for each sum


def _block(t: pa.Table) -> tuple[list, np.ndarray, list]:
    z = t.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return t.column(0).to_pylist(), z.reshape(t.num_rows, -1), t.column("label").to_pylist()


class Adam:
    """Adam with gradients clipped to +-5, for a list of arrays."""

    def __init__(self, rate: float = 1e-3):
        self.rate, self.t, self.m, self.v = rate, 0, None, None

    def step(self, xs: list[np.ndarray], gs: list[np.ndarray]) -> list[np.ndarray]:
        gs = [np.clip(g, -5, 5) for g in gs]
        if self.m is None:
            self.m, self.v = [np.zeros_like(x) for x in xs], [np.zeros_like(x) for x in xs]
        self.t += 1
        self.m = [0.9 * m + 0.1 * g for m, g in zip(self.m, gs)]
        self.v = [0.999 * v + 0.001 * g * g for v, g in zip(self.v, gs)]
        return [x - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8) for x, m, v in zip(xs, self.m, self.v)]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _pmf(q: np.ndarray) -> np.ndarray:
    """pmf of the number of ones (.., n+1)."""
    f = np.ones((*q.shape[:-1], 1))
    for i in range(q.shape[-1]):
        p, g = q[..., i : i + 1], np.zeros((*f.shape[:-1], f.shape[-1] + 1))
        g[..., :-1] += f * (1 - p)
        g[..., 1:] += f * p
        f = g
    return f


def _pb(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pmf of the number of ones (.., n+1), and its derivative by each probability (.., n, n+1)."""
    n = q.shape[-1]
    before = [np.ones((*q.shape[:-1], 1))]
    for i in range(n):
        f, p = before[-1], q[..., i : i + 1]
        g = np.zeros((*f.shape[:-1], f.shape[-1] + 1))
        g[..., :-1] += f * (1 - p)
        g[..., 1:] += f * p
        before.append(g)
    after = [np.ones((*q.shape[:-1], 1))]
    for i in reversed(range(n)):
        f, p = after[-1], q[..., i : i + 1]
        g = np.zeros((*f.shape[:-1], f.shape[-1] + 1))
        g[..., :-1] += f * (1 - p)
        g[..., 1:] += f * p
        after.append(g)
    after = after[::-1]
    grad = np.zeros((*q.shape, n + 1))
    for i in range(n):
        a, b = before[i], after[i + 1]
        rest = np.zeros((*q.shape[:-1], n))
        for k in range(a.shape[-1]):
            rest[..., k : k + b.shape[-1]] += a[..., k : k + 1] * b
        grad[..., i, :-1] -= rest
        grad[..., i, 1:] += rest
    return before[-1], grad


TINY = 1e-300


def _differ(zq: np.ndarray, zd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(1) of each bit of both sides, and P(bit differs) of each pair."""
    pq, pd = sigmoid(zq), sigmoid(zd)
    return pq, pd, pq[:, None] * (1 - pd[None]) + (1 - pq[:, None]) * pd[None]


def _tanh_distance(zq: np.ndarray, zd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.tanh(zq), np.tanh(zd)
    return a, b, (zq.shape[1] - a @ b.T) / 2


def _triangles(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of distances in the bins 0..n, and their slopes."""
    c = np.arange(n + 1)
    t = np.maximum(1 - np.abs(c - x[..., None]), 0)
    return t, np.where(t > 0, np.sign(c - x[..., None]), 0)


def _near(q: np.ndarray, o: dict, grad: bool):
    """P(codes match in some index) of each pair, from P(bit differs); with grad its derivative too."""
    m, dist = o.get("nindex", 1), o.get("match_dist", 0)
    if q.shape[-1] % m:
        raise ValueError(f"{q.shape[-1]} bits don't divide into {m} indexes")
    parts = q.reshape(*q.shape[:2], m, q.shape[-1] // m)
    if not grad:
        return np.maximum(1 - np.prod(1 - _pmf(parts)[..., : dist + 1].sum(-1), -1), TINY)
    pmf, by = _pb(parts)
    near = pmf[..., : dist + 1].sum(-1)
    none = np.prod(1 - near, -1)
    d_match = (none[..., None] / np.maximum(1 - near, 1e-12))[..., None] * by[..., : dist + 1].sum(-1)
    return np.maximum(1 - none, TINY), d_match.reshape(q.shape)


def pair_sums(kind: str, zq: np.ndarray, zd: np.ndarray, r: np.ndarray, o: dict) -> np.ndarray:
    """What a block of pairs adds to the sums that the loss is a function of: sums of blocks are sums of all pairs.

    hashnet: pairs, weighted losses; mihash: both histograms; hbkl: matches, others, KL of both; fbeta: matches,
    others, log match of matches, match of both, and the documents' squared logits and their number.
    """
    n = zq.shape[1]
    if kind == "hashnet":
        sh, p, alpha = np.tanh(zq) @ np.tanh(zd).T, o["p"], o.get("alpha", 1.0)
        w = r / p + (1 - r) / (1 - p)
        return np.array([r.size, (w * (np.logaddexp(0, alpha * sh) - r * alpha * sh)).sum()])
    if kind == "mihash":
        t = _triangles(_tanh_distance(zq, zd)[2], n)[0]
        return np.concatenate([(t * r[..., None]).sum((0, 1)), (t * (1 - r)[..., None]).sum((0, 1))])
    q = _differ(zq, zd)[2]
    if kind == "hbkl":
        pmf = _pmf(q)
        lp = np.log(np.maximum(pmf, TINY))
        lw = [np.asarray(_log_binomial(n, o[k])) for k in ("p_pos", "p_neg")]
        return np.array([r.sum(), (1 - r).sum(), (r * (np.exp(lw[0]) * (lw[0] - lp)).sum(-1)).sum(), ((1 - r) * (pmf * (lp - lw[1])).sum(-1)).sum()])
    if kind == "fbeta":
        match = _near(q, o, False)
        return np.array([r.sum(), (1 - r).sum(), (np.log(match) * r).sum(), (match * r).sum(), (match * (1 - r)).sum(), (zd**2).sum(), zd.size])
    raise ValueError(f"unknown loss {kind!r}")


def loss_of(kind: str, totals: np.ndarray, zq: np.ndarray, o: dict) -> tuple[float, dict]:
    """The loss from the sums over all pairs, and what the gradient needs to know of them."""
    if kind == "hashnet":
        return float(totals[1] / totals[0]), {"size": totals[0]}
    if kind == "mihash":
        hp, hn = np.split(totals, 2)
        sp, sn, p = max(hp.sum(), TINY), max(hn.sum(), TINY), o["p"]
        fp, fn = hp / sp, hn / sn
        mix = p * fp + (1 - p) * fn
        h = lambda f: -np.sum(np.where(f > 0, f * np.log(np.maximum(f, TINY)), 0))
        lg = lambda f: np.log(np.maximum(f, 1e-12))
        dp, dn = p * (lg(mix) - lg(fp)), (1 - p) * (lg(mix) - lg(fn))
        return float(-(h(mix) - p * h(fp) - (1 - p) * h(fn))), {"dp": (dp - dp @ fp) / sp, "dn": (dn - dn @ fn) / sn}
    n_pos, n_neg = max(totals[0], 1), max(totals[1], 1)
    if kind == "hbkl":
        return float(totals[2] / n_pos + totals[3] / n_neg), {"pos": n_pos, "neg": n_neg}
    size, lp = totals[0] + totals[1], o["log_p"]
    rate = totals[0] / size
    weights = np.exp(lp) / max(rate, TINY), (1 - np.exp(lp)) / max(1 - rate, TINY)
    mean = (weights[0] * totals[3] + weights[1] * totals[4]) / size
    log_b2 = 2 * o["log2_beta"] * np.log(2)
    z = np.log(np.maximum(mean, TINY)) - (lp + log_b2)
    loss = -(totals[2] / n_pos + np.log1p(np.exp(log_b2)) - log_b2 - np.logaddexp(0, z))
    slope = sigmoid(z) / size / np.maximum(mean, TINY)
    more = {"pos": n_pos, "on_match": slope * weights[0], "on_other": slope * weights[1], "pull_q": 0.0, "pull_d": 0.0}
    if ratio := o.get("l2_ratio", 0.0):
        k = ratio * loss / max(((zq**2).mean() + totals[5] / totals[6]) / 2, TINY)
        more |= {"pull_q": k / zq.size, "pull_d": k / totals[6]}
        loss *= 1 + ratio
    return float(loss), more


def pair_gradient(kind: str, zq: np.ndarray, zd: np.ndarray, r: np.ndarray, o: dict, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """What a block of pairs adds to the gradients by the logits; the pull of the queries' own logits is left to query_pull()."""
    n = zq.shape[1]
    if kind == "hashnet":
        a, b = np.tanh(zq), np.tanh(zd)
        p, alpha = o["p"], o.get("alpha", 1.0)
        g = (r / p + (1 - r) / (1 - p)) * alpha * (sigmoid(alpha * (a @ b.T)) - r) / known["size"]
        return (g @ b) * (1 - a * a), (g.T @ a) * (1 - b * b)
    if kind == "mihash":
        a, b, x = _tanh_distance(zq, zd)
        g = (_triangles(x, n)[1] * np.where(r[..., None] > 0, known["dp"], known["dn"])).sum(-1) * -0.5
        return (g @ b) * (1 - a * a), (g.T @ a) * (1 - b * b)
    pq, pd, q = _differ(zq, zd)
    if kind == "hbkl":
        pmf, by = _pb(q)
        lw = [np.asarray(_log_binomial(n, o[k])) for k in ("p_pos", "p_neg")]
        lp = np.log(np.maximum(pmf, TINY))
        d = r[..., None] / known["pos"] * (-np.exp(lw[0]) / np.maximum(pmf, 1e-30)) + (1 - r)[..., None] / known["neg"] * (lp - lw[1] + 1)
        dq = np.einsum("abij,abj->abi", by, d)
    else:
        match, d_match = _near(q, o, True)
        d = -r / known["pos"] / match + np.where(r > 0, known["on_match"], known["on_other"])
        dq = d[..., None] * d_match
    gq, gd = (dq * (1 - 2 * pd[None])).sum(1) * pq * (1 - pq), (dq * (1 - 2 * pq[:, None])).sum(0) * pd * (1 - pd)
    return gq, gd + known.get("pull_d", 0.0) * zd


def query_pull(zq: np.ndarray, known: dict) -> np.ndarray:
    return known.get("pull_q", 0.0) * zq


def loss_and_gradient(kind: str, zq: np.ndarray, zd: np.ndarray, r: np.ndarray, **o) -> tuple[float, np.ndarray, np.ndarray]:
    """A loss on all pairs of a batch, and its gradients by the logits."""
    loss, known = loss_of(kind, pair_sums(kind, zq, zd, r, o), zq, o)
    gq, gd = pair_gradient(kind, zq, zd, r, o, known)
    return loss, gq + query_pull(zq, known), gd


def train(features: DataFrame, kind: str, nbits: int, steps: int = 200, rate: float = 1e-2, seed: int = 7, batch: int = 512, most: int = 50_000, shared: bool = True, beta_ramp: tuple[float, float, float, float] = (0, 1024, -64, -8), start: tuple[Encoder, Encoder] | None = None, freeze: str | None = None, **options) -> tuple[Encoder, Encoder, list[float]]:
    """Encoders fitted to features(id, x, label), pairs matching on equal labels; and the loss of every step.

    Every step has a batch of its own: the next ``batch`` rows in the order of a hash of the id, of at most ``most``
    rows that are read for all steps together (a bounded, documented sample); after the last of them it begins again.
    Without shared, queries and documents get an encoder each.  With ``start`` these encoders are trained on (the first,
    if shared), and ``freeze``, "query" or "doc", leaves one of two as it is: an index of frozen document codes stays valid.
    """
    if freeze not in (None, "query", "doc") or freeze and (shared or start is None):
        raise ValueError("freeze is 'query' or 'doc', of two encoders to start from")
    rows = features.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(most, steps * batch)).select("x", "label").collect()
    every = np.asarray([r.x for r in rows], float)
    labels = np.unique([r.label for r in rows], return_inverse=True)[1]
    rng = np.random.default_rng(seed)
    new = lambda: [rng.normal(size=(nbits, every.shape[1])) / np.sqrt(every.shape[1]), rng.normal(size=nbits) * 0.01]
    given = [[np.asarray(e.w), np.asarray(e.b)] for e in start or ()]
    params = (given[0] if shared else given[0] + given[1]) if given else new() if shared else new() + new()
    still = {"query": (0, 1), "doc": (2, 3)}.get(freeze, ())
    adam, losses = Adam(rate), []
    for t in range(steps):
        own = np.arange(t * batch, (t + 1) * batch) % len(every) if len(every) > batch else np.arange(len(every))
        x, label = every[own], labels[own]
        r = (label[:, None] == label[None]).astype(float)
        o = dict(options)
        if kind == "fbeta":
            x0, x1, y0, y1 = beta_ramp
            o.setdefault("log2_beta", y0 if t <= x0 else y1 if t >= x1 else y0 + (t - x0) * (y1 - y0) / (x1 - x0))
        zq = x @ params[0].T + params[1]
        zd = zq if shared else x @ params[2].T + params[3]
        loss, gq, gd = loss_and_gradient(kind, zq, zd, r, **o)
        losses.append(loss)
        grads = [(gq + gd).T @ x, (gq + gd).sum(0)] if shared else [gq.T @ x, gq.sum(0), gd.T @ x, gd.sum(0)]
        params = [old if k in still else stepped for k, (old, stepped) in enumerate(zip(params, adam.step(params, grads)))]
    q = Encoder(params[0].tolist(), params[1].tolist())
    return q, q if shared else Encoder(params[2].tolist(), params[3].tolist()), losses
