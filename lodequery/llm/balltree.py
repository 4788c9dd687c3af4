"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are cut into shards, each with a ball tree in a file of the shared
folder; queries are written in blocks.  Before the cut each partition is sorted by
the nearest of a few pivots, so shards hold neighbours and their balls are narrow;
that takes no shuffle, and a cluster of any size is spread as its rows were.  A
task maps a shard and takes the blocks one after the other, so neither side is
gathered anywhere.  For a query q, no vector of a ball with centre c and radius r
scores more than q.c + |q| r; nodes whose bound is under the query's current k-th
score are dropped, level by level, and the leaves left are visited from the highest
bound down while the k-th score rises.

The k-th scores are shared.  A first pass over about ``seeds`` shards looks into each
query's most promising leaf only.  Then shards are searched in waves, about ``seeds``
first and each wave GROWTH times all before it; every wave starts from the k-th best
scores found so far.  These are lower bounds of the true ones, so nothing is lost,
only candidates that reach them leave a shard, and a query's candidates number about
k * GROWTH in each wave, whatever the number of shards.

Components are floor(scale * x) and scores whole numbers; bounds are in floating
point with a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: How many times the shards searched so far the next wave takes.
GROWTH = 8
#: Vectors of the smallest hashes of their ids that neighbours are told by.
PIVOTS = 64
LOWEST = np.iinfo(np.int64).min + 1  # its negative is a number too


def build_tree(x: np.ndarray, ids: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """Rows reordered so that every node is a range; nodes in breadth-first order."""
    order = np.arange(len(x))
    nodes, k = [(0, len(x), -1)], 0
    children = []
    while k < len(nodes):
        a, b, _ = nodes[k]
        if b - a <= leaf:
            children.append(-1)
        else:
            own = x[order[a:b]]
            far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - far), half)]
            children.append(len(nodes))
            nodes += [(a, a + half, k), (a + half, b, k)]
        k += 1
    for (a, b, _), c in zip(nodes, children):
        if c < 0:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
    y = x[order]
    centre = np.stack([y[a:b].mean(axis=0) for a, b, _ in nodes]) if len(x) else np.zeros((0, x.shape[1]))
    radius = np.asarray([np.sqrt(((y[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _), c in zip(nodes, centre)])
    return {"x": y, "ids": ids[order], "begin": np.asarray([n[0] for n in nodes]), "end": np.asarray([n[1] for n in nodes]), "child": np.asarray(children), "centre": centre, "radius": radius}


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products, exact; those that 63 bits can't hold are refused with an OverflowError."""
    most = (np.abs(q).max(initial=0) + 1) * (np.abs(x).max(initial=0) + 1) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    if exact.size and not LOWEST < exact.min() <= exact.max() <= np.iinfo(np.int64).max:
        raise OverflowError("an inner product beyond 63 bits; choose a smaller scale")
    return exact.astype(np.int64)


class _Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), LOWEST, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        s = np.concatenate([self.scores[rows], np.take_along_axis(scores, top, 1)], axis=1)
        i = np.concatenate([self.ids[rows], ids[top]], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search_tree(tree: dict[str, np.ndarray], q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int, first_leaf_only: bool = False) -> _Best:
    """The k best of the tree for each query that score at least floor."""
    best = _Best(len(q), k)
    if not len(tree["ids"]) or not len(q):
        return best
    norm = np.sqrt((q * q).sum(axis=1))
    margin = 1e-9

    def bound(rows, nodes):
        c, r = tree["centre"][nodes], tree["radius"][nodes]
        middle = np.einsum("ij,ij->i", q[rows], c)
        reach = norm[rows] * r
        return middle + reach + margin * (np.abs(middle) + reach + norm[rows] * np.sqrt((c * c).sum(axis=1))) + 1e-6

    rows, nodes = np.arange(len(q)), np.zeros(len(q), np.int64)
    leaves: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        up = bound(rows, nodes)
        keep = up >= floor[rows]
        rows, nodes, up = rows[keep], nodes[keep], up[keep]
        is_leaf = tree["child"][nodes] < 0
        leaves.append((rows[is_leaf], nodes[is_leaf], up[is_leaf]))
        rows, nodes = rows[~is_leaf], nodes[~is_leaf]
        if first_leaf_only and len(rows):
            left, right = tree["child"][nodes], tree["child"][nodes] + 1
            nodes = np.where(bound(rows, left) >= bound(rows, right), left, right)
        else:
            rows, nodes = np.repeat(rows, 2), (tree["child"][nodes][:, None] + [0, 1]).reshape(-1)
    rows, nodes, up = (np.concatenate(z) for z in zip(*leaves))
    order = np.lexsort((-up, rows))
    rows, nodes, up = rows[order], nodes[order], up[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
    step, at = 1, 0
    while len(rows):
        now = turn < at + step
        keep = now & (up >= np.maximum(floor, best.scores[:, -1])[rows])
        visit = np.argsort(nodes[keep], kind="stable")
        r, n = rows[keep][visit], nodes[keep][visit]
        for node in np.unique(n):
            own = r[np.searchsorted(n, node) : np.searchsorted(n, node, "right")]
            a, b = tree["begin"][node], tree["end"][node]
            s = _scores(q[own], tree["x"][a:b])
            ids = tree["ids"][a:b]
            s[q_ids[own][:, None] == ids[None]] = LOWEST
            best.add(own, s, ids)
        rows, nodes, up, turn = rows[~now], nodes[~now], up[~now], turn[~now]
        alive = up >= np.maximum(floor, best.scores[:, -1])[rows]
        rows, nodes, up, turn = rows[alive], nodes[alive], up[alive], turn[alive]
        at, step = at + step, step * 2
    return best


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return store.whole_ids(df, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite)


def _by_pivot(df: DataFrame) -> DataFrame:
    """Usable rows, each partition sorted by the nearest of at most PIVOTS vectors of its dimension; an order only, no row is lost."""
    chosen: dict[int, list] = {}
    for r in df.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect():
        chosen.setdefault(len(r.v), []).append(r.v)
    pivots = {dim: np.asarray(v, float).reshape(len(v), dim) for dim, v in chosen.items()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size, at = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            flat, out = lists.flatten().to_numpy(zero_copy_only=False), np.full(len(b), -1, np.int32)
            for dim in np.intersect1d(size, list(pivots)).tolist():
                own, p = np.flatnonzero(size == dim), pivots[dim]
                x = flat[at[own][:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):  # huge components: any pivot will do
                    out[own] = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(out)], ["id", "v", "near"])

    return df.mapInArrow(near, "id long, v array<double>, near int").sortWithinPartitions("near", "id")


def _packs(df: DataFrame, folder: str, name: str, most: int, scale: float, leaf: int | None) -> DataFrame:
    """Write the vectors in files of at most ``most``, by dimension; (path, dim) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0
        task = TaskContext.get().partitionId()

        def put(dim):
            nonlocal made
            ids, x = (np.concatenate(z) for z in zip(*held.pop(dim)))
            x = np.floor(scale * x)
            path = f"{folder}/{name}/{task}-{made}.pack"
            made += 1
            store.put_pack(path, **(build_tree(x, ids, leaf) if leaf else {"x": x, "ids": ids}))
            return pa.RecordBatch.from_pydict({"path": [path], "dim": pa.array([dim], pa.int64())})

        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                for k in range(0, len(own), most):
                    part = own[k : k + most]
                    held.setdefault(dim, []).append((ids[part], flat[at[part][:, None] + np.arange(dim)].reshape(len(part), dim)))
                    if sum(len(h[0]) for h in held[dim]) >= most:
                        yield put(dim)
        for dim in list(held):
            yield put(dim)

    listed = df.mapInArrow(write, "path string, dim long")
    listed.write.parquet(f"{folder}/{name}-list")
    return df.sparkSession.read.schema(listed.schema).parquet(f"{folder}/{name}-list")


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = 1 << 13, leaf: int = 256, block: int = 1 << 10, seeds: int = 32) -> DataFrame:
    """Per query row: query_id, rank (from 1), the id and the score of its k best vectors; fewer if there are fewer.

    Rows with a null id, a null vector, or a null or non-finite component take no part.  Only vectors of
    the query's dimension are candidates, and rows with the query's own id are not.  Ties go to the
    smaller id; repeated vector rows are candidates each, repeated query rows are answered each.  Extra
    columns don't matter; with an empty table the result is empty.  Ids must be whole numbers; an inner
    product beyond 63 bits is an error.
    """
    spark = vectors.sparkSession
    folder = store.new_folder(spark, "balltree")
    shards = _packs(_by_pivot(_usable(vectors, id_col, vec_col)), folder, "shards", shard, scale, leaf)
    blocks = _packs(_usable(queries, id_col, vec_col), folder, "queries", block, scale, None)
    block_list = [(r.path, r.dim) for r in blocks.orderBy("path").collect()]  # a path for each block of queries
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def look(batches: Iterator[pa.RecordBatch], floors: dict[int, str], first: bool = False) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, dim in zip(b.column("path").to_pylist(), b.column("dim").to_pylist()):
                tree = store.mapped_pack(path)
                for n, (block_path, block_dim) in enumerate(block_list):
                    if block_dim != dim:
                        continue
                    q = store.mapped_pack(block_path)
                    floor = store.mapped_pack(floors[n])["floor"] if n in floors else np.full(len(q["ids"]), LOWEST, np.int64)
                    best = search_tree(tree, q["x"], q["ids"], floor, k, first)
                    row, col = np.nonzero((best.scores > LOWEST) & (best.scores >= floor[:, None]))
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array(np.full(len(row), n), pa.int64()), "row": pa.array(row, pa.int64()), "query_id": pa.array(q["ids"][row], pa.int64()),
                        "id": pa.array(best.ids[row, col], pa.int64()), "score": pa.array(best.scores[row, col], pa.int64()),
                    })

    schema = "block long, row long, query_id long, id long, score long"
    best_first = Window.partitionBy("block", "row").orderBy(F.desc("score"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)

    def shared(found: DataFrame, name: str) -> dict[int, str]:
        """Write the k-th scores of found for each block that has any; the files by block."""

        def put(key, t):
            n = key[0].as_py()
            floor = np.full(len(store.mapped_pack(block_list[n][0])["ids"]), LOWEST, np.int64)
            floor[t.column("row").to_numpy()] = t.column("score").to_numpy()
            store.put_pack(f"{folder}/floors/{name}-{n}.pack", floor=floor)
            return pa.table({"block": pa.array([n], pa.int64())})

        kth = ranked(found).where(F.col("rank") == k)
        return {r.block: f"{folder}/floors/{name}-{r.block}.pack" for r in kth.groupBy("block").applyInArrow(put, "block long").collect()}  # at most a row for each block

    n_shards = shards.count()
    ends = [seeds]
    while ends[-1] < n_shards:
        ends.append(ends[-1] * (1 + GROWTH))
    place = F.pmod(F.xxhash64("path"), F.lit(1 << 40))
    wave = sum(((place >= int(end / n_shards * (1 << 40))).cast("int") for end in ends[:-1]), F.lit(0))
    of_wave = lambda w: shards.where(wave == w).repartition(min(tasks, ends[w]))

    floors = shared(of_wave(0).mapInArrow(lambda it: look(it, {}, True), schema), "first")
    done: list[str] = []
    for w in range(len(ends)):
        found = of_wave(w).mapInArrow(lambda it, floors=floors: look(it, floors), schema)
        if done:
            found = found.unionByName(spark.read.schema(schema).parquet(done[-1]))
        if w < len(ends) - 1:
            done.append(f"{folder}/found-{w}")
            ranked(found).drop("rank").write.parquet(done[-1])
            floors = shared(spark.read.schema(schema).parquet(done[-1]), str(w))
    return ranked(found).select("query_id", "rank", F.col("id").alias(id_col), "score")
