"""Exact nearest-neighbour and range search on a grid, with cells pruned by their distance bounds."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from math import dist, prod, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..plans.planner import all_pairs


class Grid:
    """A box of bounds (low and high per axis) cut into divisions per axis; points are array<double> columns."""

    def __init__(self, low: list[float], high: list[float], divisions: list[int]):
        if not len(low) == len(high) == len(divisions) or any(a >= b for a, b in zip(low, high)) or any(n < 1 for n in divisions):
            raise ValueError("bounds and divisions don't make a grid")
        self.low, self.high, self.divisions, self.d = [float(x) for x in low], [float(x) for x in high], list(divisions), len(low)
        self.n_cells = prod(self.divisions)

    def scaled(self, p: Column) -> Column:
        """Points in units of cells."""
        return F.array(*[n * (F.get(p, F.lit(i)) - a) / (b - a) for i, (a, b, n) in enumerate(zip(self.low, self.high, self.divisions))])

    def cell(self, p: Column) -> Column:
        """The cell of each axis."""
        return F.transform(self.scaled(p), lambda x: F.floor(x).cast("int"))

    def place_in_cell(self, p: Column) -> Column:
        """Where in its cell a point lies, 0 to 1 on each axis."""
        return F.transform(self.scaled(p), lambda x: x - F.floor(x))

    def cell_number(self, cell: Column) -> Column:
        """One BIGINT per cell."""
        n = F.lit(0).cast("long")
        for i, k in enumerate(self.divisions):
            n = n * k + F.get(cell, F.lit(i))
        return n

    def cell_in_bounds(self, cell: Column) -> Column:
        return reduce(lambda a, b: a & b, [(F.get(cell, F.lit(i)) >= 0) & (F.get(cell, F.lit(i)) < n) for i, n in enumerate(self.divisions)])

    def in_bounds(self, p: Column) -> Column:
        """Half open: low <= p < high on every axis."""
        return (F.size(p) == self.d) & reduce(lambda a, b: a & b, [(F.get(p, F.lit(i)) >= a) & (F.get(p, F.lit(i)) < b) for i, (a, b) in enumerate(zip(self.low, self.high))])

    def _edges(self, cell: Column) -> list[tuple[Column, Column]]:
        width = [(b - a) / n for a, b, n in zip(self.low, self.high, self.divisions)]
        return [(self.low[i] + F.get(cell, F.lit(i)) * w, self.low[i] + (F.get(cell, F.lit(i)) + 1) * w) for i, w in enumerate(width)]

    def least_distance(self, p: Column, cell: Column) -> Column:
        """From a point to the nearest place of a cell; 0 inside."""
        gaps = [F.greatest(a - F.get(p, F.lit(i)), F.lit(0.0), F.get(p, F.lit(i)) - b) for i, (a, b) in enumerate(self._edges(cell))]
        return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))

    def most_distance(self, p: Column, cell: Column) -> Column:
        """From a point to the farthest place of a cell."""
        gaps = [F.greatest(F.abs(F.get(p, F.lit(i)) - a), F.abs(F.get(p, F.lit(i)) - b)) for i, (a, b) in enumerate(self._edges(cell))]
        return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))

    def distance(self, p: Column, q: Column) -> Column:
        gaps = [F.get(p, F.lit(i)) - F.get(q, F.lit(i)) for i in range(self.d)]
        return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))

    def all_cells(self, spark) -> DataFrame:
        """Every cell of the grid, made where it is used."""
        steps = [prod(self.divisions[i + 1 :]) for i in range(self.d)]
        place = [F.pmod(F.expr(f"id div {k}"), F.lit(n)).cast("int") for k, n in zip(steps, self.divisions)]
        return spark.range(self.n_cells).select(F.array(*place).alias("cell"))


    def best_first(self, point: list[float]) -> Iterator[tuple[float, tuple[int, ...]]]:
        """(lb, cell) of the grid's cells by rising (lb, cell), lazily, from a heap that holds the frontier only.

        On each axis the divisions are ranked by their gap to the point.  A cell is a rank on each axis, and
        its successors raise one of the ranks from the last raised axis on, so every cell has one predecessor, which is no
        farther away, and none needs to be remembered.
        """
        gaps = []
        for p, a, b, n in zip(point, self.low, self.high, self.divisions):
            w = (b - a) / n
            gaps.append(sorted((max(a + c * w - p, 0.0, p - (a + (c + 1) * w)), c) for c in range(n)))

        def state(ranks: tuple[int, ...], axis: int):
            own = [gaps[i][r] for i, r in enumerate(ranks)]
            return sqrt(reduce(lambda x, y: x + y, [g * g for g, _ in own])), tuple(c for _, c in own), ranks, axis

        heap, level, same = [state((0,) * self.d, 0)], 0.0, []
        while heap:
            lb, cell, ranks, axis = heapq.heappop(heap)
            if lb > level:
                yield from sorted(same)
                level, same = lb, []
            same.append((lb, cell))
            for i in range(axis, self.d):
                if ranks[i] + 1 < self.divisions[i]:
                    heapq.heappush(heap, state((*ranks[:i], ranks[i] + 1, *ranks[i + 1 :]), i))
        yield from sorted(same)


def checked(df: DataFrame, grid: Grid, what: str) -> DataFrame:
    """df, failing at run time if a point is out of bounds: the whole batch is refused."""
    p = F.col("point")
    return df.withColumn("point", F.when(grid.in_bounds(p), p).otherwise(F.raise_error(F.lit(f"{what} out of bounds")).cast("array<double>")))


class GridSearch:
    """points(doc, point), kept with their cells; equal rows are kept each."""

    def __init__(self, grid: Grid):
        self.grid, self.points = grid, None

    def insert(self, points: DataFrame) -> GridSearch:
        p = checked(points.select(F.col("doc").cast("long").alias("doc"), "point"), self.grid, "point").withColumn("cell", self.grid.cell(F.col("point")))
        self.points = p if self.points is None else self.points.unionByName(p)
        return self

    def _cells(self, queries: DataFrame) -> DataFrame:
        """(q, at, cell, n, lb): every query with every occupied cell; occupied cells are at most n_cells."""
        occupied = self.points.groupBy("cell").agg(F.count("*").alias("n"))
        pairs = all_pairs(checked(queries.select("q", "point"), self.grid, "query").withColumnRenamed("point", "at"), occupied)
        return pairs.withColumn("lb", self.grid.least_distance(F.col("at"), F.col("cell")))

    def ordered_cells(self, queries: DataFrame) -> DataFrame:
        """(q, cell, lb): all cells of the grid by lower bound."""
        pairs = all_pairs(checked(queries.select("q", "point"), self.grid, "query"), self.grid.all_cells(queries.sparkSession))
        return pairs.select("q", "cell", self.grid.least_distance(F.col("point"), F.col("cell")).alias("lb"))

    def _measured(self, cells: DataFrame) -> DataFrame:
        return cells.select("q", "at", "cell", "lb").join(self.points, "cell").withColumn("dist", self.grid.distance(F.col("at"), F.col("point")))

    def _touched(self, queries: DataFrame, max_dist: float | Column) -> DataFrame:
        """(q, at, cell, lb): every query with each cell of the grid that is nearer than max_dist, a number or a column of queries."""
        reach, g = max_dist if isinstance(max_dist, Column) else F.lit(float(max_dist)), self.grid
        q = checked(queries.select("q", "point", reach.alias("_reach")), g, "query").withColumnRenamed("point", "at")
        for i, (a, b, n) in enumerate(zip(g.low, g.high, g.divisions)):
            edge = lambda side, i=i, a=a, b=b, n=n: F.least(F.greatest(F.floor(n * (F.get("at", F.lit(i)) + side * F.col("_reach") - a) / (b - a)), F.lit(0)), F.lit(n - 1)).cast("int")
            q = q.withColumn(f"_c{i}", F.explode(F.sequence(edge(-1), edge(1))))
        q = q.select("q", "at", "_reach", F.array(*[F.col(f"_c{i}") for i in range(g.d)]).alias("cell"))
        return q.withColumn("lb", g.least_distance(F.col("at"), F.col("cell"))).where(F.col("lb") < F.col("_reach")).drop("_reach")

    def _reach(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, reach): a distance within which k points lie surely, from counts of blocks of cells; none if there are fewer than k.

        A block is about the root of an axis's divisions wide, so a query meets about the root of all cells.
        """
        g = self.grid
        wide = [max(1, round(n**0.5)) for n in g.divisions]
        blocks = [-(-n // w) for n, w in zip(g.divisions, wide)]
        high = [a + m * w * (b - a) / n for a, b, n, m, w in zip(g.low, g.high, g.divisions, blocks, wide)]
        coarse = Grid(g.low, high, blocks)
        held = self.points.groupBy(F.array(*[F.expr(f"cast(cell[{i}] div {w} AS int)") for i, w in enumerate(wide)]).alias("cell")).agg(F.count("*").alias("n"))
        pairs = all_pairs(checked(queries.select("q", "point"), g, "query"), held)
        return self._upper(pairs.withColumn("ub", coarse.most_distance(F.col("point"), F.col("cell"))), k)

    def _upper(self, cells: DataFrame, k: int) -> DataFrame:
        """(q, reach): the least upper bound by which cells(q, cell, n, ub) hold k points."""
        upto = Window.partitionBy("q").orderBy("ub", "cell").rowsBetween(Window.unboundedPreceding, 0)
        return cells.withColumn("held", F.sum("n").over(upto)).where(F.col("held") >= k).groupBy("q").agg((F.min("ub") * (1 + 1e-9) + 1e-300).alias("reach"))

    def near_cells(self, queries: DataFrame, max_dist: float) -> DataFrame:
        """(q, cell, lb): the cells of the grid whose lower bound is under max_dist, without listing others but those of the ball's box."""
        return self._touched(queries, max_dist).select("q", "cell", "lb")

    def best_first_cells(self, queries: DataFrame, most: int | None = None, reach: str | None = None) -> DataFrame:
        """(q, rank, cell, lb): every query's cells by (lb, cell), best first, as many as are asked for and no others made.

        At most ``most`` of them, and only those whose bound is under the column ``reach`` of queries where that is given (and
        not null).  Queries keep a heap each, in whichever task holds them; nothing is shuffled.
        """
        g = self.grid
        limit = F.col(reach).cast("double") if reach else F.lit(None).cast("double")
        rows = checked(queries.select("q", "point", limit.alias("_reach")), g, "query")
        kind = rows.schema["q"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for b in batches:
                for q, point, upto in zip(*(c.to_pylist() for c in b.columns)):
                    for rank, (lb, cell) in enumerate(islice(g.best_first(point), most)):
                        if upto is not None and lb >= upto:
                            break
                        held.append((q, rank, list(cell), lb))
                        if len(held) == 4096:
                            yield put(held, b.schema.field(0).type)
                            held = []
                if held:
                    yield put(held, b.schema.field(0).type)
                    held = []

        def put(rows, of):
            q, rank, cell, lb = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(q, of), pa.array(rank, pa.int32()), pa.array(cell, pa.list_(pa.int32())), pa.array(lb, pa.float64())], names=["q", "rank", "cell", "lb"])

        return rows.mapInArrow(run, f"q {kind}, rank int, cell array<int>, lb double")

    def iterate_cells(self, queries: DataFrame, q: int) -> Iterator[Row]:
        """One query's cells by (lb, cell), lazily: rings of doubling radius, so a reader that stops early has caused few cells."""
        g, own = self.grid, queries.where(F.col("q") == q)
        done, upto = 0.0, max((b - a) / n for a, b, n in zip(g.low, g.high, g.divisions))
        end = dist(g.low, g.high)
        while True:
            last = upto > end
            yield from self.near_cells(own, upto).where(F.col("lb") >= done).orderBy("lb", "cell").toLocalIterator()
            if last:
                return
            done, upto = upto, 2 * upto

    def _spots(self) -> GridSearch:
        """The places that hold points, each once; a search among these costs nothing for copies."""
        spots = GridSearch(self.grid)
        spots.points = self.points.select("point", "cell").distinct()
        return spots

    def _places(self, queries: DataFrame) -> DataFrame:
        """The places of queries, each once and its own id."""
        return checked(queries.select("q", "point"), self.grid, "query").select(F.col("point").alias("q"), "point").distinct()

    def within(self, queries: DataFrame, max_dist: float, shown: Callable[[Column], Column] = lambda x: x, together: int = 1000) -> DataFrame:
        """(q, doc, point, dist) nearer than max_dist, strictly; none if that is negative.

        The places of queries are joined with the cells that their balls touch and no others; only a ball wider than the grid meets
        every occupied cell.  A pair of places is measured once (and its distance put as ``shown``), whatever the copies
        there: queries go to it in lists of at most ``together``, so what is shuffled is far less than the result.
        """
        wide = max_dist >= max(b - a for a, b in zip(self.grid.low, self.grid.high))
        spots, places = self._spots(), self._places(queries)
        cells = spots._cells(places).where(F.col("lb") < max_dist) if wide else spots._touched(places, max(max_dist, 0.0))
        near = spots._measured(cells).where(F.col("dist") < max_dist).select("at", "point", shown(F.col("dist")).alias("dist"))
        own = queries.select("q", F.col("point").alias("at")).withColumn("_list", F.expr(f"(row_number() OVER (PARTITION BY at ORDER BY q) - 1) div {int(together)}"))
        lists = own.groupBy("at", "_list").agg(F.collect_list("q").alias("_qs"))
        return near.join(lists, "at").select("point", "dist", "_qs").join(self.points.select("doc", "point"), "point").select(F.explode("_qs").alias("q"), "doc", "point", "dist")

    def _finer(self, points: DataFrame, a_cell: int = 8) -> GridSearch:
        """points(doc, point, cell) in a grid whose occupied cells hold about ``a_cell`` of them, or in this one if they do."""
        g = self.grid
        cut = max(1, int((points.count() / (a_cell * max(1, points.select("cell").distinct().count()))) ** (1 / g.d)))
        return GridSearch(Grid(g.low, g.high, [n * cut for n in g.divisions])).insert(points)

    def nearest(self, queries: DataFrame, k: int, max_dist: float = float("inf")) -> DataFrame:
        """(q, rank, doc, point, dist): the k nearest, ties by id.

        Of points at one place only the k smallest ids can be among them, and queries at one place have the same answer, so copies
        of either cost nothing; what is left is searched in a grid as fine as it is dense.
        """
        first = Window.partitionBy("point").orderBy("doc")
        left = self.points.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k).select("doc", "point", "cell")
        found = self._finer(left)._nearest(self._places(queries), k, max_dist).select(F.col("q").alias("_at"), "rank", "doc", "point", "dist")
        return queries.select("q", F.col("point").alias("_at")).join(found, "_at").select("q", "rank", "doc", "point", "dist")

    def _nearest(self, queries: DataFrame, k: int, max_dist: float) -> DataFrame:
        """nearest() of each row.

        The k-th distance is at most the upper bound by which the nearest cells hold k points.  Blocks of cells give
        a first bound, the cells that it touches a second; cells whose lower bound is beyond that aren't joined.
        """
        most = min(float(max_dist), 2 * dist(self.grid.low, self.grid.high))  # beyond the grid's diagonal is everything
        reach = F.least(F.coalesce("reach", F.lit(most)), F.lit(most))
        bounded = queries.select("q", "point").join(self._reach(queries, k), "q", "left")
        counts = self.points.groupBy("cell").agg(F.count("*").alias("n"))
        cells = self._touched(bounded, reach).join(counts, "cell").withColumn("ub", self.grid.most_distance(F.col("at"), F.col("cell")))
        near = cells.join(self._upper(cells, k), "q", "left").where(F.col("lb") < reach)
        order = Window.partitionBy("q").orderBy("dist", "doc")
        found = self._measured(near).where(F.col("dist") < max_dist)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "doc", "point", "dist")
