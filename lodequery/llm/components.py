"""Connected components of a link table, by alternating large-star and small-star steps.

Every step takes each vertex's smallest neighbour by an aggregation with map-side
combination and gives it to the vertex's links by ``spread_join``, so no vertex's
links are gathered in one task.  Each round is written to the shared folder, which
cuts the lineage, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import store


#: Links that need no spreading.
FEW = 50_000


def _saved(df: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    """The edges as written and read back, and figures that tell when they have settled."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get["n"], seen.get["h"])


def spread_join(rows: DataFrame, lookup: DataFrame, on: str | list[str], total: int, *, weight: str = "_c", few: int = 0) -> DataFrame:
    """rows joined with lookup's one row for each key; rows without one are left out.

    weight says how many of the rows have the key, and total how many rows there are.  Keys with more than a
    task's share of the rows, which can't be more than there are tasks, are broadcast; the others' rows are
    shuffled, so no task gets more than about two shares.  Up to ``few`` rows are joined as they are: any task
    can hold them, and the plan is smaller.
    """
    if total <= few:
        return rows.join(lookup.drop(weight), on)
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = F.col(weight) > max(64, total // tasks)
    keys, names = [on] if isinstance(on, str) else list(on), [c for c in lookup.columns if c not in ({on} if isinstance(on, str) else set(on)) and c != weight]
    hot = lookup.where(many).select(*keys, F.struct(*names).alias("_hot"))  # at most a row for each task
    both = rows.join(F.broadcast(hot), keys, "left")
    cold = both.where("_hot is null").drop("_hot").join(lookup.where(~many).select(*keys, *names), keys)
    return both.where("_hot is not null").select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in names]).unionByName(cold.select(*rows.columns, *names))


def components(links: DataFrame, *, max_rounds: int = 60, folder: str | None = None) -> DataFrame:
    """(vertex, root) for every vertex of links (a, b): root is the smallest vertex it reaches.

    Links may be in either direction, repeated, or from a vertex to itself; those with a null end are ignored.
    """
    spark = links.sparkSession
    folder = folder or store.new_folder(spark, "components")
    a, b = F.col("a"), F.col("b")
    edges = links.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, previous = _saved(edges.where("a > b"), f"{folder}/0")
    n = previous[0]
    for k in range(1, max_rounds + 1):
        # Large star: a vertex's larger neighbours are linked to its smallest neighbour.
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_c")).select("a", F.least("a", "m").alias("m"), "_c")
        large = spread_join(edges.select(a.alias("v"), b.alias("a")), low, "a", n, few=FEW).select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: a vertex and its smaller neighbours are linked to the smallest of them.
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_c"))
        small = spread_join(large, low, "a", n, few=FEW).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges, now = _saved(small.where("a > b").distinct(), f"{folder}/{k}")
        n = now[0]
        if now == previous:
            break
        previous = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(a.alias("vertex"), b.alias("root"))
    alone = links.where("a is not null and b is not null").select(F.explode(F.array("a", "b")).alias("vertex")).distinct().join(roots, "vertex", "left_anti")
    return roots.union(alone.select("vertex", F.col("vertex").alias("root")))
