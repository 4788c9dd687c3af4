"""Exact search within a Hamming radius, by exploding masks into equi-joins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import hamming
from ..plans.planner import SMALL, ball_size, radius_by_probing
from .search import SearchStructure


def masks(nbits: int, radius: int) -> list[int]:
    """XOR masks of weight 0..radius, by weight and then by the bits' places."""
    out = [sum(1 << b for b in bits) for w in range(radius + 1) for bits in combinations(range(nbits), w)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


class RadiusSearch(SearchStructure):
    """docs(doc, code) and queries(q, code) of nbits; table t stores code ^ masks[t].

    With one table a document is found if it lies within the radius; with more, if it does so of the
    query under one of the first ntables masks.  Steps go by mask and then by table.
    """

    def __init__(self, spark: SparkSession, nbits: int, radius: int, ntables: int = 1, most_masks: int = 2_000_000):
        if not 1 <= nbits <= 64 or not 0 <= radius <= nbits or ntables < 1:
            raise ValueError("need 1 <= nbits <= 64, 0 <= radius <= nbits, ntables >= 1")
        if ball_size(nbits, radius) > most_masks:
            raise ValueError(f"{ball_size(nbits, radius)} masks; compare pairs instead (within_radius)")
        self.nbits, self.radius, self.ntables, self.masks = nbits, radius, ntables, masks(nbits, radius)
        super().__init__(spark)

    def keys(self, docs: DataFrame) -> DataFrame:
        own = F.array(*[F.struct(F.lit(t).alias("table_no"), F.col("code").bitwiseXOR(F.lit(m).cast("long")).alias("code")) for t, m in enumerate(self.masks[: self.ntables])])
        return docs.select(F.col("doc").cast("long").alias("doc"), F.explode(own).alias("k")).select("k.table_no", "k.code", "doc")

    def probes(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        steps = self.spark.createDataFrame([(r * self.ntables + t, t, m) for r, m in enumerate(self.masks) for t in range(self.ntables) if limit is None or r < limit], "step long, table_no int, mask long")
        steps = F.broadcast(steps) if len(self.masks) * self.ntables <= SMALL else steps  # beyond, partitions are paired block by block
        return queries.select("q", F.col("code").alias("own")).crossJoin(steps).select("q", "step", "table_no", F.col("own").bitwiseXOR(F.col("mask")).alias("code"))


def within_radius(queries: DataFrame, docs: DataFrame, nbits: int, radius: int, n_docs: int | None = None) -> DataFrame:
    """(q, doc, dist) within the radius, by masks or by comparing pairs, whichever makes fewer rows."""
    from ..plans.planner import all_pairs

    n_docs = docs.count() if n_docs is None else n_docs
    if radius_by_probing(nbits, radius, n_docs):
        s = RadiusSearch(docs.sparkSession, nbits, radius)
        dist = F.bit_count(F.col("p.code").bitwiseXOR(F.col("own")))
        probes = s.probes(queries).alias("p").join(queries.select("q", F.col("code").alias("own")), "q")
        return probes.join(docs.select(F.col("doc"), F.col("code").alias("d_code")), F.col("p.code") == F.col("d_code")).select("q", "doc", dist.alias("dist"))
    pairs = all_pairs(queries.select("q", F.col("code").alias("q_code")), docs.select("doc", F.col("code").alias("d_code")))
    return pairs.select("q", "doc", hamming(F.col("q_code"), F.col("d_code")).alias("dist")).where(F.col("dist") <= radius)
