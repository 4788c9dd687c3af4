"""Exact search within a Hamming radius of codes of any length, by an index on each part of the code.

Codes are arrays of BIGINT words.  Cut in m parts, two codes within radius r differ in some part by at most
floor(r / m) bits; sharper, with r = s * m + a, in one of the first a + 1 parts by at most s, or in one of the others
by at most s - 1.  So each part needs only the masks of that small radius over its own bits, where masks over the
whole code would number sum C(nbits, i).  Masks are made in Spark, weight by weight, and broadcast once their number is known
to be small.  Buckets hold the codes, so a hit's distance is checked where it is found.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import hamming_words
from ..plans.planner import SMALL, ball_size

WORD = 64


def sign_words(vector: Column, nbits: int, start: int = 0) -> Column:
    """Bit i says whether component start + i is positive; 64 bits a word."""
    from ..functions.bits import sign_code

    return F.array(*[sign_code(vector, min(WORD, nbits - at), start + at) for at in range(0, nbits, WORD)])


def part_code(words: Column, first: int, size: int) -> Column:
    """Bits first .. first + size - 1 of a code as a number; size is up to 62."""
    word, bit = divmod(first, WORD)
    low = F.shiftrightunsigned(F.get(words, F.lit(word)), bit)
    if bit + size > WORD:
        low = low.bitwiseOR(F.shiftleft(F.get(words, F.lit(word + 1)), WORD - bit))
    return low.bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def mask_array(size: Column, radius: Column) -> Column:
    """The masks of weight 0..radius over size bits; each is one of a weight less with one higher bit more."""
    none = F.array(F.struct(F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("last"), F.lit(0).alias("weight")))

    def longer(x: Column) -> Column:
        bits = F.sequence(x["last"] + 1, size - 1)
        return F.transform(bits, lambda b: F.struct(x["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("mask"), b.alias("last"), (x["weight"] + 1).alias("weight")))

    def add(acc: Column, w: Column) -> Column:
        shorter = F.filter(acc, lambda x: (x["weight"] == w - 1) & (x["last"] < size - 1))
        return F.concat(acc, F.flatten(F.transform(shorter, longer)))

    some = F.aggregate(F.sequence(F.lit(1), radius), none, add)
    return F.transform(F.when(radius > 0, some).otherwise(none), lambda x: x["mask"])


class MultiIndex:
    """docs(doc, code) and queries(q, code), code an array of words; finds everything within ``radius``.

    parts defaults to as many as make a part about log2(documents) bits (20 where nothing is known).  Documents are
    found once each, at the least distance where an id was inserted with several codes; inserting appends.
    """

    def __init__(self, spark: SparkSession, nbits: int, radius: int, parts: int | None = None, n_docs: int = 1 << 20):
        parts = parts or max(1, round(nbits / max(1.0, log2(max(2, n_docs)))))
        parts = max(parts, -(-nbits // 62))
        if nbits < 1 or not 0 <= radius <= nbits or not 1 <= parts <= nbits:
            raise ValueError("need nbits >= 1, 0 <= radius <= nbits, 1 <= parts <= nbits")
        self.spark, self.nbits, self.radius = spark, nbits, radius
        ends = [nbits * p // parts for p in range(parts + 1)]
        s, extra = divmod(radius, parts)
        #: (part, first bit, bits, radius) of the parts that are looked at.
        self.parts = [(p, a, b - a, min(b - a, s if p <= extra else s - 1)) for p, (a, b) in enumerate(zip(ends, ends[1:])) if p <= extra or s > 0]
        if (most := max(ball_size(size, r) for _, _, size, r in self.parts)) > SMALL:
            raise ValueError(f"{most} masks for a part; use more parts")
        self.reset()

    def reset(self) -> MultiIndex:
        self.index = self.spark.createDataFrame([], "part int, key bigint, doc bigint, code array<bigint>")
        return self

    def _parts(self, code: Column) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(p).alias("part"), part_code(code, a, size).alias("key")) for p, a, size, _ in self.parts]))

    def _checked(self, df: DataFrame) -> DataFrame:
        words = -(-self.nbits // WORD)
        return df.withColumn("code", F.when(F.size("code") == words, F.col("code")).otherwise(F.raise_error(F.lit(f"a code of {self.nbits} bits has {words} words")).cast("array<bigint>")))

    def insert(self, docs: DataFrame) -> MultiIndex:
        rows = self._checked(docs.where("code is not null")).select(self._parts(F.col("code")).alias("k"), F.col("doc").cast("long").alias("doc"), "code")
        self.index = self.index.unionByName(rows.select("k.part", "k.key", "doc", "code"))
        return self

    def masks(self) -> DataFrame:
        """(part, mask) of all parts, one of at most SMALL masks each."""
        own = self.spark.createDataFrame([(p, size, r) for p, _, size, r in self.parts], "part int, size int, radius int")
        return own.select("part", F.explode(mask_array(F.col("size"), F.col("radius"))).alias("mask"))

    def probes(self, queries: DataFrame) -> DataFrame:
        """(q, code, part, key) of everything that is looked up."""
        own = self._checked(queries.where("code is not null")).select("q", "code", self._parts(F.col("code")).alias("k")).select("q", "code", "k.part", "k.key")
        return own.join(F.broadcast(self.masks()), "part").select("q", "code", "part", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(q, step, doc): each document within the radius; its step is its distance."""
        hits = self.probes(queries).withColumnRenamed("code", "own").join(self.index, ["part", "key"])
        near = hits.select("q", "doc", hamming_words(F.col("own"), F.col("code")).alias("step")).where(F.col("step") <= self.radius)
        return near.groupBy("q", "doc").agg(F.min("step").alias("step")).select("q", "step", "doc")

    def search(self, queries: DataFrame) -> DataFrame:
        """(q, docs): the sorted ids within the radius, a row for every query, possibly empty."""
        sets = self.candidates(queries).groupBy("q").agg(F.array_sort(F.collect_list("doc")).alias("docs"))  # a query's answer is a set by definition
        return queries.select("q").distinct().join(sets, "q", "left").select("q", F.coalesce("docs", F.array().cast("array<bigint>")).alias("docs"))

    def n_probes(self) -> int:
        """Look-ups of a query."""
        return sum(ball_size(size, r) for _, _, size, r in self.parts)
