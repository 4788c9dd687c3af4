"""Multi-table, multi-probe hashing of codes whose bits are uncertain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kbest import likeliest_outcomes
from .search import SearchStructure


class MultiProbe(SearchStructure):
    """docs(doc, logits) and queries(q, logits) of nbits bits given by their logits.

    A document's n-th likeliest code is its key in table n; a query looks up its ``lookups`` likeliest
    codes in every table.  Steps go by code and then by table.  deltas() without a limit probes all
    2**nbits codes, so it asks for a limit beyond 16 bits.
    """

    def __init__(self, spark: SparkSession, nbits: int, ntables: int, lookups: int = 1):
        if not 1 <= nbits <= 63 or ntables < 1 or lookups < 1:
            raise ValueError("need 1 <= nbits <= 63, ntables >= 1, lookups >= 1")
        self.nbits, self.ntables, self.lookups = nbits, ntables, lookups
        super().__init__(spark)

    def default_limit(self) -> int:
        return self.lookups

    def few(self, limit: int | None) -> bool:
        return limit is not None and limit * self.ntables <= 64

    def key(self, table_no: Column | None = None, code: Column | None = None) -> Column:
        bits = (self.ntables - 1).bit_length()
        if self.nbits + bits > 63:
            return super().key(table_no, code)
        table_no, code = (F.col(name) if c is None else c for name, c in (("table_no", table_no), ("code", code)))
        return F.shiftleft(code, bits).bitwiseOR(table_no.cast("long"))

    def candidates(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(q, step, doc): each document at the first probe that finds it; with up to 64 probes a query nothing that is found is grouped."""
        return self.first_hits(queries, limit) if self.few(limit) else super().candidates(queries, limit)

    def _codes(self, logits, k: int | None):
        checked = F.when(F.size(logits) == self.nbits, logits).otherwise(F.raise_error(F.lit(f"need {self.nbits} logits")).cast("array<double>"))
        return F.transform(likeliest_outcomes(checked, self.nbits, k), lambda x: x["code"])

    def keys(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.posexplode(self._codes(F.col("logits"), self.ntables)).alias("table_no", "code"), F.col("doc").cast("long").alias("doc"))

    def probes(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        ranked = queries.select("q", F.posexplode(self._codes(F.col("logits"), limit)).alias("rank", "code"))
        tables = ranked.withColumn("table_no", F.explode(F.sequence(F.lit(0), F.lit(self.ntables - 1))))
        return tables.select("q", (F.col("rank") * self.ntables + F.col("table_no")).cast("long").alias("step"), "table_no", "code")
