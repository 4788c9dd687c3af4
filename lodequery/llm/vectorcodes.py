"""Vector codes: a product quantiser on whole numbers, trained by Lloyd's rounds in Spark.

Components become floor(scale * x).  A vector is cut into equal parts, and each part
position has a codebook of integer entries.  A round broadcasts the codebooks (parts *
entries * width whole numbers, whatever the number of vectors); tasks take Arrow batches,
work out the distances of all parts to all entries by |x|^2 - 2 x.c + |c|^2 with int64
matrix products, and take the first of the nearest.  A task adds up its parts by entry and
sends one row for each (part, entry, position); a grouped shuffle merges them, and floors
of the means are the next codebooks.  Everything is a whole number, so the codebooks don't
depend on how rows are spread, and a lost task can be done again.

What 63 bits can't hold is an OverflowError, never a wrong code.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import spread_join

#: Distances held at once in a task.
STEP = 1 << 20
LARGEST = np.iinfo(np.int64).max


def _most(x: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest of entries, and its squared distance; both arrays are int64."""
    if x.shape[1] * (_most(x) + _most(entries)) ** 2 > LARGEST:
        raise OverflowError("a squared distance beyond 63 bits; choose a smaller scale")
    code, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms, step = (entries * entries).sum(axis=1), max(1, STEP // max(1, len(entries)))
    for at in range(0, len(x), step):
        own = x[at : at + step]
        far = norms - 2 * (own @ entries.T)
        best = far.argmin(axis=1)
        code[at : at + step] = best
        least[at : at + step] = far[np.arange(len(own)), best] + (own * own).sum(axis=1)
    return code, least


def quantise(lists: pa.Array, scale: float) -> np.ndarray:
    """Floors of scale * x of vectors of one length, as int64 rows."""
    width = len(lists[0]) if len(lists) else 0
    x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(lists), width)
    if x.size and not np.abs(x).max() < 2.0**62:
        raise OverflowError("a component beyond 62 bits; choose a smaller scale")
    return x.astype(np.int64)


class Codebooks:
    """Integer entries by part, entry and position; small enough for any broadcast."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a column for each part) and squared distances summed over parts, of rows x."""
        parts, _, width = self.entries.shape
        found = [nearest(x[:, p * width : (p + 1) * width], self.entries[p]) for p in range(parts)]
        if sum(_most(d) for _, d in found) > LARGEST:
            raise OverflowError("an error beyond 63 bits; choose a smaller scale")
        return np.stack([c for c, _ in found], axis=1), sum(d for _, d in found)

    def sums(self, codes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Component sums and numbers of the rows of x by part and entry."""
        if len(x) * _most(x) > LARGEST:
            raise OverflowError("a sum of components beyond 63 bits; choose a smaller scale")
        parts, n, width = self.entries.shape
        total, count = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for p in range(parts):
            order = np.argsort(codes[:, p], kind="stable")
            own, first = np.unique(codes[order, p], return_index=True)
            if len(own):
                total[p, own] = np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
            count[p] = np.bincount(codes[:, p], minlength=n)
        return total, count

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where(v.isNotNull() & finite)


def _one_length(b: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vectors have that length, and which rows they are."""
    own = np.flatnonzero(b.column("v").value_lengths().to_numpy(zero_copy_only=False) == width)
    return (b if len(own) == b.num_rows else b.take(pa.array(own))), own


def first_codebooks(kept: DataFrame, *, parts: int, entries: int, scale: float) -> Codebooks | None:
    """The parts of the vectors with the smallest ids, ascending; None if there is no vector with components.

    Null ids come last, equal ids by their vectors; only vectors as long as the first of them count.
    """
    some = kept.where("size(v) > 0").orderBy(F.col("id").asc_nulls_last(), "v")
    head = some.select(F.size("v").alias("n")).limit(1).collect()
    if not head:
        return None
    width = head[0].n
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    seeds = pa.chunked_array(some.where(F.size("v") == width).select("v").limit(entries).toArrow().column(0)).combine_chunks()  # entries rows at most
    x = quantise(seeds, scale)
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2)))


def next_codebooks(kept: DataFrame, books: Codebooks, scale: float) -> Codebooks:
    """One round: every part to its nearest entry, then every entry to the floor of its parts' mean."""
    parts, n, width = books.entries.shape
    sent = kept.sparkSession.sparkContext.broadcast(books.entries)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(sent.value)
        total, count = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        largest = rows = 0
        for b in batches:
            x = quantise(_one_length(b, parts * width)[0].column("v"), scale)
            if not len(x):
                continue
            largest, rows = max(largest, _most(x)), rows + len(x)
            if largest * rows > LARGEST:
                raise OverflowError("a sum of components beyond 63 bits; choose a smaller scale")
            t, c = own.sums(own.assign(x)[0], x)
            total += t
            count += c
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.repeat(p, width), pa.int32()), "entry": pa.array(np.repeat(e, width), pa.int32()), "position": pa.array(np.tile(np.arange(width), len(p)), pa.int32()),
            "total": pa.array(total[p, e].reshape(-1)), "n": pa.array(np.repeat(count[p, e], width)),
        })

    sums = kept.select("v").mapInArrow(add, "part int, entry int, position int, total long, n long").groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    got = sums.toArrow()  # a row for each whole number of the codebooks at most
    sent.unpersist()
    part, entry, position, total, count = (got.column(c).to_numpy() for c in ("part", "entry", "position", "total", "n"))
    entries = books.entries.copy()
    entries[part, entry, position] = total // count
    return Codebooks(entries)


def train_codebooks(kept: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> Codebooks | None:
    """The codebooks after some rounds over all rows of usable()."""
    books = first_codebooks(kept, parts=parts, entries=entries, scale=scale)
    for _ in range(rounds if books else 0):
        books = next_codebooks(kept, books, scale)
    return books


def encode(kept: DataFrame, books: Codebooks, scale: float) -> DataFrame:
    """(id, label, code, error): hex digits of each part's entry, and the squared distance to the entries."""
    parts, n, width = books.entries.shape
    digits = max(2, len(f"{n - 1:x}"))
    names = np.asarray([f"{k:0{digits}x}" for k in range(n)])
    sent = kept.sparkSession.sparkContext.broadcast(books.entries)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(sent.value)
        for b in batches:
            same, at = _one_length(b, parts * width)
            code, error = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            other = np.ones(b.num_rows, bool)
            if len(at):
                found, far = own.assign(quantise(same.column("v"), scale))
                code[at], error[at], other[at] = ["".join(r) for r in names[found].tolist()], far, False
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=other)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(put, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: the id, code, error, label_error (of all rows with the label) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped.  A null id is kept, and comes after
    all others in the choice of the first codebooks; repeated ids and rows are encoded each.  Null labels
    count as one label.  The vector of the smallest id that has components sets the length; vectors of
    another length, empty ones included, get a null code and error and don't change codebooks or sums (label_error is null
    where no row of a label has a code).  Fewer vectors than ``entries`` make smaller codebooks; without any the codes are
    null and the digest is that of an empty text.  An empty table gives an empty result; extra columns don't matter.
    A length that ``parts`` doesn't divide is a ValueError, a number beyond 63 bits an OverflowError.
    """
    spark = vectors.sparkSession
    folder = store.new_folder(spark, "vectorcodes")
    kept = usable(vectors, id_col, vec_col, label_col)
    kept.write.parquet(f"{folder}/kept")
    kept = spark.read.schema(kept.schema).parquet(f"{folder}/kept")
    books = train_codebooks(kept, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books is None:
        books = Codebooks(np.zeros((parts, 0, 0), np.int64))
        coded = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        coded = encode(kept, books, scale)
    coded.write.parquet(f"{folder}/coded")
    coded = spark.read.schema(coded.schema).parquet(f"{folder}/coded").select("id", "code", "error", F.col("label").isNotNull().alias("known"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    sums = coded.groupBy("known", "label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_c"))
    return spread_join(coded, sums, ["known", "label"], coded.count()).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """The same in DuckDB SQL for vectors of parts * width components and distinct ids."""
    near = """
a{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, far * {n} + entry) AS entry, min(far) AS far FROM
      (SELECT x.id, x.part, b.entry, x.n2 + b.n2 - 2 * list_dot_product(x.x, b.x) AS far FROM x JOIN b{r} AS b ON x.part = b.part) AS q GROUP BY ALL)"""
    mean = """
b{s} AS MATERIALIZED (SELECT part, entry, x, list_dot_product(x, x) AS n2 FROM (
      SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} AS b LEFT JOIN (
        SELECT part, entry, list(v ORDER BY k) AS x FROM (
          SELECT part, entry, k, floor(sum(x[k]) / count(*)) AS v FROM a{r} JOIN x USING (id, part), unnest(range(1, {w} + 1)) AS t(k) GROUP BY ALL) AS q GROUP BY ALL) AS m ON m.part = b.part AND m.entry = b.entry) AS q)"""
    steps = [near.format(r=r, n=entries) + ("," + mean.format(r=r, s=r + 1, w=width) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT id, part, x, list_dot_product(x, x) AS n2 FROM (SELECT id, part, q[part * {width} + 1 : part * {width} + {width}] AS x FROM v, unnest(range({parts})) AS t(part)) AS q),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry, x, n2 FROM x WHERE id IN (SELECT id FROM v ORDER BY id LIMIT {entries})),
{",".join(steps)},
c AS (SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY id),
d AS (SELECT sha256(string_agg(x[k]::BIGINT::VARCHAR, ',' ORDER BY part, entry, k)) AS sha FROM b{rounds}, unnest(range(1, {width} + 1)) AS t(k))
SELECT vec_id, code, error, label_error, sha AS codebooks_sha256 FROM (
  SELECT v.id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM v JOIN c ON c.id = v.id) AS q, d
"""
