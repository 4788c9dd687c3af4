"""Hamming histograms and precision/recall curves over all query-document pairs."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import hamming
from ..plans.planner import DOC_ROWS, QUERY_ROWS, all_pairs, dealt, in_blocks

#: Digits enough for any double with some places after the point.
WIDE = Context(prec=400)


def pair_distances(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, d, dist) of every pair of queries(q, code) and docs(d, code).

    Documents are dealt over tasks of DOC_ROWS first, so the loop over pairs is a stage of its own: the many branches that pack a
    code's bits would make its generated method too long to be compiled.
    """
    dealt_docs = docs.select("d", F.col("code").alias("d_code")).repartition(max(1, -(-docs.count() // DOC_ROWS)), "d")
    return all_pairs(queries.select("q", F.col("code").alias("q_code")), dealt_docs).select("q", "d", hamming(F.col("q_code"), F.col("d_code")).alias("dist"))


def soft_distances(queries: DataFrame, docs: DataFrame, digits: int, q_rows: int = QUERY_ROWS, d_rows: int = DOC_ROWS, piece: int = 1 << 16) -> DataFrame:
    """(q, d, dist) of every pair of queries(q, v) and docs(d, v): bits.soft_hamming() of the vectors, rounded to ``digits`` places, half up.

    Blocks of both sides meet in a task's group, which gives its pairs in pieces; a group holds its two blocks and one piece.
    Products are added in the order of the components, as the column expression adds them.  A vector that is null or holds a
    null, and vectors of two lengths, are null apart.
    """
    (own_q, nq), (own_d, nd) = dealt(queries, "id", queries.count(), q_rows), dealt(docs, "id", docs.count(), d_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda df, name, asks: df.select(F.lit(asks).alias("asks"), F.col(name).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    q = side(queries, "q", True).withColumn("_qp", own_q).withColumn("_dp", every(nd))
    d = side(docs, "d", False).withColumn("_qp", every(nq)).withColumn("_dp", own_d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        asks = rows.column("asks").to_numpy()
        left, right = (list(by_length(rows.filter(pa.array(x)))) for x in (asks, ~asks))
        for n, q_ids, a in left:
            for m, d_ids, b in right:
                step = max(1, piece // len(d_ids))
                for i in range(0, len(q_ids), step):
                    ids = q_ids[i : i + step]
                    dist = pa.nulls(len(ids) * len(d_ids), pa.float64())
                    if n == m >= 0:
                        dist = pa.array(half_up(soft_block(a[i : i + step], b), digits).ravel())
                    yield pa.record_batch({"q": ids.take(pa.array(np.repeat(np.arange(len(ids)), len(d_ids)))), "d": pa.concat_arrays([d_ids] * len(ids)), "dist": dist})

    keys = ["_qp", "_dp"]
    return q.unionByName(d).repartition(min(nq * nd, 4000), *keys).groupBy(*keys).applyInArrow(work, "q long, d long, dist double")


def by_length(rows: pa.Table) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(n, ids, matrix) of the rows(id, v) whose vector has n components; n is -1 for vectors that are null or hold a null."""
    ids, v = (rows.column(c).combine_chunks() for c in ("id", "v"))
    n = v.value_lengths().fill_null(-1).to_numpy().copy()
    n[v.value_parent_indices().filter(v.flatten().is_null()).to_numpy()] = -1
    for size in np.unique(n):
        at = pa.array(np.flatnonzero(n == size))
        yield int(size), ids.take(at), v.take(at).flatten().to_numpy().reshape(len(at), size) if size >= 0 else np.empty((len(at), 0))


def soft_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half of n - v.w for every row v of a and w of b."""
    dot, product = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    with np.errstate(all="ignore"):  # not finite components give what they give in SQL
        for x, y in zip(a.T, np.ascontiguousarray(b.T)):
            np.multiply(x[:, None], y, out=product)
            dot += product
        return (a.shape[1] - dot) / 2


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as Spark's round() does it, by the shortest decimal numeral of a double; no negative zeros."""
    with np.errstate(all="ignore"):
        scaled = np.abs(x) * 10.0**digits
        whole = np.floor(scaled + 0.5)
        out = np.copysign(whole / 10.0**digits, x) + 0.0
        unsure = np.isfinite(x) & ((scaled >= 2.0**50) | (np.abs(scaled - np.floor(scaled) - 0.5) <= scaled * 2.0**-50))  # near a tie the numeral decides
    place = Decimal(1).scaleb(-digits)
    for i in zip(*np.nonzero(unsure)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(place, ROUND_HALF_UP, WIDE)) + 0.0
    return np.where(np.isfinite(x), out, x)


def distance_histogram(queries: DataFrame, docs: DataFrame, relevant: DataFrame, nbits: int) -> DataFrame:
    """(dist, n_rel, n_irrel) for dist = 0..nbits, over all pairs; relevant(q, d) are the relevant ones.

    Equal codes are counted first and only then paired, so the pairing is of distinct codes with
    weights; relevant pairs are found by equi-joins.  Repeated relevance rows count once.
    """
    qs = queries.groupBy(F.col("code").alias("q_code")).agg(F.count("*").alias("nq"))
    ds = docs.groupBy(F.col("code").alias("d_code")).agg(F.count("*").alias("nd"))
    every = all_pairs(qs, ds).groupBy(hamming(F.col("q_code"), F.col("d_code")).alias("dist")).agg(F.sum(F.col("nq") * F.col("nd")).alias("n_all"))
    rel = relevant.select("q", "d").distinct().join(queries.select("q", F.col("code").alias("q_code")), "q").join(docs.select("d", F.col("code").alias("d_code")), "d")
    rel = rel.groupBy(hamming(F.col("q_code"), F.col("d_code")).alias("dist")).agg(F.count("*").alias("n_rel"))
    spine = queries.sparkSession.range(0, nbits + 1).select(F.col("id").cast("int").alias("dist"))
    out = spine.join(every, "dist", "left").join(rel, "dist", "left").select("dist", F.coalesce("n_rel", F.lit(0)).cast("long").alias("n_rel"), F.coalesce("n_all", F.lit(0)).cast("long").alias("n_all"))
    return out.select("dist", "n_rel", (F.col("n_all") - F.col("n_rel")).alias("n_irrel"))


def label_histogram(queries: DataFrame, docs: DataFrame, nbits: int, q_rows: int = 4096, d_rows: int = 16384) -> DataFrame:
    """distance_histogram() of queries(code, label) and docs(code, label) where equal labels are relevant, of codes of up to 64 bits.

    Equal rows are counted first; blocks of both sides then meet in a task, which sends its counts per distance.  No pair is
    a row.  A null label matches nothing, a null code is in no pair.
    """
    counted = lambda df, side: df.where("code is not null").groupBy(F.col("code").cast("long").alias(f"{side}_code"), F.col("label").alias(f"{side}_label")).agg(F.count("*").alias(f"{side}_n"))
    q, d = counted(queries, "q"), counted(docs, "d")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        every, rel = np.zeros(nbits + 1, np.int64), np.zeros(nbits + 1, np.int64)
        if left.num_rows and right.num_rows:
            count(left, right, every, rel)
        return pa.table({"dist": pa.array(np.arange(nbits + 1), pa.int32()), "n_all": every, "n_rel": rel})

    def count(left: pa.Table, right: pa.Table, every: np.ndarray, rel: np.ndarray) -> None:
        marks: dict = {None: -1}
        a, b = (np.array([marks.setdefault(v, len(marks)) for v in t.column(1).to_pylist()], np.int64) for t in (left, right))
        by_label = [np.argsort(x, kind="stable") for x in (a, b)]
        (cq, nq, a), (cd, nd, b) = ((t.column(0).to_numpy()[o], t.column(2).to_numpy()[o], x[o]) for t, o, x in zip((left, right), by_label, (a, b)))
        add_counts(every, cq, nq, cd, nd)
        for mark in np.unique(a[a >= 0]):
            (i, j), (k, m) = (np.searchsorted(x, [mark, mark + 1]) for x in (a, b))
            add_counts(rel, cq[i:j], nq[i:j], cd[k:m], nd[k:m])

    q_part, d_part = dealt(q, "q_code", q.count(), q_rows), dealt(d, "d_code", d.count(), d_rows)
    sums = in_blocks(q, d, work, "dist int, n_all long, n_rel long", q_part, d_part).groupBy("dist").agg(F.sum("n_all").alias("n_all"), F.sum("n_rel").alias("n_rel"))
    return _histogram(sums.select("dist", "n_all"), sums.select("dist", "n_rel"), nbits)


def add_counts(total: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> None:
    """Add to total the numbers of pairs at each distance of codes a and b that occur na and nb times."""
    step, wide, once = max(1, (1 << 18) // max(1, len(b))), len(total), (nb == 1).all()
    for i in range(0, len(a), step):
        dist = np.bitwise_count((a[i : i + step, None] ^ b[None]).view(np.uint64))  # numpy counts the bits of a negative number's absolute value
        for n in np.unique(na[i : i + step]):
            at = dist[na[i : i + step] == n]
            if once:
                total += n * np.bincount(at.ravel(), minlength=wide)
            else:  # whole numbers in doubles: a piece has far fewer pairs than 2 ** 53
                total += n * np.bincount(at.ravel(), np.broadcast_to(nb, at.shape).ravel(), wide).astype(np.int64)


def walsh_rows(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in place; a row has a power of two of whole numbers."""
    width = 1
    while width < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, width)
        low = pairs[:, :, 0] + pairs[:, :, 1]
        pairs[:, :, 1] = pairs[:, :, 0] - pairs[:, :, 1]
        pairs[:, :, 0] = low
        width *= 2
    return x


def walsh(counts: DataFrame, nbits: int, key: str | None = None) -> DataFrame:
    """(code, value): the Walsh-Hadamard transform over all 2 ** nbits codes of counts(code, value), whole numbers.

    In two passes, over the low half of the bits of each setting of the high half and the other way round, so a group has
    2 ** (nbits / 2) numbers whatever the number of rows.  With ``key``, a transform for each value of that column.
    """
    low = nbits // 2
    named = [key] if key else []
    kind = f"`{key}` {counts.schema[key].dataType.simpleString()}, " if key else ""

    def over(first: int, bits: int):
        size, mask = 1 << bits, ((1 << bits) - 1) << first

        def transform(table: pa.Table) -> pa.Table:
            code = table.column("code").to_numpy()
            x = np.zeros((1, size), np.int64)
            np.add.at(x[0], (code & mask) >> first, table.column("value").to_numpy())
            rest = int(code[0]) & ~mask
            own = {k: pa.chunked_array([table.column(k).combine_chunks().take(pa.array(np.zeros(size, np.int64)))]) for k in named}
            return pa.table(own | {"code": rest | (np.arange(size) << first), "value": walsh_rows(x)[0]})

        return transform

    out = counts.select(*named, F.col("code").cast("long").alias("code"), F.col("value").cast("long").alias("value"))
    for first, bits in ((0, low), (low, nbits - low)):
        rest = F.col("code").bitwiseAND(F.lit(~(((1 << bits) - 1) << first)).cast("long"))
        out = out.groupBy(*named, rest.alias("_rest")).applyInArrow(over(first, bits), f"{kind}code long, value long")
    return out


def krawtchouk(nbits: int, d: int, w: int) -> int:
    """The sum over codes of weight d of their signs against one of weight w."""
    return sum((-1) ** j * comb(w, j) * comb(nbits - w, d - j) for j in range(min(d, w) + 1) if d - j <= nbits - w)


def _pairs_by_distance(queries: DataFrame, docs: DataFrame, nbits: int, key: str | None = None) -> DataFrame:
    """(dist, n) of all pairs of queries(code) and docs(code), or of those that agree in the column key; no pair is made.

    The numbers of pairs by the XOR of their codes are the inverse transform of the product of both sides' transforms; summed
    over codes of one weight that is a sum over weights of the product, with whole coefficients.
    """
    if not 1 <= nbits <= 24:
        raise ValueError("1 to 24 bits; distance_histogram() takes more")
    on = [*([key] if key else []), "code"]
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    count = lambda df: walsh(df.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("value")), nbits, key)
    both = count(queries).withColumnRenamed("value", "a").join(count(docs).withColumnRenamed("value", "b"), on)
    by_weight = both.groupBy(F.bit_count("code").alias("w")).agg(F.sum(exact("a") * exact("b")).alias("s"))
    table = queries.sparkSession.createDataFrame([(d, w, krawtchouk(nbits, d, w)) for d in range(nbits + 1) for w in range(nbits + 1)], "dist int, w int, k long")
    return F.broadcast(by_weight).join(table, "w").groupBy("dist").agg((F.sum(F.col("s") * F.col("k")) / F.lit(1 << nbits)).cast("long").alias("n"))  # nbits + 1 rows


def _histogram(every: DataFrame, rel: DataFrame, nbits: int) -> DataFrame:
    spine = every.sparkSession.range(0, nbits + 1).select(F.col("id").cast("int").alias("dist"))
    out = spine.join(every, "dist", "left").join(rel, "dist", "left").select("dist", F.coalesce("n_rel", F.lit(0)).cast("long").alias("n_rel"), F.coalesce("n_all", F.lit(0)).cast("long").alias("n_all"))
    return out.select("dist", "n_rel", (F.col("n_all") - F.col("n_rel")).alias("n_irrel"))


def narrow_distance_histogram(queries: DataFrame, docs: DataFrame, relevant: DataFrame, nbits: int) -> DataFrame:
    """distance_histogram() for codes of up to 24 bits (in BIGINTs under 2 ** nbits): O(nbits * 2 ** nbits) for all pairs, whatever the tables' sizes.

    The relevant pairs, which are given, are counted one by one.
    """
    rel = relevant.select("q", "d").distinct().join(queries.select("q", F.col("code").alias("q_code")), "q").join(docs.select("d", F.col("code").alias("d_code")), "d")
    rel = rel.groupBy(hamming(F.col("q_code"), F.col("d_code")).alias("dist")).agg(F.count("*").alias("n_rel"))
    return _histogram(_pairs_by_distance(queries, docs, nbits).withColumnRenamed("n", "n_all"), rel, nbits)


def narrow_label_histogram(queries: DataFrame, docs: DataFrame, nbits: int) -> DataFrame:
    """The same where rows with equal labels are relevant, of queries(code, label) and docs(code, label): neither kind of pair is made.

    A transform for each label, so labels should be few; a null label matches nothing.
    """
    rel = _pairs_by_distance(queries.withColumnRenamed("label", "_label"), docs.withColumnRenamed("label", "_label"), nbits, "_label").withColumnRenamed("n", "n_rel")
    return _histogram(_pairs_by_distance(queries, docs, nbits).withColumnRenamed("n", "n_all"), rel, nbits)


def pr_curve(counts: DataFrame, valid_only: bool = False) -> DataFrame:
    """(dist, prec, recall) from a histogram; precision is NaN where nothing is retrieved, and those rows go with valid_only.

    The windows run over the nbits + 1 rows of a histogram.
    """
    upto = Window.orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
    rel, every = F.sum("n_rel").over(upto), F.sum(F.col("n_rel") + F.col("n_irrel")).over(upto)
    whole = F.sum("n_rel").over(Window.partitionBy())
    out = counts.select("dist", F.coalesce(F.try_divide(rel.cast("double"), every.cast("double")), F.lit(float("nan"))).alias("prec"), F.coalesce(F.try_divide(rel.cast("double"), whole.cast("double")), F.lit(float("nan"))).alias("recall"))
    return out.where(~F.isnan("prec")) if valid_only else out


def hamming_pr_curve(queries: DataFrame, docs: DataFrame, relevant: DataFrame, nbits: int, valid_only: bool = False) -> DataFrame:
    """Precision and recall at each Hamming radius, pooled over all queries."""
    return pr_curve(distance_histogram(queries, docs, relevant, nbits), valid_only)
