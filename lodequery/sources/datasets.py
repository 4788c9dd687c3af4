"""Dataset views with ground-truth relevance: splits, batches, noisy pairs, mosaics, altered copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.planner import all_pairs

SPLITS = ("train", "valid", "test")
MODES = ("unsupervised", "class_relation", "relational_triplets", "relational_matrix")


def read_features(spark, path: str) -> DataFrame:
    """Parquet of (id, features, label, split); other formats of the same columns through spark.read."""
    return spark.read.parquet(path)


def hashed(*parts: Column) -> Column:
    """A number under 2**60: the first 15 hex digits of the MD5 of the parts as text, joined by colons; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, part: Column, *order, within: tuple[str, ...] = ()) -> DataFrame:
    """df with (_row, _all): each row's number from 0, and how many rows there are, in the order of part and then of ``order``.

    part cuts the table into stretches that follow each other in that order.  Only their counts are summed up
    in one task, and each is numbered by itself, so no window spans the table.  With ``within``, numbers and
    counts are those of each group of equal values of these columns.
    """
    keys = [*within, "_part"]
    cut = df.withColumn("_part", part)
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    upto = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stretch
    places = counts.select(*keys, upto.alias("_before"), F.sum("_n").over(group).alias("_all"))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return cut.join(places, keys).withColumn("_row", F.col("_before") + row).drop("_part", "_before")


def with_split(df: DataFrame, id_col: str, train: float = 0.8, valid: float = 0.1, seed: int = 0) -> DataFrame:
    """A split column from a hash of the id: stable under repartitioning."""
    u = F.pmod(hashed(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def split(df: DataFrame, name: str) -> DataFrame:
    if name not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return df.where(F.col("split") == name)


def relation(queries: DataFrame, docs: DataFrame, mode: str, seed: int = 0) -> DataFrame:
    """What a batch of queries(q, label) and docs(d, label) says of relevance, in one of MODES.

    unsupervised: (q) and nothing else; class_relation: (q, label); relational_matrix: (q, d, r) for every pair, r
    where labels are equal; relational_triplets: (q, d, other), a relevant document of each query and one that
    isn't, drawn by a hash, null where there is none.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "unsupervised":
        return queries.select("q")
    if mode == "class_relation":
        return queries.select("q", "label")
    if mode == "relational_triplets":
        return _triplets(queries, docs, seed)
    pairs = all_pairs(queries.select("q", F.col("label").alias("_lq")), docs.select("d", F.col("label").alias("_ld")))
    return pairs.select("q", "d", F.col("_lq").eqNullSafe(F.col("_ld")).alias("r"))


def _triplets(queries: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """(q, d, other): drawn as numbers, and looked up by them: documents are numbered class by class, in the order of a hash.

    The document that matters is one of the numbers of the query's class, the other one of those before or after them, so no
    pair is made.  Null labels are a class.
    """
    key = [F.col("label").isNotNull().alias("_known"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    rows = _shuffled(docs.select("d", *key), "d", seed, within=("_known", "_label"))
    sizes = docs.select(*key).groupBy("_known", "_label").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_known", "_label").rowsBetween(Window.unboundedPreceding, -1)  # a row for each class
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_every", F.sum("_size").over(Window.partitionBy()))
    numbers = rows.join(sizes, ["_known", "_label"]).select(F.col("d"), (F.col("_first") + F.col("_row")).alias("_number"))
    total = sizes.agg(F.coalesce(F.max("_every"), F.lit(0)).alias("_total"))
    asked = queries.select("q", *key).join(sizes.drop("_every"), ["_known", "_label"], "left").crossJoin(F.broadcast(total))  # one row
    size, first = F.coalesce("_size", F.lit(0)), F.coalesce("_first", F.lit(0))
    draw = lambda what, n: F.pmod(hashed(F.col("q"), F.lit(what), F.lit(seed)), F.when(n > 0, n))
    other = draw("other", F.col("_total") - size)
    asked = asked.select("q", (first + draw("match", size)).alias("_d"), F.when(other < first, other).otherwise(other + size).alias("_o"))
    own = asked.join(numbers.select("d", F.col("_number").alias("_d")), "_d", "left")
    return own.join(numbers.select(F.col("d").alias("other"), F.col("_number").alias("_o")), "_o", "left").select("q", "d", "other")


def stretch_of(x: Column, bounds: Column, n: int) -> Column:
    """How many of the n ascending bounds are at most x, by halving."""
    ends = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(bounds, mid) <= x
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(done | ~up, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | up, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), ends, halve)["lo"]


def full_batches(df: DataFrame, order_col: str, size: int, slice_rows: int = 100_000) -> DataFrame:
    """df with (batch, place): consecutive batches of exactly size rows by a numeric column, the short last one left out; nulls come first."""
    slices = max(1, -(-df.count() // slice_rows))
    bounds = sorted(set(df.approxQuantile(order_col, [k / slices for k in range(1, slices)], 0.1 / slices))) if slices > 1 else []
    part = F.lit(0)
    if bounds:
        df = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(bounds,)], "_bounds array<double>")))  # one row, a number for each slice
        part = stretch_of(F.col(order_col).cast("double"), F.col("_bounds"), len(bounds))
    out = numbered(df, F.when(F.col(order_col).isNull(), -1).otherwise(part), order_col).where(F.floor(F.col("_row") / size) < F.floor(F.col("_all") / size))
    return out.withColumn("batch", F.floor(F.col("_row") / size).cast("long")).withColumn("place", F.pmod("_row", F.lit(size)).cast("long")).drop("_all", "_row", "_bounds")


def _shuffled(df: DataFrame, id_col: str, seed: int, within: tuple[str, ...] = ()) -> DataFrame:
    """df numbered in the order of a hash of the id."""
    h = hashed(F.col(id_col), F.lit(seed))
    return numbered(df, F.shiftright(h, 50), h, id_col, within=within)


def sample_with_replacement(df: DataFrame, id_col: str, size: int, seed: int = 0) -> DataFrame:
    """(draw, row): exactly size draws of a row of df, each uniform, from hashes of the draw and the row's rank by hash."""
    n = df.count()
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(hashed(F.col("id"), F.lit(seed)), F.lit(max(n, 1))).alias("_pick"))
    return draws.join(_shuffled(df, id_col, seed), F.col("_pick") == F.col("_row")).drop("_pick", "_row", "_all")


def choose(df: DataFrame, id_col: str, size: int, seed: int = 0) -> DataFrame:
    """size different rows, by hash of the id."""
    return df.orderBy(hashed(F.col(id_col), F.lit(seed)), id_col).limit(size)


def class_pairs(df: DataFrame, id_col: str, label_col: str, order: Column | None = None) -> DataFrame:
    """(label, query_id, doc_id): the first two rows of each class in an order (by default a hash of the id)."""
    order = order if order is not None else hashed(F.col(id_col))
    rows = df.select(F.col(label_col).alias("label"), F.col(id_col).alias("id"), order.alias("o"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("o", "id"))  # tasks keep two rows of a class each before it is shuffled
    two = rows.withColumn("n", nth).where("n <= 2")
    return two.groupBy("label").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("query_id"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("doc_id"))


def class_batches(df: DataFrame, id_col: str, label_col: str, vec_col: str, batches: int, sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """(batch, label, query_id, doc_id, q, d): in every batch a random row of each class as query and one as document, with noise.

    Within a batch a document is relevant to the query of its own class and to no other, so the relevance matrix is
    the identity.  Rows are drawn with replacement, from hashes of (batch, label, seed).
    """
    rows = _shuffled(df.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("_x")), "_id", seed, within=("label",))
    sizes = rows.groupBy("label").agg(F.max("_all").alias("_size"))
    wanted = sizes.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    sides = []
    for side, name in (("q", "query_id"), ("d", "doc_id")):
        pick = F.pmod(hashed(F.col("batch"), F.col("label"), F.lit(side), F.lit(seed)), F.col("_size"))
        drawn = wanted.withColumn("_row", pick).join(rows, ["label", "_row"])
        key = F.concat_ws("/", F.col("batch").cast("string"), F.col("_id").cast("string"), F.lit(side))
        x = _with_noise(F.col("_x"), key, sigma, seed) if sigma else F.col("_x")
        sides.append(drawn.select("batch", "label", F.col("_id").alias(name), x.alias(side)))
    return sides[0].join(sides[1], ["batch", "label"]).select("batch", "label", "query_id", "doc_id", "q", "d")


def noise(key: Column, i: Column, seed: int) -> Column:
    """A standard normal number from the hash of (key, i, seed): the same wherever the row is."""
    u = lambda k: (F.pmod(hashed(key, i, F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return F.sqrt(-2 * F.ln(u(0))) * F.cos(u(1) * 6.283185307179586)


def _with_noise(x: Column, key: Column, sigma: float, seed: int) -> Column:
    return F.transform(x, lambda v, i: v + sigma * noise(key, i, seed))


def noisy(df: DataFrame, id_col: str, vec_col: str, sigma: float, seed: int) -> DataFrame:
    """(id, x): every vector with its own reproducible noise."""
    return df.select(F.col(id_col).alias("id"), _with_noise(F.col(vec_col), F.col(id_col), sigma, seed).alias("x"))


def noisy_pairs(df: DataFrame, id_col: str, vec_col: str, sigma: float, seeds: tuple[int, int] = (0xCAFE, 0xBEEF)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, documents and relevance: two noisy versions of every row, relevant to each other."""
    q, d = (noisy(df, id_col, vec_col, sigma, s) for s in seeds)
    return q.withColumnRenamed("id", "q"), d.withColumnRenamed("id", "doc"), df.select(F.col(id_col).alias("q"), F.col(id_col).alias("doc"))


def mosaics(parts: DataFrame, id_col: str, n: int, slots: int = 4, forced: int = 0, seed: int = 0) -> DataFrame:
    """(doc, slot, part): n mosaics of ``slots`` parts drawn with replacement, from hashes of (doc, slot, seed).

    Parts are numbered by the hash of their id; each of the first ``forced`` mosaics (at most as many as there are
    parts) holds the part of its own number, in a slot drawn by a hash.
    """
    rows = _shuffled(parts.select(F.col(id_col).alias("part")), "part", seed)
    count = parts.count()
    docs = parts.sparkSession.range(n).select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    own = (F.col("doc") < min(forced, count)) & (F.pmod(hashed(F.col("doc"), F.lit("own"), F.lit(seed)), F.lit(slots)) == F.col("slot"))
    drawn = F.when(own, F.col("doc")).otherwise(F.pmod(hashed(F.col("doc"), F.col("slot"), F.lit(seed)), F.lit(max(1, count))))
    return docs.withColumn("_row", drawn).join(rows.select("part", "_row"), "_row").select("doc", "slot", "part")


def tiled(tiles: Column, height: int, width: int, across: int, down: int) -> Column:
    """One image from an array of down * across images of height * width pixels, each an array by rows: by rows again."""
    rows = F.sequence(F.lit(0), F.lit(down * height - 1))

    def line(y: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda x: F.slice(F.get(tiles, F.floor(y / height).cast("int") * across + x), (F.pmod(y, F.lit(height)) * width + 1).cast("int"), F.lit(width)))
        return F.flatten(own)

    return F.flatten(F.transform(rows, line))


def mosaic_images(slots: DataFrame, images: DataFrame, height: int, width: int, across: int = 2, down: int = 2, sigma: float = 0.0, seed: int = 0xBEEF) -> DataFrame:
    """(doc, parts, x): the pixels of mosaics(doc, slot, part) of images(part, x), slots going by rows; with noise if sigma is given.

    parts are the ids by slot.  A mosaic that lacks a slot, or a part of other than height * width pixels, is an error.
    """
    n = across * down
    got = slots.join(images.select("part", "x"), "part", "left").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("slot", "part", "x"))).alias("t"))  # across * down entries
    whole = (F.size("t") == n) & F.forall("t", lambda t: F.size(t["x"]) == height * width)
    t = F.when(whole, F.col("t")).otherwise(F.raise_error(F.lit("a mosaic lacks a part")).cast(got.schema["t"].dataType))
    got = got.select("doc", t.alias("t")).select("doc", F.transform("t", lambda t: t["part"]).alias("parts"), tiled(F.transform("t", lambda t: t["x"]), height, width, across, down).alias("x"))
    return got.withColumn("x", _with_noise(F.col("x"), F.col("doc"), sigma, seed)) if sigma else got


def mosaic_batch(images: DataFrame, size: int, height: int, width: int, sigma: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of ``size`` mosaics of 2 x 2 images(part, x) and as many queries, each the part in a slot of its own mosaic; and what is relevant.

    Queries (q, part, x), documents (doc, parts, x) and their relation (q, doc, r) for every pair: r says that the mosaic
    holds the query's part.  Parts and slots are drawn by hashes of the number and the seed; noise is drawn for both sides.
    """
    slots = mosaics(images, "part", size, 4, 0, seed)
    docs = mosaic_images(slots, images, height, width, sigma=sigma, seed=seed + 1)
    own = slots.where(F.pmod(hashed(F.col("doc"), F.lit("query"), F.lit(seed)), F.lit(4)) == F.col("slot")).select(F.col("doc").alias("q"), "part")
    x = _with_noise(F.col("x"), F.col("q"), sigma, seed + 2) if sigma else F.col("x")
    queries = own.join(images.select("part", "x"), "part").select("q", "part", x.alias("x"))
    relation = all_pairs(own.select("q", "part"), docs.select("doc", "parts")).select("q", "doc", F.array_contains("parts", F.col("part")).alias("r"))
    return queries, docs, relation


def altered_relevance(queries: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """(q, doc): altered copies queries(q, key) and the originals(doc, key) they were made from, by the key that both keep."""
    return queries.select("q", key).join(originals.select("doc", key), key).select("q", "doc").distinct()


def inverted_index(df: DataFrame, doc_col: str, part_col: str) -> DataFrame:
    """(part, docs): which mosaics hold a part; the list of a part is its answer, as long as that is."""
    return df.select(F.col(part_col).alias("part"), F.col(doc_col).alias("doc")).distinct().groupBy("part").agg(F.array_sort(F.collect_list("doc")).alias("docs"))


def mosaic_relation(queries: DataFrame, mosaics: DataFrame) -> DataFrame:
    """(q, doc): mosaics(doc, part) that hold the part of queries(q, part)."""
    return queries.join(mosaics.select("doc", "part").distinct(), "part").select("q", "doc")


def match_rate(pairs: DataFrame, match_col: str = "r") -> DataFrame:
    """(rate, log_rate) of matches among pairs."""
    return pairs.agg(F.avg(F.col(match_col).cast("double")).alias("rate")).select("rate", F.ln("rate").alias("log_rate"))


def index_range(df: DataFrame, col: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Rows with lo <= col < hi, pushed down to the scan."""
    out = df if lo is None else df.where(F.col(col) >= lo)
    return out if hi is None else out.where(F.col(col) < hi)


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def image_grids(sizes: DataFrame) -> DataFrame:
    """(.., i, j, x, y) of sizes(.., h, w): the pixels of images with their centres' places, -1 to 1 on both axes; 0 on an axis of one pixel."""
    keep = [c for c in sizes.columns if c not in ("h", "w")]
    to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    pixels = sizes.where("h > 0 and w > 0").withColumn("i", to("h")).withColumn("j", to("w"))
    place = lambda c, n: F.when(F.col(n) > 1, 2.0 * F.col(c) / F.greatest(F.col(n) - 1, F.lit(1)) - 1).otherwise(0.0)
    return pixels.select(*keep, "i", "j", place("j", "w").alias("x"), place("i", "h").alias("y"))


def image_grid(spark, height: int, width: int) -> DataFrame:
    """image_grids() of one size."""
    return image_grids(spark.range(1).select(F.lit(height).alias("h"), F.lit(width).alias("w")))
