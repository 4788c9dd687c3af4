"""Exact n-gram Jaccard join, and the groups that its links form.

1. ``shingle_sets``: one pass over the texts writes, per segment of documents, the
   sorted arrays of shingle hashes, their parity bitmaps and sizes to the shared
   folder, and a row per document with hashes of its whole set and four
   min-hashes.  A document is known from then on by its place: segment * 2**32 + row.
2. Equal sets fall into one class (a grouping on 128 bits), with one representative.
3. ``star_links``: documents that share a min-hash are compared with the first of
   them; links that hold join most near copies, in linear work.
4. ``prefix_groups``: two sets with Jaccard t share one of the first
   n - ceil(t n) + 1 shingles of each in any common order.  The order puts shingles
   that a sketch of shingle counts finds frequent last, so passages that many
   documents share are no one's prefix unless the document has little else.
   Groups of documents that share a prefix shingle and aren't yet one component
   are the candidates: no pair is lost.
5. ``tile_links``: a group is compared in size bands: sorted by size, a document
   meets only those up to 1/t times its size.  The XOR of two parity bitmaps has at
   most as many bits as the sets' symmetric difference has members, which bounds
   the overlap from above; pairs that pass are intersected exactly.  Documents
   that are linked already, even indirectly, aren't compared again.
6. Components of all links give the groups.

Skew: copies collapse to a class first; a shingle whose count in the sketch is over
the usual one by more than ``tile`` is split into a grid of tiles by the documents'
salt, each pair of salts meeting in one tile, so no task holds more than two salts'
documents.  The sketch has 2**18 counters and more for larger inputs (about one for
every 4 KB of text, up to 2**24); what counters hold of rare shingles is their median
and is not counted, so copies of rare shingles don't grow with the input.
Shingles, and sets, are compared by hash (64 bits a shingle, 128 a set).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .components import FEW, components, spread_join
from .wordhash import BLANK, U64, cut_rows, mix, runs, split, window_hashes

SEEDS = [U64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
#: Counters of the sketch: at least, at most, and bytes of text for each.
SKETCH, MOST_SKETCH, SKETCH_BYTES = 1 << 18, 1 << 24, 1 << 12
STRETCH = 1 << 16
MASK = (1 << 32) - 1


def shingles(texts, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and where each text's begin."""
    w = split(texts, BLANK)
    size = np.diff(w.bounds)
    long_ = size >= n
    many = np.where(long_, size - n + 1, np.minimum(size, 1))
    begins = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    out = np.empty(begins[-1], U64)
    if long_.any():
        every = window_hashes(w.hashes, n)
        at = np.repeat(w.bounds[:-1] - begins[:-1], many) + np.arange(begins[-1])
        inside = np.repeat(long_, many)
        out[inside] = every[at[inside]]
    for k in range(1, n):  # shorter texts: the whole sequence
        own = np.flatnonzero(size == k)
        if len(own):
            out[begins[own]] = window_hashes(w.hashes[(w.bounds[own][:, None] + np.arange(k)).reshape(-1)], k)[::k]
    for a, b in zip(begins.tolist(), begins[1:].tolist()):
        out[a:b].sort()
    if len(out):
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[begins[:-1][many > 0]] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        out, begins = out[keep], upto[begins]
    return out, begins


def _width(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set of n: twice as many bits as members, a power of two."""
    return np.maximum(1, 1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64).clip(0))


def _bitmaps(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = _width(np.diff(begins))
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(at[-1], U64)
    for k, (a, b) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
        bits = int(width[k]) * 64
        parity = np.bincount((sets[a:b] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[at[k] : at[k + 1]] = np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")
    return out, at


def _per_set(f, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """f.reduceat over each set; 0 for empty ones."""
    out = np.zeros(len(begins) - 1, U64)
    full = np.flatnonzero(np.diff(begins) > 0)
    if len(full):
        out[full] = f.reduceat(values, begins[full])
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(U64).view(np.int64))


@lru_cache(2048)
def _segment(folder: str, number: int) -> dict[str, np.ndarray]:
    """A segment's arrays; tasks clear this when they end, as a mapped file keeps its space on disk."""
    return store.mapped_pack(f"{folder}/sets/{number}.pack")


def _done() -> None:
    """At the end of a task: unmap its segments and give its memory back."""
    _segment.cache_clear()
    store.release_memory()


def shingle_sets(docs: DataFrame, folder: str, n: int, segment_bytes: int, counters: int) -> DataFrame:
    """Write the segments; a row per document: place, doc_id, n, h1, h2, m0..m3; and each task's sketch of shingle counts, in stretches of 2**16."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sketch = np.zeros(counters, np.uint32)
        for k, t in enumerate(cut_rows(batches, segment_bytes)):
            if k >= 1 << 12:
                raise ValueError("a partition of over 4096 segments; raise segment_bytes or read smaller partitions")
            t = t.combine_chunks()
            ids, texts = (c.chunk(0) for c in t.columns)
            sets, begins = shingles(texts, n)
            bitmaps, bit_begins = _bitmaps(sets, begins)
            number = task << 12 | k
            store.put_pack(f"{folder}/sets/{number}.pack", sets=sets, begins=begins, bitmaps=bitmaps, bit_begins=bit_begins)
            np.add.at(sketch, (sets & U64(counters - 1)).astype(np.int64), np.uint32(1))
            columns = {"place": pa.array((number << 32) + np.arange(len(ids), dtype=np.int64)), "id": ids, "n": pa.array(np.diff(begins).astype(np.int64))}
            columns |= {"h1": _long(_per_set(np.add, mix(sets + SEEDS[0]), begins)), "h2": _long(_per_set(np.add, mix(sets ^ SEEDS[1]), begins))}
            columns |= {f"m{i}": _long(_per_set(np.minimum, mix(sets ^ s), begins)) for i, s in enumerate(SEEDS)}
            yield pa.RecordBatch.from_pydict(columns | {"part": pa.nulls(len(ids), pa.int32()), "sketch": pa.nulls(len(ids), pa.list_(pa.int32()))})
        for part in range(0, counters, STRETCH) if sketch.any() else ():
            yield pa.RecordBatch.from_pydict({c: pa.nulls(1, pa.int64()) for c in ("place", "id", "n", "h1", "h2", "m0", "m1", "m2", "m3")} | {"part": pa.array([part // STRETCH], pa.int32()), "sketch": pa.array([sketch[part : part + STRETCH].view(np.int32)], pa.list_(pa.int32()))})
        store.release_memory()

    rows = docs.mapInArrow(write, "place long, id long, n long, h1 long, h2 long, m0 long, m1 long, m2 long, m3 long, part int, sketch array<int>")
    rows.write.parquet(f"{folder}/rows")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def _compare(folder: str, a: int, b: int, percent: int) -> bool:
    """Whether the sets at two places are similar enough: bitmap bound first, then the exact overlap."""
    s, t = _segment(folder, a >> 32), _segment(folder, b >> 32)
    i, j = a & MASK, b & MASK
    x, y = s["sets"][s["begins"][i] : s["begins"][i + 1]], t["sets"][t["begins"][j] : t["begins"][j + 1]]
    least = -(-percent * (len(x) + len(y)) // (100 + percent))  # of the overlap
    if min(len(x), len(y)) < least:
        return False
    p, q = s["bitmaps"][s["bit_begins"][i] : s["bit_begins"][i + 1]], t["bitmaps"][t["bit_begins"][j] : t["bit_begins"][j + 1]]
    if len(p) != len(q):
        p, q = (_fold(p[None], len(q))[0], q) if len(p) > len(q) else (p, _fold(q[None], len(p))[0])
    if (len(x) + len(y) - int(np.bitwise_count(p ^ q).sum())) // 2 < least:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= least


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of a narrower width: the parity of a bit is that of the bits that fall on it."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def verified(pairs: DataFrame, folder: str, percent: int) -> DataFrame:
    """The (a, b) whose sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if _compare(folder, a, b, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])
        _done()

    return pairs.select("a", "b").mapInArrow(check, "a long, b long")


def star_links(reps: DataFrame, folder: str, percent: int, total: int) -> DataFrame:
    """Links of documents, total of them, to the first that shares a min-hash with them."""
    bands = reps.select("place", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("m")) for k in range(len(SEEDS))])).alias("x")).select("place", "x.*")
    first = bands.groupBy("band", "m").agg(F.min("place").alias("b"), F.count("*").alias("_c")).where("_c > 1")
    pairs = spread_join(bands, first, ["band", "m"], len(SEEDS) * total, few=FEW).where("place > b").select(F.col("place").alias("a"), "b").distinct()
    return verified(pairs, folder, percent)


def sketch_levels(counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each counter: how frequent its shingles are (0 to 15), and into how many salts a shingle of it is split."""
    usual = float(np.median(counts))
    usual += 4 * float(np.sqrt(usual)) + 1
    level = np.minimum(15, np.ceil(np.log2(np.maximum(1, counts / usual)) * 2)).astype(np.uint8)
    over = np.maximum(counts - usual, 0)
    return level, np.where(over > tile, np.ceil(over / tile), 1).astype(np.int32)


def prefix_groups(reps: DataFrame, folder: str, counts: np.ndarray, percent: int, tile: int, total: int) -> DataFrame:
    """(gid, place) of the documents that share a prefix shingle, for shingles that two at least share."""
    spark = reps.sparkSession
    level, split_in = sketch_levels(counts, tile)
    shared = spark.sparkContext.broadcast((level, split_in))  # MOST_SKETCH entries each at most
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, split_in = shared.value
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = _segment(folder, number)
                begins = s["begins"]
                tokens, owner = [], []
                rows = np.sort(np.asarray(rows, np.int64))
                for r in rows.tolist():
                    x = s["sets"][begins[r] : begins[r + 1]]
                    n = len(x)
                    take = n - -(-percent * n // 100) + 1
                    key = np.sort(level[(x & U64(len(level) - 1)).astype(np.int64)].astype(U64) << U64(60) | x >> U64(4))[:take] if n > take else x >> U64(4)
                    tokens.append(key & U64((1 << 60) - 1))
                    owner.append(np.full(len(key), r, np.uint32))
                if not tokens:
                    continue
                token, own = np.concatenate(tokens), np.concatenate(owner)
                # The lowest four bits are gone, so the sketch's place is known up to 16 entries; the largest of them counts.
                most = split_in.reshape(-1, 16).max(axis=1)[(token & U64((len(level) >> 4) - 1)).astype(np.int64)]
                if (most > 1).any():
                    hot = np.flatnonzero(most > 1)
                    m = most[hot].astype(np.int64)
                    mine = (mix(own[hot].astype(U64) + (U64(number) << U64(32))) % m.astype(U64)).astype(np.int64)
                    other = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    mine, base = np.repeat(mine, m), np.repeat(token[hot], m)
                    cell = np.minimum(mine, other).astype(U64) << U64(32) | np.maximum(mine, other).astype(U64)
                    token = np.concatenate([token[most == 1], mix(base ^ mix(cell + U64(1)))])
                    own = np.concatenate([own[most == 1], np.repeat(own[hot], m)])
                shard = (token % U64(shards)).astype(np.int32)
                order = np.lexsort((token, shard))
                token, own = token[order], own[order]
                which, starts = runs(shard[order])
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(which, pa.int32()), "segment": pa.array(np.full(len(which), number), pa.int64()),
                    "tokens": pa.array([token[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary()), "rows": pa.array([own[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary()),
                })
        _done()

    def meet(t: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, U64) for x in t.column("tokens").to_pylist()])
        place = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + (s << 32) for s, x in zip(t.column("segment").to_pylist(), t.column("rows").to_pylist())])
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.table({"gid": _long(token[keep]), "place": pa.array(place[order[keep]], pa.int64())})

    # A set of one shingle is at most half of a larger one.
    rows = reps.where("n > 1" if percent > 50 else "n > 0").select(F.shiftright("place", 32).alias("segment"), F.col("place").bitwiseAND(MASK).alias("row")).groupBy("segment").agg(F.collect_list("row").alias("rows"))  # at most a segment's rows
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be put into one task
    blocks = rows.mapInArrow(emit, "shard int, segment long, tokens binary, rows binary")
    return blocks.groupBy("shard").applyInArrow(meet, "gid long, place long")


class _Joined:
    """Labels that merge."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x], x = root, p
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def tile_links(groups: DataFrame, folder: str, percent: int, every: bool) -> DataFrame:
    """Links among the documents of each group (gid, place, root), sorted by gid; with every, also those that others imply."""

    def one(places: list[int], roots: list[int], joined: _Joined, seen: set) -> Iterator[tuple[int, int]]:
        sizes = []
        for p in places:
            s = _segment(folder, p >> 32)
            sizes.append(int(s["begins"][(p & MASK) + 1] - s["begins"][p & MASK]))
        n = np.asarray(sizes)
        order = np.lexsort((places, n))
        place, n = np.asarray(places, np.int64)[order], n[order]
        label = np.asarray([joined.find(roots[k]) for k in order], np.int64)
        if not every and (label == label[0]).all():
            return
        top = np.searchsorted(n, n * 100 // percent, "right")
        width = _width(n)
        maps: dict[tuple[int, int], np.ndarray] = {}  # of own width, and folded to narrower ones

        def bitmaps(w: int) -> np.ndarray:
            a, b = np.searchsorted(width, [w, w + 1])
            if (w, w) not in maps:
                parts = []
                for p in place[a:b].tolist():
                    s = _segment(folder, p >> 32)
                    at = s["bit_begins"][p & MASK]
                    parts.append(s["bitmaps"][at : at + w])
                maps[w, w] = np.stack(parts) if parts else np.zeros((0, w), U64)
            return maps[w, w]

        for i in range(len(place)):
            stop = int(top[i])
            if stop <= i + 1:
                continue
            near = np.arange(i + 1, stop)
            if not every:
                near = near[label[near] != label[i]]
            if not len(near):
                continue
            w = int(width[i])
            first = int(np.searchsorted(width, w))
            mine = bitmaps(w)[i - first]
            apart = np.empty(len(near), np.int64)
            for v in np.unique(width[near]).tolist():  # its own width, and wider ones folded to it
                own = width[near] == v
                if (v, w) not in maps:
                    maps[v, w] = _fold(bitmaps(v), w)
                apart[own] = np.bitwise_count(maps[v, w][near[own] - int(np.searchsorted(width, v))] ^ mine).sum(axis=1)
            both = n[near] + n[i]
            least = -(-percent * both // (100 + percent))
            for j in near[(both - apart) // 2 >= least].tolist():
                if not every and label[j] == label[i]:
                    continue
                pair = (int(min(place[i], place[j])), int(max(place[i], place[j])))
                if pair in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(pair)
                if _compare(folder, *pair, percent):
                    yield pair
                    if not every:
                        joined.join(int(label[i]), int(label[j]))
                        old = int(label[j])
                        label[label == old] = label[i]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, seen = _Joined(), set()
        held: tuple[list, list] = ([], [])
        gid = None

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[0] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            found = []
            for g, p, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if g != gid:
                    found += one(*held, joined, seen) if len(held[0]) > 1 else []
                    gid, held = g, ([], [])
                held[0].append(p)
                held[1].append(r)
            yield out(found)
        yield out(list(one(*held, joined, seen)) if len(held[0]) > 1 else [])
        _done()

    placed = groups.select("gid", "place", "root").repartition("gid").sortWithinPartitions("gid", "place")
    return placed.mapInArrow(search, "a long, b long").distinct()


class JaccardJoin:
    """The join of a table of texts with itself.

    rows: place, doc_id, n (set size), rep (place of its class's representative), for every row.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, segment_bytes: int = 1 << 24, tile: int = 1 << 15):
        if not 0 < percent <= 100:
            raise ValueError("percent must be over 0 and at most 100")
        self.spark: SparkSession = docs.sparkSession
        self.id_col, self.percent, self.tile = id_col, percent, tile
        self.folder = store.new_folder(self.spark, "jaccard")
        texts = store.whole_ids(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        size, self.total = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        counters = min(MOST_SKETCH, max(SKETCH, 1 << (int(size or 0) // SKETCH_BYTES).bit_length()))
        made = shingle_sets(texts, self.folder, n, segment_bytes, counters)
        self.made = made.where("place is not null").drop("part", "sketch")
        self.counters, self.sketches = counters, made.where("sketch is not null").select("part", "sketch")
        full = self.made.where("n > 0")
        self.classes = self._keep("classes", full.groupBy("h1", "h2", "n").agg(F.min_by(F.struct("place", "m0", "m1", "m2", "m3"), "place").alias("x"), F.count("*").alias("_c")).select("h1", "h2", "n", "x.*", "_c"))

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def clear(self) -> None:
        """Remove all files but the table of results; the other methods can't be used afterwards."""
        for name in ("sets", "rows", "classes", "stars", "first", "groups", "more", "components-1", "components-2"):
            store.remove(f"{self.folder}/{name}")

    def rows(self) -> DataFrame:
        """Every row with its class's representative (null for empty sets)."""
        rows = self.made.where("n > 0").select("place", "id", "n", "h1", "h2")
        full = spread_join(rows, self.classes.select("h1", "h2", "n", F.col("place").alias("rep"), "_c"), ["h1", "h2", "n"], self.total)
        bare = self.made.where("n = 0").select("place", "id", "n", F.lit(None).cast("long").alias("rep"))
        return full.select("place", "id", "n", "rep").union(bare).withColumnRenamed("id", self.id_col)

    def _groups(self) -> DataFrame:
        counts = np.zeros(self.counters, np.int64)
        at = F.col("part") * STRETCH + F.col("pos")
        sums = self.sketches.select("part", F.posexplode("sketch")).where("col != 0").groupBy(at.alias("at")).agg(F.sum(F.col("col").cast("long")).alias("c")).toArrow()  # as many rows as counters at most
        counts[sums["at"].to_numpy()] = sums["c"].to_numpy()
        prefix = self.classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1)).first()[0] or 0
        return prefix_groups(self.classes, self.folder, counts, self.percent, self.tile, int(prefix))

    def links(self) -> DataFrame:
        """Every link (a, b) between different classes, by their representatives, once each with a > b.

        Equal sets are one class and texts without words are none, so neither gives a link; ids play no part.
        An empty table gives none.
        """
        groups = self._groups().withColumn("root", F.col("place"))
        return tile_links(groups, self.folder, self.percent, True)

    def roots(self) -> DataFrame:
        """(place, root) of each class that is linked with others: the smallest representative that it reaches."""
        stars = self._keep("stars", star_links(self.classes, self.folder, self.percent, self.classes.count()))
        first = self._keep("first", components(stars, folder=f"{self.folder}/components-1").select(F.col("vertex").alias("place"), "root"))
        groups = self._keep("groups", self._groups())
        groups = groups.join(first, "place", "left").select("gid", "place", F.coalesce("root", "place").alias("root"))
        open_ = groups.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gid")
        more = self._keep("more", tile_links(groups.join(open_, "gid", "left_semi"), self.folder, self.percent, False))
        return components(first.select(F.col("place").alias("a"), F.col("root").alias("b")).union(more), folder=f"{self.folder}/components-2").select(F.col("vertex").alias("place"), "root")


def jaccard_groups(docs: DataFrame, **options) -> DataFrame:
    """Per row: the id, n_shingles and component_id, the smallest id reachable by links, its own included.

    Null, empty and blank texts have no shingles and are their own component, as is a row that
    links with none.  Equal texts link, and so do rows of one id with similar texts only; a null id
    takes part in links but is no candidate for the smallest id.  Extra columns don't matter; an
    empty table gives an empty result.
    """
    join = JaccardJoin(docs, **options)
    roots = join.classes.join(join.roots(), "place", "left").select("h1", "h2", "n", F.coalesce("root", "place").alias("root"), "_c")
    full = spread_join(join.made.where("n > 0").select("id", "n", "h1", "h2"), roots, ["h1", "h2", "n"], join.total)
    bare = join.made.where("n = 0").select("id", "n", F.col("place").alias("root"))
    rows = join._keep("result", full.select("id", "n", "root").union(bare))
    join.clear()
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("_c"))
    return spread_join(rows, least, "root", join.total).select(F.col("id").alias(join.id_col), F.col("n").alias("n_shingles"), "component_id")
