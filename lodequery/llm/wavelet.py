"""Ranked lexical search: a dual-sorted wavelet tree per shard, searched best first.

A shard holds the postings of about ``shard_bytes`` of text.  Its documents are numbered by
ascending id and cut into blocks.  Each term's postings stand in order of falling impact,
and all terms' lists, one after the other, are the sequence of a wavelet tree over block numbers (kept
as a wavelet matrix: a bit vector with rank counts for each level).  So a term's list is a range of the
top level, a node of the tree is an interval of document numbers, and each step down maps a
term's range to its postings in either half of the interval, still in order of impact: the first
of a range is the most that the term can add to any document there.

A query keeps a heap of nodes by the sum of those bounds.  The best node is opened: its terms'
ranges are mapped to both children, or, at a block, its postings are added up and its documents go to
the heap with their scores.  Ties go to the lower interval, so what comes off the heap as a
document is the next of the result, and everything under nodes that never come up is not looked at.
All queries of a block of queries open their best nodes together, in one set of array operations.

The weights of terms need document frequencies over all shards; these are summed for the terms of the
queries by a grouped shuffle and stored beside each block of queries.  A task carries the k-th scores that it
has found from shard to shard as a floor.  Terms are compared by 64-bit hash.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .wordhash import ALNUM, U64, cut_rows, split, text_bytes

#: Documents of a block are 2 to this power.
LEAF_BITS = 4
#: Nodes that a query opens at once.
TOGETHER = 4
#: Bytes of text that are counted at once.
SLICE = 1 << 20


def word_counts(texts) -> np.ndarray:
    """Terms of every text, with repeats."""
    data, offs = text_bytes(texts)
    inside = ALNUM[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    starts[begins] = inside[begins]
    return np.diff(np.concatenate([[0], np.cumsum(starts)])[offs])


def length_norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 75 + (75 * n * n_docs) div n_terms of each document, with no overflow."""
    sizes, which = np.unique(n, return_inverse=True)
    return np.asarray([25 + 75 * int(x) * n_docs // n_terms for x in sizes], np.int64)[which.reshape(-1)]


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def build(ids: np.ndarray, valid: np.ndarray, texts, n_docs: int, n_terms: int, leaf_bits: int = LEAF_BITS) -> dict[str, np.ndarray]:
    """The arrays of a shard of these documents."""
    w = split(texts, ALNUM)
    order = np.lexsort((ids, ~valid))
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    n = np.diff(w.bounds)
    terms, which = np.unique(w.hashes, return_inverse=True)
    keys, tf = np.unique(which.reshape(-1) * len(ids) + np.repeat(number, n), return_counts=True)
    term, doc = np.divmod(keys, max(1, len(ids)))
    norm = length_norms(n[order], n_docs, n_terms) if n_terms else np.zeros(len(ids), np.int64)
    impact = (10**9 * tf) // (1000 * tf + 8 * norm[doc])
    by = np.lexsort((doc, -impact, term))
    term, doc, impact = term[by], doc[by], impact[by]
    n_blocks = max(1, -(-len(ids) >> leaf_bits))
    levels, words = (n_blocks - 1).bit_length(), len(doc) // 64 + 1
    bits, zeros = np.zeros((levels, words), U64), np.zeros(levels, np.int64)
    block, low = doc >> leaf_bits, (doc & ((1 << leaf_bits) - 1)).astype(np.uint16)
    for k in range(levels):
        bit = ((block >> (levels - 1 - k)) & 1).astype(bool)
        bits[k] = np.frombuffer(np.packbits(bit, bitorder="little").tobytes().ljust(8 * words, b"\0"), U64)
        zeros[k] = len(bit) - bit.sum()
        block, low = (np.concatenate([x[~bit], x[bit]]) for x in (block, low))
    ranks = np.zeros((levels, words), np.uint32 if len(doc) < 1 << 32 else np.int64)
    ranks[:, 1:] = np.cumsum(np.bitwise_count(bits), axis=1)[:, :-1]
    return {"terms": terms, "begins": np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int64), "impacts": impact.astype(np.int32), "bits": bits, "ranks": ranks, "zeros": zeros, "low": low, "ids": ids[order], "valid": valid[order], "leaf_bits": np.array([leaf_bits])}


class Tree:
    """A shard, opened: impacts are carried down to every level along the bits."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.leaf_bits, self.levels = int(arrays["leaf_bits"][0]), len(self.zeros)
        carried = np.empty((self.levels + 1, len(self.impacts)), np.int32)
        carried[0] = self.impacts
        for k in range(self.levels):
            bit = np.unpackbits(self.bits[k].view(np.uint8), bitorder="little", count=len(self.impacts)).astype(bool)
            carried[k + 1, : self.zeros[k]], carried[k + 1, self.zeros[k] :] = carried[k, ~bit], carried[k, bit]
        self.carried = carried

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's postings begin and end at the top level."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        begin = self.begins[k]
        return begin, np.where(self.terms[k] == terms, self.begins[k + 1], begin)

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many bits are set before a place of a level."""
        word, bit = at >> 6, (at & 63).astype(U64)
        return self.ranks[level, word].astype(np.int64) + np.bitwise_count(self.bits[level, word] & ((U64(1) << bit) - U64(1)))

    def down(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ranges of a level as ranges of the next, in the lower and the upper half."""
        a, b = self.ones(level, lo), self.ones(level, hi)
        return [(lo - a, hi - b), (self.zeros[level] + a, self.zeros[level] + b)]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, document number and score of each query's k best documents that score at least floor and above 0.

        A query is the weights of its terms and the ranges of their postings.
        """
        heaps: list[list] = []
        for q, (weights, lo, hi) in enumerate(queries):
            bound = int((weights * self.carried[0, lo]).sum()) if len(lo) else 0
            heaps.append([(-bound, 0, 0, weights, lo, hi)] if bound > 0 and bound >= floor[q] else [])
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        active = [q for q in range(len(queries)) if heaps[q]]
        while active:
            opened, owner = [], []
            for q in active:
                heap, own = heaps[q], found[q]
                while heap and heap[0][2] < 0 and len(own) < k:  # a document: it is the next best
                    score, doc, _ = heapq.heappop(heap)
                    own.append((doc, -score))
                if len(own) < k:
                    for _ in range(TOGETHER):
                        if not heap or heap[0][2] < 0:
                            break
                        opened.append(heapq.heappop(heap))
                        owner.append(q)
            if opened:
                deepest = [i for i, x in enumerate(opened) if x[2] == self.levels]
                others = [i for i, x in enumerate(opened) if x[2] < self.levels]
                if deepest:
                    self._blocks([opened[i] for i in deepest], [owner[i] for i in deepest], heaps, floor)
                if others:
                    self._children([opened[i] for i in others], [owner[i] for i in others], heaps, floor)
            active = [q for q in active if heaps[q] and len(found[q]) < k]
        which = np.repeat(np.arange(len(queries)), [len(x) for x in found])
        docs, scores = (np.asarray([x[c] for own in found for x in own], np.int64) for c in (0, 1))
        return which, docs, scores

    def _children(self, nodes: list[tuple], owner: list[int], heaps: list[list], floor: np.ndarray) -> None:
        """Put both halves of each node on its query's heap."""
        size = np.asarray([len(x[3]) for x in nodes])
        weights, lo, hi = (np.concatenate([x[c] for x in nodes]) for c in (3, 4, 5))
        level = np.repeat(np.asarray([x[2] for x in nodes]), size)
        starts = np.cumsum(size) - size
        for half, (a, b) in enumerate(self.down(level, lo, hi)):
            some = a < b
            gain = np.where(some, weights * self.carried[level + 1, np.minimum(a, self.carried.shape[1] - 1)], 0)
            bounds = np.add.reduceat(gain, starts).tolist()
            ends = np.cumsum(np.add.reduceat(some.astype(np.int64), starts)).tolist()
            w, a, b, at = weights[some], a[some], b[some], 0
            for (_, first, deep, *_), q, bound, end in zip(nodes, owner, bounds, ends):
                if bound > 0 and bound >= floor[q]:
                    heapq.heappush(heaps[q], (-bound, first + (half << (self.leaf_bits + self.levels - deep - 1)), deep + 1, w[at:end], a[at:end], b[at:end]))
                at = end

    def _blocks(self, nodes: list[tuple], owner: list[int], heaps: list[list], floor: np.ndarray) -> None:
        """Put the documents of each block on its query's heap, with their scores."""
        size = [len(x[3]) for x in nodes]
        weights, lo, hi = (np.concatenate([x[c] for x in nodes]) for c in (3, 4, 5))
        many = hi - lo
        at = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
        place = (np.repeat(np.repeat(np.arange(len(nodes)), size), many) << self.leaf_bits) + self.low[at]
        scores = np.zeros(len(nodes) << self.leaf_bits, np.int64)
        np.add.at(scores, place, np.repeat(weights, many) * self.carried[self.levels, at])
        least = np.repeat(np.maximum(floor[owner], 1), 1 << self.leaf_bits)
        for p in np.flatnonzero(scores >= least).tolist():
            i = p >> self.leaf_bits
            heapq.heappush(heaps[owner[i]], (-int(scores[p]), nodes[i][1] + p - (i << self.leaf_bits), -1))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 24, leaf_bits: int = LEAF_BITS, folder: str | None = None) -> tuple[str, int, int]:
    """Index every document: the index's folder (with its list of shards in shards/), the documents with terms, and all their terms.

    Null texts have no terms and null ids stay null, after all others; ids must be whole numbers; an empty table has no shards.
    """
    spark = docs.sparkSession
    folder = folder or store.new_folder(spark, "wavelet")
    rows = store.whole_ids(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cut_rows(batches, SLICE):
            n = word_counts(t.column("text"))
            yield pa.RecordBatch.from_pydict({"docs": pa.array([int((n > 0).sum())], pa.int64()), "terms": pa.array([int(n.sum())], pa.int64())})

    total = rows.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (x or 0 for x in total)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cut_rows(batches, shard_bytes):
            path = f"{folder}/trees/{uuid.uuid4().hex}.pack"
            t = t.combine_chunks()
            ids, texts = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns)
            store.put_pack(path, **build(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), texts, n_docs, n_terms, leaf_bits))
            yield pa.RecordBatch.from_pydict({"path": [path], "n_docs": pa.array([len(ids)], pa.int64())})
        store.release_memory()

    rows.mapInArrow(write, "path string, n_docs long").write.parquet(f"{folder}/shards")  # only what successful tasks wrote is listed
    return folder, n_docs, n_terms


def write_queries(items: DataFrame, folder: str, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 1 << 22) -> str:
    """The items' terms in blocks; the folder that lists them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cut_rows(batches, block_bytes):
            path = f"{folder}/blocks/{uuid.uuid4().hex}.pack"
            t = t.combine_chunks()
            ids, texts = (c.chunk(0) for c in t.columns)
            w = split(texts, ALNUM)
            terms, which = np.unique(w.hashes, return_inverse=True)
            item = np.repeat(np.arange(len(ids)), np.diff(w.bounds))
            keys, times = np.unique(item * max(1, len(terms)) + which.reshape(-1), return_counts=True)
            names = [x.encode() if x is not None else b"" for x in ids.to_pylist()]
            store.put_pack(
                path, terms=terms, term=keys % max(1, len(terms)), times=times, begins=np.searchsorted(keys // max(1, len(terms)), np.arange(len(ids) + 1)),
                valid=ids.is_valid().to_numpy(zero_copy_only=False), names=np.frombuffer(b"".join(names), np.uint8), name_ends=np.cumsum([0, *map(len, names)]),
            )
            yield pa.RecordBatch.from_pydict({"path": [path]})

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(write, "path string").write.parquet(f"{folder}/list")
    return f"{folder}/list"


def _listed(folder: str) -> list[str]:
    """The paths in a listing, read where they are needed."""
    fs, path = store._resolve(folder)
    return sorted(pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["path"]).column("path").to_pylist())


def _shards(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema("path string, n_docs long").parquet(f"{index}/shards").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def put_weights(spark: SparkSession, index: str, queries: str, n_docs: int) -> None:
    """Store the weights of each block's terms beside it, from the frequencies in all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(path, np.asarray(store.mapped_pack(path)["terms"])) for path in _listed(queries)]
        for b in batches:
            for shard in b.column("path").to_pylist():
                arrays = store.mapped_pack(shard)
                for path, terms in blocks:
                    begin, end = Tree.lookup(_Lists(arrays), terms)
                    own = np.flatnonzero(end > begin)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([path] * len(own), pa.string()), "term": pa.array(own, pa.int64()), "df": pa.array((end - begin)[own], pa.int64())})

    def put(key, t):
        path = key[0].as_py()
        weights = np.zeros(len(store.mapped_pack(path)["terms"]), np.int64)
        weights[t.column("term").to_numpy()] = [weight(x, n_docs) for x in t.column("df").to_pylist()]
        store.put_pack(f"{path}.weights", weights=weights)
        return pa.table({"path": [path]})

    dfs = _shards(spark, index).select("path").mapInArrow(count, "block string, term long, df long").groupBy("block", "term").agg(F.sum("df").alias("df"))
    dfs.groupBy("block").applyInArrow(put, "path string").write.parquet(f"{queries}-weights")  # a group is the terms of a block of queries at most


class _Lists:
    """The part of a shard that says where lists begin."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.terms, self.begins = arrays["terms"], arrays["begins"]


def rank(spark: SparkSession, index: str, queries: str, *, k: int = 10) -> DataFrame:
    """(block, row, item, doc, score, rank): the k best documents of each query of the listed blocks, whose weights are stored."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {path: (store.mapped_pack(path), store.mapped_pack(f"{path}.weights")["weights"]) for path in _listed(f"{queries}-weights")}
        best = {path: np.zeros((len(b["valid"]), k), np.int64) for path, (b, _) in blocks.items()}  # the highest scores so far in this task
        for batch in batches:
            for shard in batch.column("path").to_pylist():
                tree = Tree(store.mapped_pack(shard))
                for path, (b, weights) in blocks.items():
                    begin, end = tree.lookup(b["terms"])
                    worth = weights[b["term"]] * b["times"]
                    lo, hi = begin[b["term"]], end[b["term"]]
                    own = (lo < hi) & (worth > 0)
                    asked = [(worth[s][own[s]], lo[s][own[s]], hi[s][own[s]]) for s in map(slice, b["begins"].tolist(), b["begins"].tolist()[1:])]
                    row, doc, score = tree.search(asked, best[path][:, -1], k)
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    new = np.zeros_like(best[path])
                    new[row, nth] = score
                    best[path] = -np.sort(-np.concatenate([best[path], new], axis=1), axis=1)[:, :k]
                    names, ends = b["names"].tobytes(), b["name_ends"].tolist()
                    item = [names[ends[r] : ends[r + 1]].decode() if b["valid"][r] else None for r in row.tolist()]
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([path] * len(row), pa.string()), "row": pa.array(row, pa.int64()), "item": pa.array(item, pa.string()),
                        "doc": pa.array(tree.ids[doc], pa.int64(), mask=~tree.valid[doc]), "score": pa.array(score, pa.int64()),
                    })
                del tree
        store.release_memory()

    found = _shards(spark, index).select("path").mapInArrow(search, "block string, row long, item string, doc long, score long")
    best_first = Window.partitionBy("block", "row").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 1 << 24, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """Per item row: the item's id, rank (from 1), the id and the score of its k best documents with a score above 0; fewer if there are fewer.

    Null and empty texts have no terms, so such items have no rows and such documents are in none.  A null item
    id stays null; documents of null id rank after others of equal score; repeated item rows are answered each, repeated documents
    are candidates each.  Either table may be empty; other columns don't matter; document ids must be whole numbers.
    """
    spark = docs.sparkSession
    index, n_docs, _ = build_index(docs, id_col=id_col, text_col=text_col, shard_bytes=shard_bytes, leaf_bits=leaf_bits)
    queries = write_queries(items, f"{index}/queries", id_col=item_id_col, text_col=item_text_col)
    put_weights(spark, index, queries, n_docs)
    got = rank(spark, index, queries, k=k)
    return got.select(F.col("item").cast(items.schema[item_id_col].dataType).alias(item_id_col), "rank", F.col("doc").alias(id_col), "score")


def search_sql(k: int = 10) -> str:
    """The same in DuckDB SQL."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, {words} AS w FROM benchmark),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) AS q GROUP BY ALL),
q AS (SELECT i, term, count(*)::BIGINT AS times FROM (SELECT i, unnest(w) AS term FROM i) AS q GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
f AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, s GROUP BY term, n),
c AS (SELECT i, doc_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0) AS q JOIN i USING (i) WHERE rank <= {k}
"""
