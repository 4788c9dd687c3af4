"""A distributed positional inverted index, and exact phrase search on it.

The documents are indexed in segments of about ``segment_bytes`` of text, each a
file below the shared folder that holds, sorted by term, the positions of every
word of its documents.  Searches take the phrases in blocks, also files of the
shared folder, so neither side is ever gathered in one process: a task maps a
segment, then one block after the other.

Within a segment a phrase is looked up from its rarest term: that term's
postings, less the term's offset in the phrase, are the candidates; they are
intersected with the next rarer term's offset-adjusted postings, and so on.
Phrases with a term that the segment lacks cost nothing further.  Terms are
compared by 64-bit hash.

A segment is never larger than its largest document or ``segment_bytes``; a hot
source, a phrase found in every document or thousands of copies only make
postings longer, which are walked in steps of ``STEP`` candidates.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .wordhash import ALNUM, U64, cut_rows, runs, split

#: Candidate positions held at once.
STEP = 1 << 20


def postings(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms (sorted hashes), where each one's postings begin, and all positions by term and then place."""
    n = len(hashes)
    low = U64((1 << max(1, int(n - 1).bit_length() if n else 1)) - 1)
    keys = np.sort((hashes & ~low) | np.arange(n, dtype=U64))
    at = (keys & low).astype(np.int64)
    terms, starts = runs(hashes[at])
    if len(terms) > 1 and not (terms[1:] > terms[:-1]).all():  # two terms that agree in all high bits
        at = np.argsort(hashes, kind="stable")
        terms, starts = runs(hashes[at])
    return terms, starts, at.astype(np.uint32 if n < 1 << 32 else np.int64)


def _contains(positions: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether wanted[i] is in the sorted positions[lo[i]:hi[i]]."""
    end, lo, hi = hi, lo.copy(), hi.copy()
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = positions[np.minimum(mid, len(positions) - 1)] < wanted
        less &= lo < hi
        lo = np.where(less, mid + 1, lo)
        hi = np.where(less, hi, mid)
    return (lo < end) & (positions[np.minimum(lo, len(positions) - 1)] == wanted)


class Segment:
    """One segment of the index."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's postings begin and end here; empty if it has none."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        begin = self.begins[k].astype(np.int64)
        return begin, np.where(self.terms[k] == terms, self.begins[k + 1], begin).astype(np.int64)

    def phrases(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Occurrences of the phrases words[at[i] : at[i] + length] as (i, position) arrays.

        begin and end are the postings of each of words, as lookup() gives them.
        """
        spans = at[:, None] + np.arange(length)
        counts = (end - begin)[spans]
        alive = np.flatnonzero(counts.min(axis=1, initial=1 << 62) > 0)
        if not len(alive):
            return
        rarity = np.argsort(counts[alive], axis=1, kind="stable")
        first = np.take_along_axis(spans[alive], rarity, 1)
        size = (end - begin)[first[:, 0]]
        upto = np.cumsum(size)
        k = 0
        while k < len(alive):
            stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + STEP, "right")))
            rows = np.repeat(np.arange(k, stop), size[k:stop])
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(size[k:stop]) - size[k:stop], size[k:stop])
            for part in range(0, len(rows), STEP):
                r = rows[part : part + STEP]
                place = self.positions[begin[first[r, 0]] + nth[part : part + STEP]].astype(np.int64) - rarity[r, 0]
                keep = (place >= 0) & (place + length <= len(self.positions))
                r, place = r[keep], place[keep]
                for j in range(1, length):
                    if not len(r):
                        break
                    t = first[r, j]
                    keep = _contains(self.positions, begin[t], end[t], place + rarity[r, j])
                    r, place = r[keep], place[keep]
                doc = np.searchsorted(self.doc_begins, place, "right") - 1
                keep = place + length <= self.doc_begins[doc + 1]
                if keep.any():
                    yield alive[r[keep]], place[keep]
            k = stop

    def near(self, terms: np.ndarray, width: int) -> list[tuple[int, int]]:
        """Spans (first and last position) of at most width words of one document that hold all terms and start with one of them."""
        begin, end = self.lookup(terms)
        if not len(terms) or (begin == end).any():
            return []
        lists = [np.asarray(self.positions[a:b], np.int64) for a, b in zip(begin, end)]
        left = np.unique(np.concatenate(lists))
        last = left.copy()
        for x in lists:
            k = np.searchsorted(x, left)
            last = np.maximum(last, np.where(k < len(x), x[np.minimum(k, len(x) - 1)], 1 << 62))
        doc_end = self.doc_begins[np.searchsorted(self.doc_begins, left, "right")]
        ok = (last - left < width) & (last < doc_end)
        return list(zip(left[ok].tolist(), last[ok].tolist()))


def segment_arrays(ids: pa.Array, texts: pa.Array) -> dict[str, np.ndarray]:
    """The arrays of a segment of these documents."""
    w = split(texts, ALNUM)
    terms, begins, positions = postings(w.hashes)
    return {"terms": terms, "begins": begins, "positions": positions, "doc_begins": w.bounds.astype(np.int64), "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), "valid": ids.is_valid().to_numpy(zero_copy_only=False)}


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 1 << 24, folder: str | None = None) -> str:
    """Index every document; returns the index's folder, with its list of segments in segments/.

    Null texts have no words and null ids stay null; ids must be whole numbers; an empty table has no segments.
    """
    spark = docs.sparkSession
    folder = folder or store.new_folder(spark, "phrases")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cut_rows(batches, segment_bytes):
            path = f"{folder}/postings/{uuid.uuid4().hex}.pack"
            t = t.combine_chunks()
            ids, texts = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns)
            store.put_pack(path, **segment_arrays(ids, texts))
            yield pa.RecordBatch.from_pydict({"path": [path], "n_docs": pa.array([len(ids)], pa.int64())})
        store.release_memory()

    rows = store.whole_ids(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(write, "path string, n_docs long").write.parquet(f"{folder}/segments")  # only what successful tasks wrote is listed
    return folder


def write_phrases(items: DataFrame, folder: str, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 1 << 22) -> list[str]:
    """The items' words as blocks below folder; the paths of the blocks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cut_rows(batches, block_bytes):
            path = f"{folder}/{uuid.uuid4().hex}.pack"
            t = t.combine_chunks()
            ids, texts = (c.chunk(0) for c in t.columns)
            w = split(texts, ALNUM)
            names = [x.encode() if x is not None else b"" for x in ids.to_pylist()]
            terms, inverse = np.unique(w.hashes, return_inverse=True)
            store.put_pack(path, words=w.hashes, terms=terms, inverse=inverse.reshape(-1).astype(np.int32), bounds=w.bounds.astype(np.int64), valid=ids.is_valid().to_numpy(zero_copy_only=False), names=np.frombuffer(b"".join(names), np.uint8), name_ends=np.cumsum([0, *map(len, names)]))
            yield pa.RecordBatch.from_pydict({"path": [path]})

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return sorted(r.path for r in rows.mapInArrow(write, "path string").collect())  # a path for each block


class Windows:
    """The windows of a block of items: every run of ``window`` words of an item, or all of a shorter one."""

    def __init__(self, block: dict[str, np.ndarray], window: int):
        self.words, bounds = np.asarray(block["words"]), np.asarray(block["bounds"])
        names, ends = block["names"].tobytes(), block["name_ends"].tolist()
        self.names = [names[a:b].decode() if ok else None for a, b, ok in zip(ends, ends[1:], block["valid"].tolist())]
        self.terms, self.inverse = np.asarray(block["terms"]), np.asarray(block["inverse"])
        n = np.diff(bounds)
        many = np.where(n > window, n - window + 1, np.minimum(n, 1))
        self.item = np.repeat(np.arange(len(n)), many)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[:-1], many)
        self.length = np.repeat(np.minimum(n, window), many)
        self.by_length = [(int(k), np.flatnonzero(self.length == k)) for k in np.unique(self.length)]


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", segment_bytes: int = 1 << 24) -> DataFrame:
    """Per document row: the id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if it lies in an occurrence of a window of an item.  Null and empty texts
    have no words; items without words have no windows; a null item id marks words but is neither
    counted nor listed; repeated item ids count once; repeated document rows give a row each.
    Either table may be empty; other columns don't matter.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col=id_col, text_col=text_col, segment_bytes=segment_bytes)
    blocks = write_phrases(items, f"{index}/items", id_col=item_id_col, text_col=item_text_col)
    return hits(spark, index, blocks, window=window, id_col=id_col)


def segments(spark: SparkSession, index: str) -> DataFrame:
    """A row for each segment, spread over the tasks."""
    return spark.read.schema("path string, n_docs long").parquet(f"{index}/segments").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def hits(spark: SparkSession, index: str, blocks: list[str], *, window: int = 10, id_col: str = "doc_id") -> DataFrame:
    """contamination() of an index by blocks of items."""
    if window < 1:
        raise ValueError("window must be positive")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Windows] = {}

        def windows(path: str) -> Windows:
            if path not in kept:
                if len(kept) >= 8:
                    kept.clear()
                kept[path] = Windows(store.mapped_pack(path), window)
            return kept[path]

        for b in batches:
            for path in b.column("path").to_pylist():
                segment = Segment(store.mapped_pack(path))
                n_docs, n_words = len(segment.ids), len(segment.positions)
                change = np.zeros(n_words + 1, np.int32)
                found: dict[int, set[str]] = {}
                for block in blocks:
                    w = windows(block)
                    begin, end = (x[w.inverse] for x in segment.lookup(w.terms))
                    for length, own in w.by_length:
                        pairs = []
                        for k, place in segment.phrases(w.words, begin, end, w.at[own], length):
                            change[: n_words + 1] += np.bincount(place, minlength=n_words + 1).astype(np.int32)
                            change[: n_words + 1] -= np.bincount(place + length, minlength=n_words + 1).astype(np.int32)
                            doc = np.searchsorted(segment.doc_begins, place, "right") - 1
                            pairs.append(np.unique(doc * len(w.names) + w.item[own[k]]))
                        for p in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
                            if (name := w.names[p % len(w.names)]) is not None:
                                found.setdefault(p // len(w.names), set()).add(name)
                upto = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
                n_hit = np.diff(upto[segment.doc_begins])
                digest = [hashlib.sha256(",".join(sorted(found.get(d, ()))).encode()).hexdigest() for d in range(n_docs)]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(segment.ids, pa.int64(), mask=~segment.valid), "n_words": pa.array(np.diff(segment.doc_begins), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                    "n_items": pa.array([len(found.get(d, ())) for d in range(n_docs)], pa.int64()), "items_sha256": digest, "contaminated": pa.array(n_hit > 0),
                })

    return segments(spark, index).select("path").mapInArrow(search, "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumnRenamed("id", id_col)


def near_matches(spark: SparkSession, index: str, blocks: list[str], *, width: int, id_col: str = "doc_id") -> DataFrame:
    """Where all words of an item lie, in any order, within width words of one document: id, item_id, first, last (word numbers in the document).

    A row for each span of at most width words that starts with one of the item's words and ends with the last
    of them to come; spans may overlap.  Equal words of an item count once.  Items and documents without words
    match nothing; null ids stay null; repeated rows match each; without items or documents there are no rows.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                segment = Segment(store.mapped_pack(path))
                for block in blocks:
                    w = Windows(store.mapped_pack(block), 1 << 62)
                    for item, at, n in zip(w.item, w.at, w.length):
                        rows = []
                        for first, last in segment.near(np.unique(w.words[at : at + n]), width):
                            d = int(np.searchsorted(segment.doc_begins, first, "right")) - 1
                            rows.append((int(segment.ids[d]) if segment.valid[d] else None, w.names[item], first - int(segment.doc_begins[d]), last - int(segment.doc_begins[d])))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["id", "item_id", "first", "last"])

    return segments(spark, index).select("path").mapInArrow(search, "id long, item_id string, first long, last long").withColumnRenamed("id", id_col)
