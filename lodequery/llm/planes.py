"""Token ids on disk as shuffled bit or byte planes.

A part file holds the ids of a run of documents in ascending id order:

    magic | chunk 0 | chunk 1 | ... | footer | footer size (u64) | magic

A chunk is a block of ``block`` ids (the last may be shorter) as unsigned
32-bit integers, transposed so that plane k holds byte k (or bit k) of every
id, each plane compressed with zstandard on its own; planes of zeros take no
bytes.  The footer has the chunk index (where each chunk begins, how many ids
it holds, the size of each plane) and the documents' ids and lengths, so a
reader fetches any document from the chunks that hold it and no others.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .bpe import encoder
from .wordhash import cut_rows

MAGIC = b"LQPLANE1"


def to_planes(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """Planes of a block, least significant first; an all-zero plane is b''."""
    flat = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        planes = [np.ascontiguousarray(flat[:, k]) for k in range(4)]
    elif mode == "bit":
        bits = np.unpackbits(flat, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    else:
        raise ValueError(f"mode must be 'byte' or 'bit', not {mode!r}")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    """The block's ids again."""
    if mode == "byte":
        flat = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                flat[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        flat = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(flat).view("<u4").reshape(-1)


class PlaneWriter:
    """Appends documents' ids to an open binary file; close() writes the footer."""

    def __init__(self, out, mode: str = "byte", block: int = 1 << 16, level: int = 3):
        if block <= 0:
            raise ValueError("block must be positive")
        self.out, self.mode, self.block = out, mode, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting, self.n_waiting, self.at = [], 0, len(MAGIC)
        self.index: list[list] = []
        self.ids, self.valid, self.sizes = [], [], []
        self.n_tokens = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, id_bytes: bytes) -> None:
        n = len(id_bytes) // 4
        self.ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.sizes.append(n)
        self.n_tokens += n
        self.waiting.append(id_bytes)
        self.n_waiting += n
        if self.n_waiting >= self.block:
            self._flush(False)

    def add_all(self, doc_ids: np.ndarray, valid: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Many documents at once, their ids one after the other."""
        self.ids += doc_ids.tolist()
        self.valid += valid.tolist()
        self.sizes += sizes.tolist()
        self.n_tokens += len(ids)
        self.waiting.append(np.ascontiguousarray(ids, "<u4").tobytes())
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, stop, self.block):
            part = ids[k : min(stop, k + self.block)]
            planes = [self.zstd.compress(p) if p else b"" for p in to_planes(part, self.mode)]
            self.index.append([self.at, len(part), [len(p) for p in planes]])
            for p in planes:
                self.out.write(p)
            self.at += sum(map(len, planes))
        self.waiting, self.n_waiting = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        head = json.dumps({"mode": self.mode, "block": self.block, "index": self.index}).encode()
        columns = [np.asarray(self.ids, "<i8"), np.asarray(self.valid, np.uint8), np.asarray(self.sizes, "<i8")]
        footer = [self.zstd.compress(x) for x in (head, *(c.tobytes() for c in columns))]
        blob = struct.pack("<4Q", *map(len, footer)) + b"".join(footer)
        self.out.write(blob + struct.pack("<Q", len(blob)) + MAGIC)


class PlaneReader:
    """Reads a part file through its chunk index."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 16)
        size, magic = struct.unpack("<Q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError("not a plane file, or cut short")
        f.seek(end - 16 - size)
        blob = f.read(size)
        sizes, at, parts = struct.unpack("<4Q", blob[:32]), 32, []
        zstd = self.zstd = zstandard.ZstdDecompressor()
        for n in sizes:
            parts.append(zstd.decompress(blob[at : at + n]))
            at += n
        head = json.loads(parts[0])
        self.mode, self.block, self.index = head["mode"], head["block"], head["index"]
        self.ids, self.valid, self.sizes = (np.frombuffer(p, t) for p, t in zip(parts[1:], ("<i8", np.uint8, "<i8")))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index[k]
        self.f.seek(at)
        raw, planes, i = self.f.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.zstd.decompress(raw[i : i + s]) if s else b"")
            i += s
        return from_planes(planes, n, self.mode)

    def read(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of the part, from the chunks that hold them."""
        stop = min(stop, int(self.starts[-1]))
        if start >= stop:
            return np.zeros(0, "<u4")
        first = start // self.block
        got = np.concatenate([self.chunk(k) for k in range(first, (stop - 1) // self.block + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the part, ids) of each document, each chunk decoded once."""
        held, held_from, k = np.zeros(0, "<u4"), 0, 0
        for doc, ok, start, n in zip(self.ids.tolist(), self.valid.tolist(), self.starts.tolist(), self.sizes.tolist()):
            pieces, have = [held[start - held_from : start - held_from + n]], max(0, min(n, held_from + len(held) - start))
            while have < n:
                held_from += len(held)
                held, k = self.chunk(k), k + 1
                pieces.append(held[: n - have])
                have += len(pieces[-1])
            yield (doc if ok else None), start, np.concatenate(pieces) if len(pieces) > 1 else pieces[0]


def write_planes(
    docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, mode: str = "byte", block: int = 1 << 16, level: int = 3, part_bytes: int = 1 << 27, order: list[Column] | None = None
) -> list[dict]:
    """Encode every text, append end_id, and write part files of about part_bytes of text below folder.

    Documents are in ascending id order, or in that of the columns ``order``.  Null ids come first; rows
    with equal ids are ordered by text.  Null and empty texts are just the end id.  Ids must be whole
    numbers.  Returns the manifest, one entry per part in order: part, path, n_docs, n_tokens and start
    (ids in all parts before it).  An empty table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, units = f"{folder}/part-{part:06d}.planes", encoder(tokenizer_path)
        tables = cut_rows(batches, 1 << 21)
        if (t := next(tables, None)) is None:
            return
        with store.AtomicFile(path) as out:
            writer = PlaneWriter(out, mode, block, level)
            while t is not None:
                ids, at = units.encode(t.column(1))
                docs_of = t.column(0).combine_chunks()
                writer.add_all(docs_of.fill_null(0).to_numpy(zero_copy_only=False), docs_of.is_valid().to_numpy(zero_copy_only=False), np.diff(at) + 1, np.insert(ids, at[1:], np.uint32(end_id)))
                t = next(tables, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [path], "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})
        store.release_memory()

    id_ = F.col(id_col).cast("long")
    rows = store.whole_ids(docs, id_col).select(id_.alias("id"), F.col(text_col).cast("string").alias("text"), *[c.alias(f"order{k}") for k, c in enumerate(order or [])])
    first = [F.col(f"order{k}") for k in range(len(order))] if order else [F.col("id").asc_nulls_first()]
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # One part at least for part_bytes; more only as long as they keep the tasks of a small table busy.
    n = max(1, -(-size // part_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (1 << 22)))
    placed = rows.repartitionByRange(n, *first, F.xxhash64("text")).sortWithinPartitions(*first, F.xxhash64("text"), "text")
    made = placed.select("id", "text").mapInArrow(write, "part long, path string, n_docs long, n_tokens long").collect()  # a row for each file
    manifest, start = [], 0
    for r in sorted(made, key=lambda r: r.part):
        manifest.append(r.asDict() | {"start": start})
        start += r.n_tokens
    return manifest


def read_planes(spark: SparkSession, manifest: list[dict], *, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the part files: id, start, n_tokens, ids_crc32; an empty manifest gives no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with store.open_random(path) as f:
                    rows = []
                    for doc, start, ids in PlaneReader(f).documents():
                        rows.append((doc, base + start, len(ids), zlib.crc32(np.ascontiguousarray(ids).tobytes())))
                        if len(rows) >= 1 << 14:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "start", "n_tokens", "ids_crc32"])

    schema = "path string, start long"
    if not manifest:
        parts = spark.createDataFrame([], schema)
    else:
        parts = spark.createDataFrame(spark.sparkContext.parallelize([(m["path"], m["start"]) for m in manifest], len(manifest)), schema)
    return parts.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def plane_output(docs: DataFrame, tokenizer_path: str, *, folder: str | None = None, **options) -> DataFrame:
    """write_planes() then read_planes(): what the files hold of each document.

    Null ids and texts, repeated rows, clashing extra columns and empty tables: see write_planes().
    """
    spark = docs.sparkSession
    folder = folder or store.new_folder(spark, "planes", keep=True)  # the files are what is wanted
    return read_planes(spark, write_planes(docs, folder, tokenizer_path, **options), id_col=options.get("id_col", "doc_id"))
