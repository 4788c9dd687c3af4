"""A data source for images in packed files: format("images") reads and writes folders of them, in parallel.

A folder has one sub-folder for each split, and in those files of images in the IDX format, which is public and
plain: a magic number, sizes, and numbers big-endian by rows.  Beside X.idx3 of pixels lies X.idx1 of labels and, where the ids
aren't just 0, 1, .. in the order of the files, X.ids of those, as pairs of 32-bit words.  Files are cut into ranges of images, each a partition that
seeks to its place, so a large file is read by many tasks; columns that aren't in the schema asked for aren't read, and a
filter on the split leaves out files.  Files may be gzipped (.gz); such a one can't be cut.
"""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id long, split string, label int, height int, width int, pixels array<float>"
#: Fixed values of the format: what stands for a type of numbers.
KINDS = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}
#: Images of a partition at most, in bytes.
RANGE_BYTES = 1 << 24


def _resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def idx_header(kind: str, shape: tuple[int, ...]) -> bytes:
    code = next(c for c, k in KINDS.items() if k == kind)
    return struct.pack(f">BBBB{len(shape)}I", 0, 0, code, len(shape), *shape)


def read_header(f) -> tuple[str, tuple[int, ...], int]:
    """Type, sizes and where the numbers begin; a ValueError if it isn't an IDX file."""
    magic = f.read(4)
    if len(magic) < 4 or magic[:2] != b"\0\0" or magic[2] not in KINDS:
        raise ValueError("not an IDX file")
    shape = struct.unpack(f">{magic[3]}I", f.read(4 * magic[3]))
    return KINDS[magic[2]], shape, 4 + 4 * magic[3]


def _open(fs: pafs.FileSystem, path: str):
    return gzip.open(fs.open_input_file(path)) if path.endswith(".gz") else fs.open_input_file(path)


def _items(fs: pafs.FileSystem, path: str, first: int, count: int) -> np.ndarray:
    """Items first .. first + count - 1 of a file."""
    with _open(fs, path) as f:
        kind, shape, at = read_header(f)
        size = prod(shape[1:]) * np.dtype(kind).itemsize
        f.seek(at + first * size)
        data = f.read(count * size)
        if len(data) != count * size:
            raise ValueError(f"{path} ends before item {first + count}")
        return np.frombuffer(data, kind).reshape(count, *shape[1:])


@dataclass
class Stretch(InputPartition):
    """Images first .. first + count - 1 of a file; their ids begin at id where the file has none of its own."""

    path: str
    split: str
    first: int
    count: int
    id: int
    beside: dict[str, str]


class ImageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.splits = schema, options["path"], None
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the split leave out folders; all others stay Spark's."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("split",):
                self.splits = set(values) if self.splits is None else self.splits & set(values)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _resolve(self.path)
        out, number = [], 0
        for folder in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.Directory):
            split = folder.rstrip("/").rsplit("/", 1)[-1]
            files = {x.path for x in fs.get_file_info(pafs.FileSelector(folder)) if x.is_file}
            for path in sorted(x for x in files if x.removesuffix(".gz").endswith(".idx3")):
                stem = path.removesuffix(".gz")[: -len(".idx3")]
                beside = {name: p for name in ("idx1", "ids") for p in (f"{stem}.{name}", f"{stem}.{name}.gz") if p in files}
                with _open(fs, path) as f:
                    kind, shape, _ = read_header(f)
                if self.splits is None or split in self.splits:
                    step = shape[0] if path.endswith(".gz") else max(1, self.range_bytes // max(1, prod(shape[1:]) * np.dtype(kind).itemsize))
                    out += [Stretch(path, split, a, min(step, shape[0] - a), number + a, beside) for a in range(0, shape[0], max(1, step))]
                number += shape[0]
        return out or [Stretch("", "", 0, 0, 0, {})]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        fs, _ = _resolve(self.path)
        names = self.schema.fieldNames()
        step = 1024
        for at in range(part.first, part.first + part.count, step):
            n = min(step, part.first + part.count - at)
            columns = []
            for name in names:
                if name == "id":
                    own = np.frombuffer(_items(fs, part.beside["ids"], at, n).tobytes(), ">i8").astype(np.int64) if "ids" in part.beside else np.arange(n) + part.id + at - part.first
                    columns.append(pa.array(own, pa.int64()))
                elif name == "split":
                    columns.append(pa.array([part.split] * n, pa.string()))
                elif name == "label":
                    columns.append(pa.array(_items(fs, part.beside["idx1"], at, n).astype(np.int32), pa.int32()) if "idx1" in part.beside else pa.nulls(n, pa.int32()))
                elif name in ("height", "width", "pixels"):
                    x = _items(fs, part.path, at, n) if name == "pixels" else None
                    if x is None:
                        with _open(fs, part.path) as f:
                            columns.append(pa.array(np.full(n, read_header(f)[1][1 if name == "height" else 2]), pa.int32()))
                    else:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * prod(x.shape[1:]), pa.int32()), pa.array(x.reshape(-1).astype(np.float32))))
                else:
                    raise ValueError(f"images have no column {name}")
            yield pa.RecordBatch.from_arrays(columns, names=names)


class ImageFiles(DataSource):
    """spark.read.format("images").load(folder); a schema of some of the columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ImageReader(schema, {k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, schema: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, split, label, height, width, pixels) of every image below path; a label is null where a file has none."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageFiles)
    reader = spark.read.format("images").option("rangeBytes", str(range_bytes))
    return (reader.schema(schema) if schema else reader).load(path)


def write(images: DataFrame, path: str, height: int, width: int, most: int = 4096) -> None:
    """Write images(id, split, label, pixels) as files of at most ``most`` images; a null label is an error, as the format has none.

    A file gets its name when it is complete, so a task that is repeated leaves whole files only; those of a failed attempt are
    removed at the end, as only what successful tasks report is kept.
    """
    fs, root = _resolve(path)
    rows = images.select(F.col("split").cast("string").alias("split"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("label").cast("int"), F.raise_error(F.lit("a null label")).cast("int")).alias("label"), F.col("pixels").cast("array<float>").alias("pixels"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _resolve(path)
        for b in batches:
            splits = b.column("split")
            for split in splits.unique().to_pylist():
                own = np.flatnonzero(pc.equal(splits, split).to_numpy(zero_copy_only=False))
                for at in range(0, len(own), most):
                    some = b.take(pa.array(own[at : at + most]))
                    stem = f"{root}/{split}/{uuid.uuid4().hex}"
                    fs.create_dir(f"{root}/{split}", recursive=True)
                    n, pixels = some.num_rows, some.column("pixels").flatten().to_numpy(zero_copy_only=False)
                    if len(pixels) != n * height * width or some.column("pixels").null_count:
                        raise ValueError(f"images must have {height} * {width} pixels")
                    for name, kind, shape, x in (("ids", ">i4", (n, 2), some.column("id").to_numpy(zero_copy_only=False).astype(">i8").view(">i4")), ("idx1", ">i4", (n,), some.column("label").to_numpy(zero_copy_only=False)), ("idx3", ">f4", (n, height, width), pixels)):
                        with fs.open_output_stream(f"{stem}.{name}.part") as f:
                            f.write(idx_header(kind, shape) + x.astype(kind).tobytes())
                        fs.move(f"{stem}.{name}.part", f"{stem}.{name}")
                    yield pa.RecordBatch.from_pydict({"stem": [stem]})

    kept = {r.stem for r in rows.mapInArrow(put, "stem string").collect()}  # a name for each file
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if x.is_file and x.path.rsplit(".", 2 if x.path.endswith(".part") else 1)[0] not in kept:
                fs.delete_file(x.path)
