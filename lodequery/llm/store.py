"""Files that driver and executors share.

Anything a job leaves for a later job goes below ``spark.checkpoint.dir``, the
one folder that every executor of a cluster can reach.  Paths are URIs, opened
with ``pyarrow.fs``; a local or mounted folder is memory-mapped where it is, and
from any other store a worker fetches the file it needs into an unlinked
temporary file and maps that.  Files are written under a name of their own and
then renamed, so a retried or speculative task never leaves half a file.
"""

from __future__ import annotations

import atexit
import ctypes
import mmap
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LIBC = ctypes.CDLL(None)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder of this machine that becomes it, and on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if not root:
        root = os.path.join(tempfile.gettempdir(), f"lodequery-{uuid.uuid4().hex[:12]}")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(remove, root)
    return root.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh folder below the shared root; results are read from it, so it stays until clear_folders() or this process ends, and longer with keep."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        if not _made:
            atexit.register(clear_folders)
        _made.append(folder)
    return folder


def clear_folders() -> None:
    """Remove every folder of new_folder(); frames that read from them can't be used afterwards."""
    while _made:
        try:
            remove(_made.pop())
        except OSError:  # a store that is gone with its session
            pass


def _resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def mounted(uri: str) -> bool:
    """Whether the files below uri can be mapped where they are."""
    return isinstance(_resolve(uri)[0], pafs.LocalFileSystem)


def remove(uri: str) -> None:
    fs, path = _resolve(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


class AtomicFile:
    """A file to write that takes its name only once it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _resolve(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


def release_memory() -> None:
    """Give what this process has freed back to the system; for the end of a task, as workers live on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def whole_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """docs, if the ids are whole numbers or all null, else a TypeError before any job runs."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")
    return docs


def put_arrays(uri: str, **arrays: np.ndarray) -> None:
    """Write each array as uri.name.npy."""
    for name, x in arrays.items():
        with AtomicFile(f"{uri}.{name}.npy") as f:
            np.lib.format.write_array(_Sink(f), np.ascontiguousarray(x), allow_pickle=False)


class _Sink:
    def __init__(self, f):
        self.f = f

    def write(self, b):
        self.f.write(bytes(b) if isinstance(b, memoryview) else b)


def mapped_array(uri: str) -> np.ndarray:
    """A .npy file's array, memory-mapped and read-only."""
    fs, path = _resolve(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return _load(path)
    with tempfile.NamedTemporaryFile(suffix=".npy") as f:
        with fs.open_input_stream(path) as src:
            while chunk := src.read(1 << 24):
                f.write(chunk)
        f.flush()
        return _load(f.name)


def _load(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format._read_array_header(f, version)
        at = f.tell()
        if not shape[0]:
            return np.zeros(shape, kind)
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return np.frombuffer(whole, kind, count=int(np.prod(shape)), offset=at).reshape(shape)


def open_random(uri: str):
    """A readable, seekable file."""
    fs, path = _resolve(uri)
    return fs.open_input_file(path)


def put_pack(uri: str, **arrays: np.ndarray) -> None:
    """Several arrays in one file: a JSON line of names, types and places, then the arrays, 64-byte aligned."""
    import json

    at, head, todo = 0, {}, []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head[name] = [x.dtype.str, at, list(x.shape)]
        todo.append((x, -x.nbytes % 64))
        at += x.nbytes + todo[-1][1]
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    with AtomicFile(uri) as f:
        f.write(line)
        for x, pad in todo:
            f.write(x.data if x.nbytes else b"")
            f.write(b"\0" * pad)


def mapped_pack(uri: str) -> dict[str, np.ndarray]:
    """The arrays of put_pack(), memory-mapped and read-only."""
    import json

    def load(path: str) -> dict[str, np.ndarray]:
        with open(path, "rb") as f:
            head = json.loads(line := f.readline())
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return {k: np.frombuffer(whole, t, count=int(np.prod(shape)), offset=len(line) + at).reshape(shape) if np.prod(shape) else np.zeros(shape, t) for k, (t, at, shape) in head.items()}

    fs, path = _resolve(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return load(path)
    with tempfile.NamedTemporaryFile(suffix=".pack") as f:
        with fs.open_input_stream(path) as src:
            while chunk := src.read(1 << 24):
                f.write(chunk)
        f.flush()
        return load(f.name)
