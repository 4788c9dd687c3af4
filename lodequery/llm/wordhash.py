"""Vectorised word splitting and hashing over Arrow string buffers.

Every operator of this subpackage that looks at words goes through ``split``:
one pass over the UTF-8 bytes finds the words of all texts of a batch and gives
each a 64-bit hash, without building a Python string per word.  Upper-case A-Z
is folded; bytes of 0x80 and above are word bytes, so multi-byte characters
stay whole.  Null and empty texts have no words.

A word's hash is a polynomial over a keyed byte table, finished by ``mix``; two
different words share one with probability about 2**-64.  Operators whose
result must not rest on that compare the bytes afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text hashed at once; bounds the temporary arrays to about 30 times this.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))[_LOWER] | U64(1)


def _word_bytes(*separators: range) -> np.ndarray:
    table = np.ones(256, bool)
    for r in separators:
        table[r.start : r.stop] = False
    return table[_LOWER]


#: Words are runs of bytes outside these separators, after lower-casing.
BLANK = _word_bytes(range(0x09, 0x0E), range(0x20, 0x21))
ALNUM = _word_bytes(range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80))

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))
    return _tables[size]


class Words(NamedTuple):
    """Words of a batch, in order: hashes, byte ranges in ``data``, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, and len+1 offsets into them; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.array([], pa.string())
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def _hash_range(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lo, hi = int(starts[0]), int(ends[-1])
    power, inverse = power_tables(hi - lo)
    total = _VALUE[data[lo:hi]]
    total *= power[: hi - lo]
    np.cumsum(total, out=total)
    first = starts - lo
    h = total[ends - lo - 1]
    inner = first > 0
    h[inner] -= total[first[inner] - 1]
    h *= inverse[first]
    h ^= (ends - starts).astype(U64) << U64(48)
    return mix(h)


def split(column, word_byte: np.ndarray = BLANK) -> Words:
    """The words of every text of an Arrow string column."""
    data, offs = text_bytes(column)
    inside = word_byte[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offs[(offs > 0) & (offs < len(data))]
        before[edge] = False
        after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK)))
        hashes[at:stop] = _hash_range(data, starts[at:stop], ends[at:stop])
        at = stop
    return Words(hashes, starts, ends, np.searchsorted(starts, offs), data)


_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries; len(hashes) - n + 1 of them, also across texts."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for k in range(n):
        total += mix(hashes[k : k + m] + _STEP[k % 8] * U64(1 + k // 8)) * _STEP[(k + 3) % 8]
    return mix(total)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: the distinct values, and where each begins (one more at the end)."""
    if not len(values):
        return values, np.zeros(1, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return values[starts], np.append(starts, len(values))


def cut_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of rows of about most bytes of text in column 1, each row whole."""
    held, size = [], 0
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0))
        at = 0
        while at < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[at:]), most - size, "right")
            stop = min(len(sizes), at + max(int(room), 0 if held else 1))
            if stop > at:
                held.append(b.slice(at, stop - at))
                size += int(sizes[at:stop].sum())
            if stop < len(sizes):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = stop
    if held:
        yield pa.Table.from_batches(held)
