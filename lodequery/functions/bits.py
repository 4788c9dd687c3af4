"""Binary codes packed in BIGINT columns: element i of a code is bit i."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(flags: Column, nbits: int, start: int = 0) -> Column:
    """An array of booleans' elements start .. start + nbits - 1 as one BIGINT; nbits is 1 to 64."""
    if not 1 <= nbits <= 64:
        raise ValueError("nbits must be 1 to 64")
    one = lambda i: F.when(F.get(flags, F.lit(start + i)), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = one(0)
    for i in range(1, nbits):
        code = code.bitwiseOR(one(i))
    return code


def sign_code(vector: Column, nbits: int, start: int = 0) -> Column:
    """Bit i says whether component start + i is positive; no intermediate array, so it stays in generated code."""
    if not 1 <= nbits <= 64:
        raise ValueError("nbits must be 1 to 64")
    one = lambda i: F.when(F.get(vector, F.lit(start + i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = one(0)
    for i in range(1, nbits):
        code = code.bitwiseOR(one(i))
    return code


def unpack(code: Column, nbits: int) -> Column:
    """The code's bits as an array of booleans."""
    return F.transform(F.sequence(F.lit(0), F.lit(nbits - 1)), lambda i: F.getbit(code, i) == 1)


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two packed codes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """The same for codes of over 64 bits, held as arrays of BIGINT words of equal length."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), apart).otherwise(F.raise_error(F.lit("codes differ in length")).cast("int"))


def hamming_arrays(a: Column, b: Column) -> Column:
    """Number of places in which two arrays of equal length differ; an error if the lengths differ."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), apart).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("int"))


def soft_hamming(v: Column, w: Column) -> Column:
    """Half of n - v.w: the Hamming distance when both hold -1 and 1."""
    dot = F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (F.size(v) - dot) / 2
