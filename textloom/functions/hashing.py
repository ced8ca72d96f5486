"""The string hashes, over whole Arrow batches: each step works on all rows that still have bytes.

Spark has no unsigned numbers: 64-bit results are longs in two's complement; ``hex16`` and ``unsigned``
show them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: HSH-1: recovered from the golden pair of the original's test.
SEED = 19820125
_M, _R = np.uint64(0xC6A4A7935BD1E995), np.uint64(47)


class Bytes:
    """The bytes of many strings in one array, each string from a multiple of eight on."""

    def __init__(self, values: pd.Series):
        raw = [x.encode() if isinstance(x, str) else bytes(x) if x is not None else b"" for x in values]
        self.null = values.isna().to_numpy()
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        room = (self.length + 8) // 8 * 8
        self.start = np.cumsum(room) - room
        self.data = np.frombuffer(b"".join(x.ljust(n, b"\0") for x, n in zip(raw, room.tolist())), np.uint8)
        self.by_length = np.argsort(-self.length, kind="stable")

    def rows_longer(self, n: int) -> np.ndarray:
        """The rows with more than ``n`` bytes, longest first."""
        ordered = -self.length[self.by_length]
        return self.by_length[: np.searchsorted(ordered, -n, "left")]

    def result(self, values: np.ndarray) -> pd.Series:
        return pd.Series(values.astype(np.int64)).astype("Int64").mask(self.null)


def murmur64a(values: pd.Series, seed: int = SEED) -> np.ndarray:
    """HSH-3, HSH-4: MurmurHash64A of each value, as uint64; and of no bytes for null."""
    b = Bytes(values)
    words = b.data.view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.uint64(seed) ^ (b.length.astype(np.uint64) * _M)
        for at in range(0, int(b.length.max(initial=0)) // 8):
            rows = b.rows_longer(8 * at + 7)
            k = words[b.start[rows] // 8 + at] * _M
            k = (k ^ (k >> _R)) * _M
            h[rows] = (h[rows] ^ k) * _M
        tail = np.flatnonzero(b.length % 8)
        last = words[(b.start[tail] + b.length[tail]) // 8]  # padded with zeros
        h[tail] = (h[tail] ^ last) * _M
        h = (h ^ (h >> _R)) * _M
        return h ^ (h >> _R)


def fingerprint(value: Column, seed: int = SEED) -> Column:
    """HSH-1, HSH-4 (T): the 64-bit fingerprint of a string or binary, as a long."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(murmur64a(values, seed).view(np.int64)).astype("Int64").mask(values.isna().to_numpy())

    return run(value)


def jenkins(value: Column) -> Column:
    """HSH-6 (H, public algorithm): the 32-bit one-at-a-time hash, as a long."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        b = Bytes(values)
        h = np.zeros(len(values), np.uint32)
        with np.errstate(over="ignore"):
            for at in range(int(b.length.max(initial=0))):
                rows = b.rows_longer(at)
                x = h[rows] + b.data[b.start[rows] + at]
                x = x + (x << np.uint32(10))
                h[rows] = x ^ (x >> np.uint32(6))
            h = h + (h << np.uint32(3))
            h = h ^ (h >> np.uint32(11))
            h = h + (h << np.uint32(15))
        return b.result(h)

    return run(value)


def times131(value: Column) -> Column:
    """HSH-7 (I): h = 131 h + c over signed bytes, modulo 2^64, as a long."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        b = Bytes(values)
        h = np.zeros(len(values), np.uint64)
        signed = b.data.view(np.int8)
        with np.errstate(over="ignore"):
            for at in range(int(b.length.max(initial=0))):
                rows = b.rows_longer(at)
                h[rows] = h[rows] * np.uint64(131) + signed[b.start[rows] + at].astype(np.uint64)
        return b.result(h.view(np.int64))

    return run(value)


def identity(value: Column) -> Column:
    """HSH-8 (I)."""
    return value


def fingerprint32(value: Column) -> Column:
    """HSH-5 (H): not the original's values, whose algorithm is unknown; Spark's Murmur3."""
    return F.hash(value)


def hex16(h: Column) -> Column:
    """A long as 16 hexadecimal digits of its unsigned value."""
    return F.lpad(F.hex(h), 16, "0")


def unsigned(h: Column) -> Column:
    """A long's unsigned value in decimal digits."""
    return F.conv(hex16(h), 16, 10)


def _swapped(digits: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit(".."), F.lit(0))), "")


def fingerprint_to_string(h: Column) -> Column:
    """HSH-2 (T): upper-case hexadecimal of the little-endian bytes."""
    return _swapped(hex16(h))


def string_to_fingerprint(s: Column) -> Column:
    """HSH-3 (T): the fingerprint in decimal digits, unsigned; null unless there are 16 digits."""
    return F.when(s.rlike("^[0-9A-Fa-f]{16}$"), F.conv(_swapped(s), 16, 10))
