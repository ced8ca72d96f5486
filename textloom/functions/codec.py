"""Base64, hexadecimal and other encodings, and escapes for HTML and JavaScript."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base64_encode(data: Column) -> Column:
    """B64-1 (T): without line breaks, whatever the session's setting."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def base64_decode(s: Column) -> Column:
    """B64-2 (I): the bytes, or null for bad input."""
    return F.try_to_binary(s, F.lit("base64"))


def base64_web(data: Column) -> Column:
    """ENC-1 (M): the alphabet for URLs."""
    return F.translate(base64_encode(data), "+/", "-_")


def hex_encode(data: Column) -> Column:
    """ENC-1 (M): base 16."""
    return F.hex(data)


def hex_decode(s: Column) -> Column:
    """ENC-1 (M): null for bad input."""
    return F.try_to_binary(s, F.lit("hex"))


def binary_digits(n: Column) -> Column:
    """ENC-1 (M): base 2."""
    return F.bin(n)


@F.pandas_udf(T.StringType())
def base85_encode(data: pd.Series) -> pd.Series:
    """ENC-1 (M)."""
    return data.map(lambda x: None if x is None else base64.b85encode(x).decode())


#: Escapes, in the order in which they are applied. Fixed values.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
JAVASCRIPT = (("\\", "\\\\"), ("'", "\\x27"), ('"', "\\x22"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t"), ("<", "\\x3c"), (">", "\\x3e"), ("&", "\\x26"), ("=", "\\x3d"))


def replaced(s: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def html_escape(s: Column) -> Column:
    """ENC-1, TPL-2 (M/T)."""
    return replaced(s, HTML)


def javascript_escape(s: Column) -> Column:
    """ENC-1, TPL-2 (M/T)."""
    return replaced(s, JAVASCRIPT)


def md5_hex(data: Column) -> Column:
    """MD5-1 to MD5-3 (H/I): the digest in lower-case hexadecimal."""
    return F.md5(data)


def md5_of_parts(parts: Column) -> Column:
    """MD5-2 (H): the digest of an array of strings, as of updates one after the other."""
    return F.md5(F.array_join(parts, "").cast("binary"))


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """CRC-1 (M)."""
    return data.map(lambda x: None if x is None else zlib.adler32(x)).astype("Int64")


def crc32(data: Column) -> Column:
    """CRC-1 (M)."""
    return F.crc32(data)


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-1 (M): the Castagnoli polynomial. Byte by byte, for short values."""
    table = _crc32c_table()

    def one(x: bytes | None) -> int | None:
        if x is None:
            return None
        c = 0xFFFFFFFF
        for b in x:
            c = table[(c ^ b) & 255] ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    return data.map(one).astype("Int64")
