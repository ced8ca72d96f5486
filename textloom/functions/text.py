"""String functions: byte positions, cases, splitting, Unicode checks, charsets."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_lower(s: Column) -> Column:
    """STR-4 (H): only A-Z change."""
    return F.translate(s, ascii_uppercase, ascii_lowercase)


def ascii_upper(s: Column) -> Column:
    """STR-4 (H): only a-z change."""
    return F.translate(s, ascii_lowercase, ascii_uppercase)


def starts_with(s: Column, prefix: str, case_sensitive: bool = True) -> Column:
    """STR-4 (H): the prefix test, in ASCII case."""
    return F.startswith(s, F.lit(prefix)) if case_sensitive else F.startswith(ascii_lower(s), F.lit(prefix.translate(str.maketrans(ascii_uppercase, ascii_lowercase))))


def byte_position(text: Column, pattern: str | Column) -> Column:
    """STR-1, STR-2 (I): where the pattern is first found, in bytes from 0; -1 if absent, 0 if empty."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    at = F.instr(text, pattern)
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.left(text, at - 1))).cast("int")


def byte_length(text: Column) -> Column:
    """STR-3 (I)."""
    return F.octet_length(text)


def pieces(s: Column, delimiter: str, trim: bool = False) -> Column:
    """STR-5 (H): what a delimiter separates; ``trim`` also strips spaces, which is unconfirmed (X)."""
    parts = F.split(s, f"\\Q{delimiter}\\E", -1)
    return F.transform(parts, F.trim) if trim else parts


def wide(s: Column) -> Column:
    """UTF-1, UTF-3 (H): UTF-16 little-endian bytes."""
    return F.encode(s, "UTF-16LE")


def narrow(b: Column) -> Column:
    """UTF-1, UTF-3 (H): back from UTF-16 little-endian bytes."""
    return F.decode(b, "UTF-16LE")


def is_utf8(s: Column) -> Column:
    """UTF-1 (H): the strict conversion's verdict."""
    return F.is_valid_utf8(s)


def as_utf8(s: Column) -> Column:
    """UTF-1 (H): the best-effort conversion; bad bytes become U+FFFD."""
    return F.make_valid_utf8(s)


def first_rune(s: Column) -> Column:
    """UTF-2 (H): the first code point."""
    return F.when(F.length(s) > 0, F.ascii(s))


def rune_text(n: Column) -> Column:
    """UTF-2 (H): a code point as text; U+FFFD for what is none. Built from UTF-32 bytes, since
    ``chr`` stops at 255."""
    valid = n.between(0, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(0xFFFD).cast("long")), 8, "0")), "UTF-32")


def rune_count(s: Column) -> Column:
    """UTF-2, UTF-4 (H/I): code points."""
    return F.length(s)


def rune_index(s: Column, rune: str) -> Column:
    """UTF-2, UTF-4 (H/I): where a character is first found, from 0; -1 if absent."""
    return F.instr(s, F.lit(rune)) - 1


def compare(a: Column, b: Column, n: int | None = None) -> Column:
    """UTF-4, UTF-5 (I): -1, 0 or 1 by code point, of the first ``n`` characters if given."""
    if n is not None:
        a, b = F.left(a, F.lit(n)), F.left(b, F.lit(n))
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


#: CHS-1: charsets in the order of trial, strict ones first. Fixed values.
CHARSETS = ("utf-8", "gb2312", "big5", "euc_jp", "shift_jis", "euc_kr", "cp1251", "iso8859_7", "cp1255", "tis_620", "latin_1")


@F.pandas_udf(T.StringType())
def charset(data: pd.Series) -> pd.Series:
    """CHS-1 (M): the first charset whose strict decoding accepts the bytes; byte order marks first.
    A heuristic of its own, not the detector's scores."""

    def one(x: bytes | None) -> str | None:
        if x is None:
            return None
        for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if x.startswith(mark):
                return name
        for name in CHARSETS:
            try:
                x.decode(name)
            except UnicodeDecodeError:
                continue
            return name
        return None

    return data.map(one)


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series, name: pd.Series) -> pd.Series:
    """CHS-1 (M): bytes in any of Python's charsets as text, bad bytes as U+FFFD."""
    return pd.Series([None if x is None or n is None else bytes(x).decode(n, "replace") for x, n in zip(data, name)], dtype=object)
