"""Words, lines and seeded hashes as native columns; the one definition of a word for all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def word_count(text: Column) -> Column:
    """How many words a text has, as a long; 0 for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that follows from ``key`` and ``seed`` alone (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column of the input has it (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
