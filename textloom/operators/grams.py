"""Finding many strings in many texts by equality joins of grams.

A long string is found by blocks: the text is cut into blocks of B characters that do not overlap, and a string of 2B - 1
characters or more holds a whole block wherever it stands, so its first B windows are looked up among the blocks.
A short string is found by the text's overlapping grams of about its own length, with one window. The rows exploded
are the text's length divided by the step of each cut, whatever the strings' lengths and number; each string takes the first of
``CUTS`` that it has room for, and only cuts that some string takes are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.lineage import checked_broadcast

#: Fewest characters of a string, width of its grams, and step between the text's grams of that cut.
CUTS = ((23, 12, 12), (15, 8, 8), (8, 8, 1), (5, 5, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1))


def cut_of(string: Column) -> Column:
    """The number of the cut that a string takes; null for an empty one."""
    return F.coalesce(*(F.when(F.length(string) >= least, F.lit(k)) for k, (least, _, _) in enumerate(CUTS)))


def windows(strings: DataFrame, column: str) -> DataFrame:
    """``strings`` with ``cut``, and a row for each of its first windows, as many as the cut's step: ``gram``
    and its ``offset``."""
    sized = strings.withColumn("cut", cut_of(F.col(column))).where("cut is not null")
    width, step = (F.element_at(F.array(*(F.lit(c[i]) for c in CUTS)), F.col("cut") + 1) for i in (1, 2))
    return sized.withColumn("offset", F.explode(F.sequence(F.lit(0), step - 1))).withColumn("gram", F.substring(F.col(column), F.col("offset") + 1, width))


def grams_of(text: Column, cut: int) -> Column:
    """The whole grams of a text in order, one step apart."""
    _, width, step = CUTS[cut]
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{{width}}}"), F.lit(0))
    return blocks if step == width else F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))


def cuts_in(found: DataFrame) -> list[int]:
    return sorted(r["cut"] for r in found.select("cut").distinct().collect())


def occurrences(keys: DataFrame, key_col: str, strings: DataFrame, column: str) -> DataFrame:
    """Each key with every string in it: the strings' columns and ``at``, characters before it. Keys go along
    with their blocks, so they should be short; ``patterns.matches`` is for long texts."""
    grams = checked_broadcast(windows(strings, column))
    out = None
    for cut in cuts_in(grams):
        rows = keys.select(key_col, F.posexplode(grams_of(F.col(key_col), cut)).alias("place", "gram"))
        found = rows.join(grams.where(F.col("cut") == cut), "gram").withColumn("at", F.col("place") * CUTS[cut][2] - F.col("offset")).where("at >= 0")
        found = found.where(F.substring(F.col(key_col), F.col("at") + 1, F.length(column)) == F.col(column)).select(key_col, *strings.columns, "at")
        out = found if out is None else out.union(found)
    return keys.select(key_col).join(strings, F.lit(False)).withColumn("at", F.lit(0)) if out is None else out
