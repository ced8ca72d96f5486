"""Periodic runs of words, found with bit-parallel lags, and texts without their repetitions.

A document's words are numbered, and each bit of the numbers becomes one big integer, a bit a word. For a
lag q, a plane XORed with itself shifted by q has ones where words q apart differ in that bit; the OR over all
planes has zeros where they are equal. ANDs of the zeros with themselves, shifted by doubled steps, leave the places
where enough of them begin, and only from these is a run read off.

A run of period q is a stretch whose words q apart are equal, of ``max(LEAST, TIMES * q)`` words or more, that
neither neighbour extends, and that has no smaller period. A stretch of three periods or more that has a smaller period too
has one that divides q (Fine and Wilf), with the same ends, so it was found at that lag before.

Defined results
---------------
* Null and empty texts, and texts of fewer than ``LEAST`` words, have no run; they collapse to their words.
* Of runs with the same exact exponent the one with the smallest start, then period, is the greatest.
* Runs may overlap; a word goes if any run holds it after that run's first period.
* Texts of any length are taken whole. Repeated rows and ids are taken one by one. An empty table stays empty. Of other columns
  those asked for are passed on; one that has the name of an added column is replaced.

At scale
--------
No shuffle: documents are taken one at a time, a task's memory depends on its longest text. A text of n words
costs n/3 lags of n/64 machine words for some four planes, since further planes are met only by lags that these
leave open: 20,000 words take some hundredths of a second, a million words about a minute.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.text import words
from textloom.llm.vocabulary import blocks

#: Production parameters: fewest words of a run, and fewest periods. Planes that are looked at before the first test.
LEAST, TIMES, PLANES_AT_ONCE = 24, 3, 4

RUN = "struct<start:bigint,length:bigint,period:bigint>"
ADDED = {"n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs": f"array<{RUN}>", "collapsed": "string"}


def bit_planes(numbers: np.ndarray) -> list[int]:
    """One integer for each bit of the numbers; bit i of it is that of number i."""
    width = max(1, int(numbers.max()).bit_length())
    return [int.from_bytes(np.packbits(((numbers >> b) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(width)]


def stretch_starts(ones: int, least: int) -> int:
    """Ones where ``least`` ones begin."""
    have = 1
    while ones and have < least:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def matches(planes: list[int], lag: int, every: int, least: int) -> tuple[int, int]:
    """Where words ``lag`` apart are equal, and where ``least`` such places in a row begin."""
    mask, differ = every >> lag, 0
    for k in range(0, len(planes), PLANES_AT_ONCE):
        for plane in planes[k : k + PLANES_AT_ONCE]:
            differ |= plane ^ (plane >> lag)
        equal = (differ & mask) ^ mask
        starts = stretch_starts(equal, least)
        if not starts:
            break
    return equal, starts


def runs(text_words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    n = len(text_words)
    if n < least:
        return []
    known: dict = {}
    planes = bit_planes(np.fromiter((known.setdefault(w, len(known)) for w in text_words), np.int64, n))
    every, period_of = (1 << n) - 1, {}
    for lag in range(1, n // times + 1):
        equal, starts = matches(planes, lag, every, max(least, times * lag) - lag)
        while starts:
            at = (starts & -starts).bit_length() - 1
            ahead = equal >> at
            end = at + (~ahead & (ahead + 1)).bit_length() - 1
            period_of.setdefault((at, end - at + lag), lag)
            starts = starts >> end << end
    return sorted((start, length, lag) for (start, length), lag in period_of.items())


def greatest(found: list[tuple[int, int, int]]) -> tuple | None:
    """The run with the greatest exact length/period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed_words(text_words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run repeats."""
    kept = np.ones(len(text_words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [text_words[i] for i in np.flatnonzero(kept)] if found else text_words


def of_block(texts: list[str]) -> list[pa.Array]:
    """The added columns of some texts."""
    split = [t.encode().split() for t in texts]  # bytes split at ASCII white space alone
    found = [runs(w) for w in split]
    best = [greatest(r) or (None, None, None) for r in found]
    columns = [[len(r) for r in found], *([b[k] for b in best] for k in range(3)), [b[1] and 1000 * b[1] // b[2] for b in best]]
    out = [pa.array(c, pa.int64()) for c in columns]
    fields = [pa.field(x, pa.int64()) for x in ("start", "length", "period")]
    out.append(pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], pa.list_(pa.struct(fields))))
    return [*out, pa.array([b" ".join(collapsed_words(w, r)).decode() for w, r in zip(split, found)], pa.string())]


def with_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``n_runs``, the greatest run (``start``, ``length``, ``period``,
    ``exponent_milli``: null without one), all ``runs`` by start and period, and the ``collapsed`` text."""
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(x, T._parse_datatype_string(k)) for x, k in ADDED.items())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for block in blocks(x.as_py() for x in batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(block)), *of_block(block)], ["row", *ADDED])
                start += len(block)

    return rows.mapInArrow(find, schema).select("row.*", *ADDED)


def run_lines(found: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text``: in a tenth of the documents, chosen by the id's checksum, the words from
    some place on repeat with some period. Texts of null ids stay as they are."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    some = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    split = some.select(id_col, "text", "g", F.when(F.col("h") % 10 == 0, words(F.col("text"))).alias("w"))
    n = F.size("w")
    sized = split.select(id_col, "text", "g", "w", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p")
    placed = sized.select(id_col, "text", "w", "n", "a", period)
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    own = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n"))
    return placed.select(id_col, F.when(F.col("a").isNotNull(), F.array_join(own, " ")).otherwise(F.col("text")).alias("text"))
