"""CHS-1: the charset of bytes, by whether they are well formed in it and how usual the text is that they give.

The model counts characters, pairs and triples of neighbouring ones in given texts, with a mark at both ends; it holds for every
charset, since bytes are read before they are scored. A candidate is out if the bytes are not well formed in it. Of the others
the one wins whose text has the highest probability, each character's being that after the two before it, which falls back on that
after the one before and on its own share. All candidates account for the same bytes, so probabilities of whole texts compare, whatever
their lengths; equal ones (the same text, mostly) are told apart by the order of the candidates. A byte order mark decides before all.

At scale: a task counts into one array of ``SIZE`` numbers and emits what it met, so that at most as
many rows a task are shuffled and come to the driver, whatever the corpus. What shares a place by its hash counts together, but a
pair never more than its characters, nor a triple more than its pairs, so hardly anything that was not met counts as met.

``distinguished`` also compares what is left close: readings that a few bits a letter part, such as "Ç" and "Ä", or a long text that
repeats one word. Their longer contexts, up to eight characters, are then counted in the given texts, exactly, however many: a task passes
on only the contexts that are sought (beyond ``KEYS`` of them, those that share a place with one), and counts meet texts by joins.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.lineage import checked_broadcast, checkpointed

#: Places of the table of characters; binary digits of those of the tables of pairs and of triples; places of all.
PLACES, DIGITS = 1 << 16, 18
SIZE = PLACES + (2 << DIGITS)
#: As how many occurrences of a context the estimate from a shorter one counts.
SHORTER = 4.0
#: Orders of the longer contexts; the binary digits of the places by which texts are searched for them.
LONGER, SOUGHT = range(4, 9), 22
#: As many sought contexts at most come to the driver and the tasks.
KEYS = 4 << 20
#: Readings are close if fewer bits than this for each character beyond ASCII in the better one part them.
CLOSE = 24.0
#: What stands before and after a text.
EDGE = "\x02"
#: Candidates, in the order that decides between equal scores. Fixed values.
CANDIDATES = (
    "utf-8", "gb18030", "big5", "euc_jp", "shift_jis", "euc_kr", "latin_1", "iso8859_2", "cp1251", "koi8_r", "iso8859_7", "cp1255", "tis_620",
    "utf-16-le", "utf-16-be",
)
#: Byte order marks, the longer first. Fixed values.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def _mixed(keys: np.ndarray) -> np.ndarray:
    """The first ``DIGITS`` binary digits of a hash of 64 bits (the finalizer of splitmix)."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((keys ^ (keys >> np.uint64(31))) >> np.uint64(64 - DIGITS)).astype(np.int64)


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a text's characters, with two marks before and one after it, of their pairs and of their triples."""
    points = np.frombuffer(f"{EDGE}{EDGE}{text}{EDGE}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = (points[:-1] << np.uint64(21)) | points[1:]
    three = (two[:-1] << np.uint64(21)) | points[2:]
    return points.astype(np.int64) & (PLACES - 1), PLACES + _mixed(two), PLACES + (1 << DIGITS) + _mixed(three)


def _points(text: str) -> np.ndarray:
    """A text's code points, with as many marks before as the longest context asks for, and one after."""
    return np.frombuffer(f"{EDGE * (LONGER[-1] - 1)}{text}{EDGE}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _sought(keys: np.ndarray) -> np.ndarray:
    """The places of keys among ``2 ** SOUGHT``."""
    return ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SOUGHT)).astype(np.int64)


def encoded(text: Column, name: Column) -> Column:
    """Text as bytes in a charset; a character that it lacks becomes a question mark. Null for a null of either."""

    @F.pandas_udf("binary")
    def written(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or n is None else t.encode(n, "replace") for t, n in zip(texts, names)], dtype=object)

    return written(text, name)


def place_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(place, n)`` of all texts: characters, then pairs, then triples; nulls count as no text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for found in places(text.as_py()):
                        np.add.at(counts, found, 1)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["place", "n"])

    return texts.select(F.col(f"`{text_col}`")).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def fitted(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """The counts of all places, then the number of all characters and that of their kinds."""
    counts = np.zeros(SIZE + 2)
    met = place_counts(texts, text_col).toArrow()
    counts[met["place"].to_numpy()] = met["n"].to_numpy()
    counts[SIZE:] = counts[:PLACES].sum(), np.count_nonzero(counts[:PLACES])
    return counts


def shares(text: str, model: np.ndarray) -> np.ndarray:
    """The probability of each of a text's characters, and of its end, after the two before. As many characters more as there are
    different ones, and one, are spread over all places: the more kinds a script has, the likelier is one that was not met."""
    one, two, three = (model[x] for x in places(text))
    two = np.minimum(two, np.minimum(one[:-1], one[1:]))
    three = np.minimum(three, np.minimum(two[:-1], two[1:]))
    total, kinds = model[SIZE], model[SIZE + 1] + 1
    share = (one[2:] + kinds / PLACES) / (total + kinds)
    share = (two[1:] + SHORTER * share) / (one[1:-1] + SHORTER)
    return (three + SHORTER * share) / (two[:-1] + SHORTER)


def likely(text: str, model: np.ndarray) -> float:
    """The logarithm of a text's probability."""
    share = shares(text, model)
    for _ in range(2):  # products of four, far from the least double, take a quarter of the logarithms
        half = len(share) // 2
        share = np.concatenate((share[:half] * share[half : 2 * half], share[2 * half :]))
    return float(np.log2(share).sum())


def grams(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """By length, from 2: the keys of the runs of a text's characters, at all places, with marks before and one after it."""
    points = _points(text)
    keys = points + np.uint64(1)
    for n in range(2, LONGER[-1] + 1):
        keys = keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        yield n, keys


def contexts(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order: where in a text a longer context is of use, as it or what follows is beyond ASCII, and the keys there with and
    without what follows."""
    beyond, before = np.concatenate(([0], np.cumsum(_points(text) > 127))), None
    for n, keys in grams(text):
        if n in LONGER:
            begin = LONGER[-1] - n
            at = np.flatnonzero((beyond[n:] - beyond[:-n])[begin:])
            yield at, keys[begin + at], before[begin + at]
        before = keys


def likely_at_length(text: str, model: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> float:
    """As ``likely``, with the longer contexts; what a text repeats counts once, as it says no more. ``keys`` are those that the
    given texts have, sorted, with their counts."""

    def met(sought: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(sought))
        found = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        return np.where(keys[found] == sought, counts[found], 0)

    share = shares(text, model)
    for at, whole, before in contexts(text):
        share[at] = (met(whole) + SHORTER * share[at]) / (met(before) + SHORTER)
    *_, (_, longest) = grams(text)
    return float(np.log2(share[np.unique(longest, return_index=True)[1]]).sum())


def scores(data: bytes, model: np.ndarray, candidates: Sequence[str] = CANDIDATES) -> list[float | None]:
    """Each candidate's log probability by byte; none where the bytes are not well formed in it. A text that several read is scored once."""
    out: list[float | None] = []
    known: dict[str, float] = {}
    for name in candidates:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            out.append(None)
            continue
        if text not in known:
            known[text] = likely(text, model) / max(1, len(data))
        out.append(known[text])
    return out


def close(data: bytes, model: np.ndarray, candidates: Sequence[str]) -> dict[str, str]:
    """The likeliest reading of bytes and those close to it, each text with the first candidate that reads it; none without two."""
    found = scores(data, model, candidates)
    top = max((s for s in found if s is not None), default=None)
    if top is None:
        return {}
    letters = sum(x > "\x7f" for x in data.decode(candidates[found.index(top)]))
    out: dict[str, str] = {}
    for name, score in zip(candidates, found):
        if score is not None and (top - score) * len(data) < CLOSE * max(1, letters):
            out.setdefault(data.decode(name), name)
    return out if len(out) > 1 else {}


def detected(spark: SparkSession, model: np.ndarray, data: Column, candidates: Sequence[str] = CANDIDATES) -> Column:
    """``struct(charset, score, margin, close)`` of bytes: the winner, its score, its lead over the best charset
    that reads another text (null: there is none), and whether that is a close one. Nulls, and bytes that fit no candidate, give
    nulls; so do scores under a byte order mark."""
    shared = spark.sparkContext.broadcast(model)
    names = tuple(candidates)

    @F.pandas_udf("charset string, score double, margin double, close boolean")
    def best(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            mark = None if value is None else next((n for m, n in MARKS if value.startswith(m)), None)
            found = [None] if value is None or mark else scores(value, shared.value, names)
            top = max((s for s in found if s is not None), default=None)
            if top is None:
                rows.append((mark, None, None, False))
                continue
            at = found.index(top)
            rest = max((s for s in found if s is not None and not math.isclose(s, top, abs_tol=1e-12)), default=None)
            letters = max(1, np.count_nonzero(_points(value.decode(names[at])) > 127))
            rows.append((names[at], top, None if rest is None else top - rest, rest is not None and (top - rest) * len(value) < CLOSE * letters))
        return pd.DataFrame(rows, columns=["charset", "score", "margin", "close"]).astype({"charset": object, "score": float, "margin": float, "close": bool})

    return best(data)


def distinguished(rows: DataFrame, texts: DataFrame, model: np.ndarray, candidates: Sequence[str] = CANDIDATES, data_col: str = "data", text_col: str = "text") -> DataFrame:
    """The rows with ``charset`` in place of their bytes: as ``detected``, but readings that are close are compared with their longer
    contexts in the given texts. These are read once more, if any reading is close."""
    spark, names = rows.sparkSession, tuple(candidates)
    shared = spark.sparkContext.broadcast(model)
    best = detected(spark, model, F.col(f"`{data_col}`"), names)
    kept = [c for c in rows.columns if c != data_col]
    first = rows.select("*", F.monotonically_increasing_id().alias("_row"), best.alias("_best"))
    first = checkpointed(first.select(*(F.col(f"`{c}`") for c in kept), "_row", "_best.charset", F.when(F.col("_best.close"), F.col(f"`{data_col}`")).alias("_data")))
    unsure = first.where("_data is not null").select("_row", "_data")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column(0), batch.column(1)):
                found = [x for text in close(data.as_py(), shared.value, names) for _, whole, before in contexts(text) for x in (whole, before)]
                if found:
                    keys = np.unique(np.concatenate(found)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row.as_py())), pa.array(keys)], ["_row", "key"])

    if unsure.isEmpty():
        return first.drop("_row", "_data")
    sought = checkpointed(unsure.mapInArrow(seek, "_row long, key long"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << SOUGHT, bool)
        for batch in batches:
            met[_sought(batch.column(0).to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met))], ["place"])

    all_keys, wanted = sought.select("key").distinct(), np.zeros(1 << SOUGHT, bool)
    few = np.sort(all_keys.toArrow()["key"].to_numpy().view(np.uint64)) if sought.count() <= KEYS else None
    wanted[all_keys.mapInArrow(placed, "place long").distinct().toArrow()["place"].to_numpy() if few is None else _sought(few)] = True
    search = spark.sparkContext.broadcast((wanted, few))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            if few is not None and len(keys):
                exact = few[np.minimum(np.searchsorted(few, keys), len(few) - 1)] == keys
                keys, n = keys[exact], n[exact]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        found, size = [], 0
        wanted, few = search.value
        for batch in batches:
            for text in batch.column(0):
                for n, keys in grams(text.as_py()) if text.is_valid else ():
                    if n >= LONGER[0] - 1:
                        keys = keys[max(0, LONGER[-1] - n - 1) :]
                        found.append(keys[wanted[_sought(keys)]])
                        size += len(found[-1])
                if size > 1 << 21:
                    yield summed()
                    found, size = [], 0
        if found:
            yield summed()

    counts = texts.select(F.col(f"`{text_col}`")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    met = sought.join(counts, "key").groupBy("_row").agg(F.collect_list(F.struct("key", "n")).alias("met"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for data, found in zip(batch.column(1), batch.column(2)):
                pairs = found.values if found.is_valid else None
                keys = np.zeros(0, np.uint64) if pairs is None else pairs.field("key").to_numpy().view(np.uint64)
                n = np.zeros(0) if pairs is None else pairs.field("n").to_numpy()
                order = np.argsort(keys)
                readings = close(data.as_py(), shared.value, names)
                told.append(readings[max(readings, key=lambda text: likely_at_length(text, shared.value, keys[order], n[order]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["_row", "_told"])

    told = checked_broadcast(unsure.join(met, "_row", "left").mapInArrow(decide, "_row long, _told string"))
    return first.join(told, "_row", "left").select(*(F.col(f"`{c}`") for c in kept), F.coalesce("_told", "charset").alias("charset"))
