"""Sets of patterns over many texts, without trying every pattern on every text.

From each pattern follow groups of literals: any match holds at least one literal of every group. The literals
are looked up by their first and last bytes at all places of the texts; texts that have one of every group of a
pattern are its candidates, and only on these is the pattern tried. Texts stay in their partitions. Literals
that take more than ``BROADCAST_BYTES`` are joined to the grams of the texts instead (``grams``). Patterns without such a literal, and those whose
syntax differs between regular-expression dialects, are tried on every text: ``required`` tells which.

Case is ignored among A to Z before the confirmation, so that patterns under ``(?i)`` have literals too.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ascii_lower
from textloom.operators import grams
from textloom.plans.lineage import BROADCAST_BYTES, checked_broadcast, checkpointed, row_bytes

#: Shortest literal that is looked up; most alternatives of a group; most of a set of characters that counts as alternatives.
SHORTEST, MOST, MOST_CHARS = 3, 16, 4
#: First bytes of a literal that are looked up: the most that it has. Bytes of texts that are looked at together, and at once.
WIDTHS, TOGETHER, AT_ONCE = (8, 5, 3), 2 << 20, 1 << 20
#: What reads differently in another dialect, or may.
UNSURE = re.compile(r"\\[vVZzQEGhHRXk]|&&|\(\?[a-z]*[xua]|\[\^?\[")

Group = frozenset


class _Reader:
    """Reads a parsed pattern from left to right. ``exact`` is the set of what the text read last may
    be, as far back as it is known; ``groups`` are the sets of literals that every match must have one of."""

    def __init__(self):
        self.groups: list[Group] = []
        self.exact: set[str] = {""}

    def flush(self) -> None:
        """What comes next is not known: what was known becomes a group, if all of it is long enough."""
        if min(map(len, self.exact)) >= SHORTEST:
            self.groups.append(Group(self.exact))
        self.exact = {""}

    def follow(self, options: set[str]) -> None:
        """One of ``options`` comes next."""
        if len(self.exact) * len(options) > MOST:
            self.flush()
        if len(options) > MOST:
            self.exact = {""}
        else:
            self.exact = {a + b for a in self.exact for b in options}

    def sequence(self, items) -> None:
        for op, value in items:
            self.item(op, value)

    def item(self, op, value) -> None:
        if op is C.LITERAL:
            self.follow({chr(value)})
        elif op is C.IN and (options := _characters(value)):
            self.follow(options)
        elif op is C.SUBPATTERN:
            self.sequence(value[3])
        elif op is C.ATOMIC_GROUP:
            self.sequence(value)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            self.repeat(*value)
        elif op is C.BRANCH:
            self.branch(value[1])
        elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):  # these take no text
            self.flush()

    def repeat(self, least: int, most: int, items) -> None:
        for _ in range(min(least, MOST)):
            self.sequence(items)
        if most != least or least > MOST:
            self.flush()

    def branch(self, options) -> None:
        read = [_read(x) for x in options]
        if all(not groups and exact is not None for groups, exact in read):
            return self.follow(set().union(*(exact for _, exact in read)))
        self.flush()
        # One group of each alternative, if each has any, makes a group of all.
        best = [max([*groups, *([Group(exact)] if exact and min(map(len, exact)) >= SHORTEST else [])], key=_worth, default=None) for groups, exact in read]
        if all(best) and len(every := Group().union(*best)) <= 4 * MOST:
            self.groups.append(every)


def _worth(group: Group) -> tuple:
    return min(map(len, group)), -len(group)


def _read(items) -> tuple[list[Group], set[str] | None]:
    """The groups of a part of a pattern, and all that it may match if that is known."""
    reader = _Reader()
    reader.sequence(items)
    known = not reader.groups and all(op in (C.LITERAL, C.AT) for op, _ in items)
    if known:
        return [], reader.exact
    reader.flush()
    return reader.groups, None


def _characters(options) -> set[str] | None:
    """The characters of a small set; None for a large or a negated one."""
    out = set()
    for op, value in options:
        if op is C.LITERAL:
            out.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < MOST_CHARS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def lower(text: str) -> str:
    """A to Z in lower case, as ``ascii_lower`` makes them."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def required(pattern: str) -> list[list[str]]:
    """RE-1 (M): groups of literals in lower case, one of each of which any match has; none for patterns that have
    to be tried on every text."""
    if UNSURE.search(pattern):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return []
    reader = _Reader()
    reader.sequence(parsed)
    reader.flush()
    return [sorted({lower(x) for x in group}) for group in reader.groups]


def literals(patterns: DataFrame) -> DataFrame:
    """``(pattern_id, n_groups, grp, literal)``: one row a literal of ``patterns`` (pattern_id, pattern)."""
    groups = patterns.select("pattern_id", F.udf(required, "array<array<string>>")("pattern").alias("groups")).where(F.size("groups") > 0)
    one = groups.select("pattern_id", F.size("groups").alias("n_groups"), F.posexplode("groups").alias("grp", "any"))
    return one.select("pattern_id", "n_groups", "grp", F.explode("any").alias("literal"))


def candidates(texts: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(id, pattern_id)``: texts that have a window of a literal of every group."""
    found = checked_broadcast(grams.windows(wanted, "literal").select("pattern_id", "n_groups", "grp", "cut", "gram").distinct())
    hits = None
    for cut in grams.cuts_in(found):
        rows = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(grams.grams_of(ascii_lower(F.col(text_col)), cut))).alias("gram"))
        own = rows.join(found.where(F.col("cut") == cut), "gram").select("id", "pattern_id", "n_groups", "grp")
        hits = own if hits is None else hits.union(own)
    if hits is None:
        return texts.select(F.col(id_col).alias("id")).join(wanted.select("pattern_id"), F.lit(False))
    every = hits.groupBy("id", "pattern_id", "n_groups").agg(F.collect_set("grp").alias("groups"))
    return every.where(F.size("groups") == F.col("n_groups")).select("id", "pattern_id")


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts, the row each of as many places belongs to, and the number of each within its row."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Literals:
    """Literals by their first bytes: ``keys`` of each width in order, for each key its literals, and for each literal its groups, which
    are numbered over all patterns."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        rows = [(p, g, x.encode()) for p, g, x in rows]
        self.patterns = np.unique(np.array([p for p, _, _ in rows], np.int64))
        groups = {x: i for i, x in enumerate(sorted({(p, g) for p, g, _ in rows}))}
        self.pattern_of = np.searchsorted(self.patterns, np.array([p for p, _ in groups], np.int64))
        self.needed = np.bincount(self.pattern_of, minlength=len(self.patterns))
        kind = lambda x: next(i for i, w in enumerate(WIDTHS) if len(x) >= w)
        known = sorted({(kind(x), int.from_bytes(x[: WIDTHS[kind(x)]], "little"), x) for _, _, x in rows})
        self.keys = [np.unique(np.array([k for i, k, _ in known if i == n], np.uint64)) for n in range(len(WIDTHS))]
        self.lengths = np.array([len(x) for _, _, x in known], np.int64)
        self.tails = np.array([int.from_bytes(x[len(x) - WIDTHS[i] :], "little") for i, _, x in known], np.uint64)
        places = [sum(map(len, self.keys[:i])) + int(np.searchsorted(self.keys[i], np.uint64(k))) for i, k, _ in known]
        self.of_key = np.searchsorted(places, np.arange(sum(map(len, self.keys)) + 1))
        number = {x: n for n, (_, _, x) in enumerate(known)}
        pairs = sorted({(number[x], groups[p, g]) for p, g, x in rows})
        self.groups = np.array([g for _, g in pairs], np.int64)
        self.starts = np.searchsorted([n for n, _ in pairs], np.arange(len(known) + 1))

    def first(self) -> np.ndarray:
        """Which three bytes begin a literal."""
        out = np.zeros(1 << 24, bool)
        for keys in self.keys:
            out[(keys & np.uint64(0xFFFFFF)).astype(np.int64)] = True
        return out

    def hits(self, data: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The distinct literals in texts, as text * number of literals + literal, of texts that lie in ``data`` one after the other, with
        eight bytes more. The first and the last eight, five or three bytes of a literal are compared."""
        total, out = len(self.lengths), [np.zeros(0, np.int64)]
        for begin in range(0, len(data) - 8, AT_ONCE):
            part = data[begin : min(begin + AT_ONCE, len(data) - 8) + 2].astype(np.int32)
            at = begin + np.flatnonzero(first[part[:-2] | part[1:-1] << 8 | part[2:] << 16])
            eight = data[at[:, None] + np.arange(8)].view("<u8").ravel()
            text = np.searchsorted(ends, at, "right")
            room, base = ends[text] - at, 0
            for width, keys in zip(WIDTHS, self.keys):
                if len(keys):
                    mask = np.uint64((1 << 8 * width) - 1)
                    place = np.minimum(np.searchsorted(keys, eight & mask), len(keys) - 1)
                    met = np.flatnonzero(keys[place] == eight & mask)
                    key = base + place[met]
                    row, inner = _spread(self.of_key[key + 1] - self.of_key[key])
                    literal, met = self.of_key[key][row] + inner, met[row]
                    fits = self.lengths[literal] <= room[met]
                    literal, met = literal[fits], met[fits]
                    tail = at[met] + self.lengths[literal] - width
                    same = data[tail[:, None] + np.arange(8)].view("<u8").ravel() & mask == self.tails[literal]
                    out.append(np.unique(text[met[same]] * total + literal[same]))
                base += len(keys)
        return np.unique(np.concatenate(out))

    def candidates(self, data: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts, in order, and for each a pattern whose groups it has literals of."""
        text, literal = np.divmod(self.hits(data, ends, first), max(1, len(self.lengths)))
        row, inner = _spread(self.starts[literal + 1] - self.starts[literal])
        met = np.unique(text[row] * len(self.pattern_of) + self.groups[self.starts[literal][row] + inner])
        text, group = np.divmod(met, max(1, len(self.pattern_of)))
        both, n = np.unique(text * len(self.patterns) + self.pattern_of[group], return_counts=True)
        text, pattern = np.divmod(both, max(1, len(self.patterns)))
        whole = n == self.needed[pattern]
        return text[whole], self.patterns[pattern[whole]]


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive texts of ``TOGETHER`` bytes at most, or one longer text."""
    i = 0
    while i < len(ends):
        begin = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, begin + TOGETHER, "right")))
        yield i, j
        i = j


def located(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` (id, text) with ``pattern_id``, a row for each pattern of ``wanted`` whose groups the text has literals of."""
    rows = wanted.select("pattern_id", "grp", "literal").collect()
    shared = texts.sparkSession.sparkContext.broadcast(Literals([tuple(r) for r in rows]))
    lower_case = np.arange(256, dtype=np.uint8)
    lower_case[65:91] += 32
    names = ["id", "text", "found"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        first = known.first()
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            for i, j in _slices(bounds[1:] - bounds[0]):
                size = bounds[j] - bounds[i]
                data = np.zeros(size + 8, np.uint8)
                if size:
                    data[:size] = lower_case[np.frombuffer(column.buffers()[2], np.uint8, size, bounds[i])]
                text, pattern = known.candidates(data, bounds[i + 1 : j + 1] - bounds[i], first)
                met, n = np.unique(text, return_counts=True)
                part = batch.slice(i, j - i).take(pa.array(met))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(pattern))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(look, f"id {kind}, text string, found array<long>").select("id", "text", F.explode("found").alias("pattern_id"))


def matches(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """RE-1 (M): the distinct ``(id, pattern_id)`` such that a text of the id has a match of the pattern, for ``patterns``
    (pattern_id, pattern). Rows without an id or a text take no part."""
    rules = checkpointed(patterns.select("pattern_id", "pattern").distinct().withColumn("no", F.monotonically_increasing_id()))
    wanted = checkpointed(literals(rules.select(F.col("no").alias("pattern_id"), "pattern")))
    texts = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    size = wanted.agg(F.sum(row_bytes(wanted)).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        tried = located(texts, wanted)
    else:
        # Texts stay where they are if the candidates were measured to be few; else both sides are shuffled by id.
        tried = texts.join(checked_broadcast(candidates(texts, "id", "text", wanted)), "id")
    tried = tried.withColumnRenamed("pattern_id", "no").join(checked_broadcast(rules), "no")
    confirmed = tried.where(F.regexp_like("text", "pattern")).select("id", "pattern_id")
    rest = checkpointed(rules.join(wanted.select(F.col("pattern_id").alias("no")).distinct(), "no", "left_anti"))
    if not rest.isEmpty():
        confirmed = confirmed.union(texts.join(checked_broadcast(rest), F.regexp_like("text", "pattern")).select("id", "pattern_id"))
    return confirmed.distinct().withColumnRenamed("id", id_col)
