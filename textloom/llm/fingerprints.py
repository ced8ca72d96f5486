"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut further after the ends of sentences, so that a text without line ends has several too.
Each paragraph's digest (with its number among equal ones, so that repeats count) is added to one cell of each of three
parts of a sketch; a cell holds a count, the XOR of its digests and the XOR of their checks. One sketch subtracted from another
leaves only what differs. A cell with one digest left is pure: its digest is taken out of its other cells, which
may make these pure, until nothing is left. Where that stops early, both sketches are made again, larger. The recovered digests of either side give the exact overlap of the two multisets of paragraphs.

Defined results
---------------
* Null, empty and blank texts have no paragraph; the likeness of two of them is 1, to any other text it is 0.
* The fingerprint is the number of paragraphs and the sketch of the first size, in base 64; equal texts have equal ones.
* Documents follow each other by descending id; null ids come last, rows with the same id are ordered by their text's hash, and
  after the last row comes the first. A single row follows itself.
* Texts of any length are taken whole; repeated rows are taken one by one. An empty table stays empty. Other columns
  are not read.

At scale
--------
Texts are shuffled once, to ranges of ids (at most about ``PART_BYTES`` of texts in each, by a sort of ids and hashes alone, whose
ends, a row a range, are all that comes to the driver). The last document of a range also goes to the next one, so that each
task reads its rows in order and holds blocks of ``AT_ONCE`` characters, or one longer text, however long the range.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.packing import mixed
from textloom.llm.vocabulary import blocks

#: Production parameters: cells of the first size, parts of a sketch, growth of its size after a failure, cells for each digest
#: that is expected to differ; bytes of texts in a range; characters of texts that are compared at once.
CELLS, PARTS, GROWTH, ROOM, PART_BYTES, AT_ONCE = 24, 3, 2, 1.4, 64 << 20, 1_000_000
#: Ends of lines, and the white space after the end of a sentence.
BORDER = re.compile(r"\n+|(?<=[.!?;:…。！？])[\x20\x09\x0B-\x0D]+")

#: What a digest is salted with for each part.
SALTS = np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)

NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
KINDS = ("bigint", "string", "string", "string", "double", "double")


def paragraphs(text: str) -> list[str]:
    """The paragraphs that have more than white space."""
    return [p for x in BORDER.split(text) if (p := x.strip("\x20\x09\x0b\x0c\r"))]


def numbered(paragraph: str, times: int) -> np.ndarray:
    """The digests of the first ``times`` occurrences of a paragraph."""
    first = np.uint64(xxhash.xxh3_64_intdigest(paragraph.encode("utf-8", "surrogatepass")))
    return first ^ mixed(np.arange(times, dtype=np.uint64))  # the first has its own hash, as 0 is mixed to 0


def digests(text: str) -> np.ndarray:
    """One 64-bit digest a paragraph, the k-th of equal ones with its k; all different."""
    times = Counter(paragraphs(text))
    plain = np.fromiter((xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in times), np.uint64, len(times))
    repeated = [numbered(p, n)[1:] for p, n in times.items() if n > 1] if len(times) < times.total() else []
    return np.unique(np.concatenate([plain, *repeated])) if repeated else plain


class Digests:
    """The digests of several texts, one after the other."""

    def __init__(self, each: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.keys = np.concatenate([np.zeros(0, np.uint64), *each])

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of some texts, and for each its text's place among them."""
        sizes = self.sizes[texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.keys[self.starts[texts][owner] + within], owner


def checks(keys: np.ndarray) -> np.ndarray:
    """What tells a cell of one digest from a cell of several."""
    return mixed(keys ^ np.uint64(0xA5A5F00D5EED1234))


class Sketches:
    """Sketches of several texts: counts, digests and checks of their cells, one after the other."""

    def __init__(self, cells: np.ndarray, values: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.cells, self.starts, every = cells, np.cumsum(cells) - cells, int(cells.sum())
        self.counts, self.keys, self.checks = values or (np.zeros(every, np.int64), np.zeros(every, np.uint64), np.zeros(every, np.uint64))

    def add(self, keys: np.ndarray, owner: np.ndarray, signs: np.ndarray | int = 1) -> Sketches:
        """Adds digests to the sketches of their texts; those with the sign -1 are taken out."""
        own, width = checks(keys), self.cells[owner] // PARTS
        for k in range(PARTS):
            at = self.starts[owner] + k * width + (mixed(keys + SALTS[k]) % width.astype(np.uint64)).astype(np.int64)
            np.add.at(self.counts, at, signs)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, own)
        return self

    def rows(self, texts: np.ndarray) -> Sketches:
        """The sketches of some texts, where all have as many cells."""
        of = lambda x: x.reshape(len(self.cells), -1)[texts].ravel()
        return Sketches(self.cells[texts], (of(self.counts), of(self.keys), of(self.checks)))

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.cells, (self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def differing(self) -> np.ndarray:
        """About how many digests two subtracted sketches differ in: signs are random but for their sum, so
        that the squares of the counts add up to their number and the square of what is the same in all cells."""
        width, net = self.cells // PARTS, self.sums(self.counts) // PARTS
        squares = self.sums(self.counts * self.counts) / PARTS
        return np.maximum(np.abs(net), (squares - net * net / width) / (1 - 1 / width))

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests that only one side of a subtraction has, with their sketch and the side's sign, and whether
        each sketch failed: it has cells left that are not pure. Empties the sketches that do not fail.

        A digest has one cell in each part, so that the pure cells of one part hold different ones."""
        owner = np.repeat(np.arange(len(self.cells)), self.cells)
        width = self.cells // PARTS
        part = (np.arange(len(owner)) - self.starts[owner]) // width[owner]
        of_part = [np.flatnonzero(part == k) for k in range(PARTS)]
        found, idle, k = [], 0, 0
        while idle < PARTS and len(found) < len(owner):
            pure = of_part[k][np.abs(self.counts[of_part[k]]) == 1]
            pure = pure[checks(self.keys[pure]) == self.checks[pure]]
            idle = 0 if len(pure) else idle + 1
            if len(pure):
                found.append((self.keys[pure], owner[pure], self.counts[pure]))
                self.add(found[-1][0], found[-1][1], -found[-1][2])
            k = (k + 1) % PARTS
        left = (self.counts != 0) | (self.keys != 0) | (self.checks != 0)
        keys, at, signs = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2), *found))
        return keys, at, signs, self.sums(left.astype(np.int64)) > 0


def first_sketches(found: Digests) -> Sketches:
    every = np.arange(len(found.sizes))
    return Sketches(np.full(len(every), CELLS)).add(*found.of(every))


def differences(found: Digests, first: Sketches, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests that only one text of each pair ``(a, b)`` has: digest, pair, and 1 for the pair's first
    text or -1 for its second. Pairs that fail are tried again, with cells that suit the difference which the
    counts show, and twice as many at least."""
    todo, cells = np.arange(len(a)), np.full(len(a), CELLS)
    rest, done = first.rows(a).minus(first.rows(b)), []
    while len(todo):
        about = rest.differing()
        keys, at, signs, failed = rest.peeled()
        good = ~failed[at]
        done.append((keys[good], todo[at[good]], signs[good]))
        todo, cells = todo[failed], cells[failed] * GROWTH
        while (small := cells < ROOM * about[failed]).any():
            cells[small] *= GROWTH
        if len(todo):
            rest = Sketches(cells).add(*found.of(a[todo])).minus(Sketches(cells).add(*found.of(b[todo])))
    return tuple(np.concatenate(x) for x in zip(*done))


def likenesses(found: Digests, first: Sketches, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of texts the paragraphs in common, as a share of all."""
    _, pair, sign = differences(found, first, a, b)
    mine, theirs = (np.bincount(pair[sign == s], minlength=len(a)) for s in (1, -1))
    both = found.sizes[a] - mine
    every = both + mine + theirs
    return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def packed(found: Digests, first: Sketches) -> list[str]:
    """The fingerprint of each text: its number of paragraphs and its sketch."""
    rows = [x.astype(kind).reshape(-1, CELLS) for x, kind in ((first.counts, "<i4"), (first.keys, "<u8"), (first.checks, "<u8"))]
    return [base64.b64encode(b"".join((n.tobytes(), *(x.tobytes() for x in of)))).decode() for n, *of in zip(found.sizes.astype("<i8"), *rows)]


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(texts: list[str], before: str) -> list[pa.Array]:
    """The columns of ``NAMES`` for texts each of which is followed by the one in front of it."""
    n = len(texts)
    changed = [edited(t, following) for t, following in zip(texts, [before, *texts])]
    found = Digests([digests(t) for t in (before, *texts, *changed)])
    first, own = first_sketches(found), np.arange(1, n + 1)
    near = likenesses(found, first, np.concatenate([own, own]), np.concatenate([own + n, own - 1]))
    prints = packed(found, first)
    shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [pa.array(x) for x in ([len(t) for t in texts], shas, prints[1 : n + 1], prints[n + 1 :], near[:n], near[n:])]


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(guest, id, text)`` of a range in ascending order to results: the row before is the one that
    follows by descending id, and a range begins with its guest."""
    before = ""
    for batch in batches:
        guests = sum(batch.column(0).to_pylist())
        if guests:
            before = batch.column(2)[guests - 1].as_py()
        at = guests
        for block in blocks((x.as_py() for x in batch.column(2).slice(guests)), AT_ONCE):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(block)), *compared(block, before)], ["id", *NAMES])
            at, before = at + len(block), block[-1]


def key_of(i: object, tie: int) -> tuple:
    """Null ids before all others."""
    return (i is not None, 0 if i is None else i, tie)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document's id, ``n_chars``, the SHA-256 of its edited text, both fingerprints, and their likeness
    to each other and to the next document's."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(NAMES, KINDS))])
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    keys = rows.select("id", "tie").repartitionByRange(ranges, F.asc_nulls_first("id"), "tie")
    lasts = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct(F.col("id").isNotNull(), "id", "tie")).alias("last")).collect()
    ends = sorted(key_of(r["last"]["id"], r["last"]["tie"]) for r in lasts)

    @F.arrow_udf("array<struct<part:int,guest:boolean>>")
    def dealt(ids: pa.Array, ties: pa.Array) -> pa.Array:
        out = []
        for i, tie in zip(ids.to_pylist(), ties.to_pylist()):
            part = bisect_left(ends, key := key_of(i, tie))
            out.append([{"part": part, "guest": False}])
            if ends[part] == key:
                out[-1].append({"part": (part + 1) % len(ends), "guest": True})
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("guest", pa.bool_())])))

    sent = rows.select("id", "text", "tie", F.explode(dealt("id", "tie")).alias("to")).select("to.part", "to.guest", "id", "text", "tie")
    ordered = sent.repartitionById(max(1, len(ends)), "part").sortWithinPartitions(F.desc("guest"), F.asc_nulls_first("id"), "tie")
    result = ordered.select("guest", "id", "text").mapInArrow(paired, out)
    return result.withColumnRenamed("id", id_col)


def changed_paragraphs(versions: DataFrame, old_col: str, new_col: str) -> DataFrame:
    """``versions`` with arrays ``removed`` and ``added``: the paragraphs whose digests peeling recovers for one
    version alone, a repeated one once, in the order of its text."""
    kept = [F.col(f"`{c}`") for c in versions.columns if c.lower() not in ("removed", "added")]
    old, new = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (old_col, new_col))
    rows = versions.select(F.struct(*kept).alias("row"), old.alias("old"), new.alias("new"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(x, T.ArrayType(T.StringType())) for x in ("removed", "added"))])

    def named(text: str, gone: np.ndarray) -> list[str]:
        return [p for p in dict.fromkeys(paragraphs(text)) if np.isin(numbered(p, text.count(p)), gone).any()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                both = Digests([digests(a), digests(b)])
                keys, _, sign = differences(both, first_sketches(both), np.array([0]), np.array([1]))
                lists = [pa.array([named(t, keys[sign == s])], pa.list_(pa.string())) for t, s in ((a, 1), (b, -1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *lists], ["row", "removed", "added"])

    return rows.mapInArrow(compare, schema).select("row.*", "removed", "added")
