"""Substring dedup by fixed-block anchors.

Every document is cut into blocks of ``BLOCK`` words, one after the other; those are the anchors. All
rolling windows of ``BLOCK`` words probe them. A window of 13 words holds a whole block of its own
document wherever it starts, and that block is found by a rolling window of any other document that
has the same 13 words, so an anchor that no other document probes rules its windows out. Around the
anchors that were hit, the 13-word windows are compared themselves: neighbouring windows that are
found elsewhere join to the maximal exact repeats, whose words are removed unless the document with
the smallest id is the only one to have them.

Defined results
---------------
* Null and empty texts have no words. Texts under 13 words are kept whole.
* A window is removed if it starts in a row with a smaller id; rows that share an id, repeated ones
  included, do not remove from each other. A row with a null id is kept whole and removes nothing.
* Windows are judged on the input. An empty table gives an empty table; other columns are not read.
* Texts of any length are taken whole; one longer than ``WORDS_AT_ONCE`` words is settled alone.
* Words are told apart by 64-bit hashes, windows that are removed by 96 bits of two hashes: of 1e13
  different windows, two agree with a probability under one in a thousand.

At scale
--------
Both rounds send packed blocks of hashes, about six bytes a word, to buckets by hash. Before that a
task settles what its own rows show: a hash that two of its documents share is sent once however many
share it, so a passage in a third of all rows meets its bucket once a task, not once a row. Texts are
shuffled once, by id, and both rounds and the result read that exchange. A bucket holds some million
words: there is one for each ``BUCKET_BYTES`` of text, as measured, and no fewer than two for each of
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.packing import mixed, pack, unpack, window_hashes, word_hashes

#: Production parameters: words of a window, and of a block (2 * BLOCK - 1 <= WINDOW).
WINDOW, BLOCK = 13, 7
#: Words that a task settles at once; bytes of text for a bucket.
WORDS_AT_ONCE, BUCKET_BYTES = 1_000_000, 24 << 20
#: Buckets for each home, which gathers what is found for a share of the documents: findings are a
#: small part of what is sent, and each bucket writes to every home.
BUCKETS_A_HOME = 8
SENT = "bucket int, home int, data binary"
REPLY = "home int, data binary"
HITS = "id long, check long, hits binary"


class Sender:
    """Rows of the format ``SENT``: blocks of hashes for the buckets, and blocks of places found, which
    have the number of the home that gathers what is found for their documents."""

    def __init__(self, buckets: int):
        self.buckets, self.homes, self.rows = buckets, homes_of(buckets), []

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The bucket of each hash; in the order of the hashes."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)

    def found(self, ids: np.ndarray, checks: np.ndarray, at: np.ndarray) -> None:
        """``at`` holds places in the rows with these ids and checks."""
        self.rows += [(home * BUCKETS_A_HOME, home, data) for home, data in by_home(ids, checks, at, self.homes)]

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 3
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "home", "data"])


def homes_of(buckets: int) -> int:
    return -(-buckets // BUCKETS_A_HOME)


def by_home(ids: np.ndarray, checks: np.ndarray, at: np.ndarray, homes: int) -> Iterator[tuple[int, bytes]]:
    """(id, check, place) triples as one block for each home."""
    home = ((mixed(ids.astype(np.uint64)) >> np.uint64(32)) * np.uint64(homes)) >> np.uint64(32)
    order = np.lexsort((at, checks, ids, home))
    home, ids, checks, at = home[order], ids[order], checks[order], at[order]
    for i, j in edges(home):
        heads = i + np.flatnonzero(new_pair(ids[i:j], checks[i:j]))
        yield int(home[i]), pack(ids[heads].view(np.uint64), checks[heads], np.diff(np.append(heads, j)), at[i:j])


def new_pair(ids: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where a sorted list of (id, check) goes on to the next pair."""
    return np.concatenate(([True], (ids[1:] != ids[:-1]) | (checks[1:] != checks[:-1])))


def group_starts(sorted_keys: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Where a key, or the second of a pair of keys, differs from the one before."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = sorted_keys[1:] != sorted_keys[:-1]
    new = new if more is None else new | (more[1:] != more[:-1])
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value of each group, for each of its members."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def settled_blocks(hashes, more, row, at, ids, checks, send: Sender) -> None:
    """Round one over some rows: which anchors are probed by two documents, here or elsewhere."""
    order = np.argsort(hashes, kind="stable")
    h, row, at = hashes[order], row[order], at[order]
    starts = group_starts(h)
    doc = ids[row]
    several = spread(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), starts, len(h))
    anchor = at % BLOCK == 0
    hit = several & anchor
    send.found(doc[hit], checks[row[hit]], at[hit])
    first = np.zeros(len(h), bool)
    first[starts] = True
    probe_only = first & ~spread(np.logical_or.reduceat(anchor, starts), starts, len(h))
    sent = np.where(several, first, anchor | probe_only)
    h, row, at, several, anchor = h[sent], row[sent], at[sent], several[sent], anchor[sent]
    bucket = send.place(h)
    for b, part in ((int(bucket[i]), slice(i, j)) for i, j in edges(bucket)):
        own, number = np.unique(row[part], return_inverse=True)
        reply = anchor[part] & ~several[part]
        what = number * 4 + reply * 2 + several[part]
        short = h[part] >> np.uint64(16)
        steps = np.diff(short, prepend=np.uint64(0))
        send.rows.append((b, None, pack(steps, what, at[part][reply], ids[own].view(np.uint64), checks[own])))


def edges(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = group_starts(bucket)
    return zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist())


def met_blocks(blocks: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Round one in a bucket: (id, check, place) of the anchors that another document probes."""
    h = np.concatenate([np.cumsum(b[0]) for b in blocks])
    what = np.concatenate([b[1] for b in blocks])
    ids = np.concatenate([b[3].view(np.int64)[(b[1] >> np.uint64(2)).astype(np.int64)] for b in blocks])
    checks = np.concatenate([b[4][(b[1] >> np.uint64(2)).astype(np.int64)] for b in blocks])
    several, reply = (what & np.uint64(1)).astype(bool), (what & np.uint64(2)).astype(bool)
    at = np.zeros(len(h), np.int64)
    at[reply] = np.concatenate([b[2] for b in blocks]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, ids, checks, several, reply, at = (x[order] for x in (h, ids, checks, several, reply, at))
    starts = group_starts(h)
    shared = np.logical_or.reduceat(several, starts) | (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts))
    hit = spread(shared, starts, len(h)) & reply
    return ids[hit], checks[hit], at[hit]


def settled_windows(hashes, more, row, at, ids, checks, send: Sender) -> None:
    """Round two over some rows: a window is a repeat if a row here has it under a smaller id; those
    of the smallest id here are asked for elsewhere."""
    order = np.lexsort((more, hashes))
    h, more, row, at = hashes[order], more[order], row[order], at[order]
    starts = group_starts(h, more)
    doc = ids[row]
    repeat = doc > spread(np.minimum.reduceat(doc, starts), starts, len(h))
    send.found(doc[repeat], checks[row[repeat]], at[repeat])
    h, more, row, at = h[~repeat], more[~repeat], row[~repeat], at[~repeat]
    bucket = send.place(h)
    for b, part in ((int(bucket[i]), slice(i, j)) for i, j in edges(bucket)):
        own, number = np.unique(row[part], return_inverse=True)
        steps = np.diff(h[part], prepend=np.uint64(0))
        send.rows.append((b, None, pack(steps, number, at[part], ids[own].view(np.uint64), checks[own], more[part])))


def met_windows(blocks: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Round two in a bucket: (id, check, place) of the windows that a smaller id has as well."""
    h = np.concatenate([np.cumsum(b[0]) for b in blocks])
    ids = np.concatenate([b[3].view(np.int64)[b[1].astype(np.int64)] for b in blocks])
    checks = np.concatenate([b[4][b[1].astype(np.int64)] for b in blocks])
    at = np.concatenate([b[2] for b in blocks]).astype(np.int64)
    more = np.concatenate([b[5] for b in blocks])
    order = np.lexsort((more, h))
    h, more, ids, checks, at = (x[order] for x in (h, more, ids, checks, at))
    starts = group_starts(h, more)
    repeat = ids > spread(np.minimum.reduceat(ids, starts), starts, len(h))
    return ids[repeat], checks[repeat], at[repeat]


NO_WINDOWS = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)


def block_windows(words: np.ndarray, _: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling windows of a block's length, nothing more, and where they start."""
    if len(words) < WINDOW:
        return NO_WINDOWS
    h = window_hashes(words, BLOCK)
    return h, h[:0], np.arange(len(h))


def places(hits: bytes | None) -> np.ndarray:
    return unpack(hits)[0].astype(np.int64) if hits else np.zeros(0, np.int64)


def windows_at_hits(words: np.ndarray, hits: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 13-word windows that hold an anchor that was hit: hashes, 32 bits of others, and places."""
    anchors = places(hits)
    if not len(anchors):
        return NO_WINDOWS
    starts = np.unique(anchors[:, None] - np.arange(WINDOW - BLOCK + 1))
    starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
    return window_hashes(words, WINDOW)[starts], window_hashes(words, WINDOW, WINDOW)[starts] >> np.uint64(32), starts


def texts_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def round_of(rows: DataFrame, windows, settle, meet, buckets: int) -> DataFrame:
    """``rows`` (id, check, text, hits) to ``HITS``: the places that ``meet`` finds."""
    with_hits = "hits" in rows.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = [len(x[0]) for x in held]
            h, more, at = (np.concatenate([x[k] for x in held]) for k in range(3))
            ids, checks = (np.array([x[k] for x in held], np.int64) for k in (3, 4))
            settle(h, more, np.repeat(np.arange(len(held)), n), at, ids, checks, out)
            return out.batch()

        for batch in batches:
            ids, checks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (doc, check) in enumerate(zip(ids, checks)):
                hits = batch.column(3)[i].as_py() if with_hits else None
                if with_hits and not hits:
                    continue
                h, more, at = windows(word_hashes(texts_words(batch.column(2)[i].as_py())), hits)
                if len(h):
                    held.append((h, more, at, doc, check))
                    size += len(h)
                if size >= WORDS_AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def receive(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        passed = table.filter(table.column("home").is_valid()).select(["home", "data"])
        blocks = [unpack(x.as_py()) for x in table.filter(table.column("home").is_null()).column("data")]
        columns = list(zip(*by_home(*meet(blocks), homes_of(buckets)))) if blocks else []
        columns = columns or [(), ()]
        more = pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], names=["home", "data"])
        return pa.concat_tables([passed.cast(more.schema), more])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """All places that were found for each row, as one block."""
        blocks = [unpack(x.as_py()) for x in table.column("data")]
        n = np.concatenate([b[2] for b in blocks]).astype(np.int64)
        ids, checks = np.repeat(np.concatenate([b[0] for b in blocks]).view(np.int64), n), np.repeat(np.concatenate([b[1] for b in blocks]), n)
        at = np.concatenate([b[3] for b in blocks])
        order = np.lexsort((at, checks, ids))
        ids, checks, at = ids[order], checks[order].astype(np.int64), at[order]
        heads = np.flatnonzero(new_pair(ids, checks))
        data = map(pack, np.split(at, heads[1:]))
        return pa.Table.from_arrays([pa.array(ids[heads]), pa.array(checks[heads]), pa.array(data, pa.binary())], names=["id", "check", "hits"])

    met = rows.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(receive, REPLY)
    return met.groupBy("home").applyInArrow(gather, HITS)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each document's id, ``n_words``, ``n_removed`` and ``kept``, its kept words joined by a space."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n = buckets
    if n is None:
        size = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
        n = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    # The rows of one id are told apart by 32 bits of a hash of their texts.
    check = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), check.alias("check"), text.alias("text"))
    known = rows.where(F.col("id").isNotNull())

    def joined(hits: DataFrame, how: str) -> DataFrame:
        return known.join(hits, ["id", "check"], how).select("id", "check", "text", "hits")

    first = round_of(known, block_windows, settled_blocks, met_blocks, n)
    second = round_of(joined(first, "inner"), windows_at_hits, settled_windows, met_windows, n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, gone_n, kept = [], [], []
            for text, hits in zip(batch.column(2), batch.column(3)):
                words = texts_words(text.as_py())
                starts = places(hits.as_py())
                words_n.append(len(words))
                if len(starts):
                    gone = np.zeros(len(words), bool)
                    gone[(starts[:, None] + np.arange(WINDOW)).ravel()] = True
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                gone_n.append(words_n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    unnamed = rows.where(F.col("id").isNull()).withColumn("hits", F.lit(None).cast("binary"))
    out = joined(second, "left").unionByName(unnamed).mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
