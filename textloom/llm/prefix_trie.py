"""A prefix trie of conversations, by partition refinement.

All conversations begin in one class. A round splits the active classes by their next turns: a class that is left with one
conversation retires, and the rest of that conversation becomes a chain of nodes without any further grouping. A round takes as many
turns as all rounds before it, up to ``MOST_TURNS``, so that their number grows with the logarithm of the depth at which the
last two conversations part. Within a round classes are told apart by a label for each turn: the XOR of two 64-bit hashes for each
(place, turn) up to it. Folding back sums leaves and saved bytes: each node's share is put on the row of its smallest member, a
conversation's rows are summed from the last to the first, and then by class.

Defined results
---------------
* Turns are ordered by turn (null first), then role, then MD5 of the text; repeated rows are turns of their own. Null role and
  text are empty. Rows without a conversation id belong to none and are left out.
* A node's members are those that begin with its turns; it is named by its smallest member and its depth. A conversation
  without turns is a member of the root alone. Texts of any length are taken whole; they count by length and digest.
* An empty table has no conversation and no node. Other columns are not read.

At scale
--------
Texts are read once and never shuffled: a turn goes on as two 60-bit parts of its MD5 digest and its length. Places of turns come from
a sort by ranges (``plans.ranks``), so a conversation with very many turns is no single task's. Rounds read only their own
turns (written by block) of conversations that are still active. Classes are grouped with partial sums; joins back are by
(conversation, place), which is unique, but for a node's children, whose hot parents AQE splits. The ids that end at a node are
sorted by ranges, joined to strings of ``PIECE`` ids, and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpointed, stage_path
from textloom.plans.ranks import numbered

#: Production parameters: turns of a round at most (a power of two), ids in one piece of a digest.
MOST_TURNS, PIECE = 4096, 2048
#: Of the rebuilt conversations: how many share a base, and most turns taken from it less one.
FAMILY, HEADS = 5, 9

TURN = "conv_id bigint, depth bigint, k1 bigint, k2 bigint, n_bytes bigint, ends boolean"
CLASS = ("depth", "l1", "l2")
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, k1, k2, n_bytes)``: each turn with its place from 1, as its digest and length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(f"k{i}") for i, at in ((1, 1), (2, 16))]
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), *halves, F.octet_length(text).cast("long").alias("n_bytes"))
    placed = numbered(rows, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("k1"), F.asc("k2")], ["conv_id"])
    return placed.select("conv_id", "place", "k1", "k2", "n_bytes")


def as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: ``(conv_id, n_turns)``, and their turns as ``TURN``."""
    every = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    rows = turns.join(every, "conv_id").select("conv_id", F.col("place").alias("depth"), "k1", "k2", "n_bytes", (F.col("place") == F.col("n_turns")).alias("ends"))
    return every, rows


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % 5 in place of its own
    first h, where h follows from c's checksum."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    c = F.col("conv_id")
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    shaped = own.select("*", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string").cast("binary")) % HEADS).alias("h")).join(bases, "base", "left")
    taken = shaped.withColumn("taken", F.least(F.col("h"), F.coalesce("base_turns", F.lit(0))))
    plan = checkpointed(taken.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")))
    heads = turns.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base").join(plan, "base").where(F.col("place") <= F.col("taken")).withColumn("depth", F.col("place"))
    rest = turns.join(plan, "conv_id").where(F.col("place") > F.col("h")).withColumn("depth", F.col("taken") + F.col("place") - F.col("h"))
    columns = ["conv_id", "depth", "k1", "k2", "n_bytes", (F.col("depth") == F.col("n_turns")).alias("ends")]
    return plan.select("conv_id", "n_turns"), heads.select(*columns).union(rest.select(*columns))


def block_of(depth: Column) -> Column:
    """The round that takes a turn: 1, then 2 to 3, 4 to 7 and so on, each ``MOST_TURNS`` long from there."""
    power = MOST_TURNS.bit_length() - 1
    return F.when(depth < 2 * MOST_TURNS, F.length(F.bin(depth)) - 1).otherwise(F.floor(depth / MOST_TURNS) + power - 1).cast("int")


def last_of(block: int) -> int:
    power = MOST_TURNS.bit_length() - 1
    return (2 << block) - 1 if block <= power else MOST_TURNS * (block - power + 2) - 1


def union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames, like.limit(0)) if not frames else reduce(DataFrame.union, frames)


def refined(every: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits classes until each has one conversation: the rows ``(conv_id, depth, l1, l2, n_bytes, ends)`` that
    were in an active class, the classes ``(depth, l1, l2, n, m, n_bytes, n_ends)``, and the ``(conv_id, head)`` of
    conversations that retired, with the first depth at which they are alone."""
    active = every.select("conv_id", F.lit(0).cast("long").alias("a1"), F.lit(0).cast("long").alias("a2"))
    rows, classes, heads, block = [], [], [], 0
    place = Window.partitionBy("conv_id").orderBy("depth")
    while True:
        due = turns.where(F.col("block") == block).join(active, "conv_id")
        labels = [F.col(f"a{i}").bitwiseXOR(F.bit_xor(F.xxhash64(F.lit(i), "depth", "k1", "k2")).over(place)).alias(f"l{i}") for i in (1, 2)]
        now = checkpointed(due.select("conv_id", "depth", *labels, "n_bytes", "ends"))
        if now.isEmpty():
            break
        split = checkpointed(now.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.max("n_bytes").alias("n_bytes"), F.count_if("ends").alias("n_ends")))
        retired = checkpointed(split.where("n = 1").groupBy(F.col("m").alias("conv_id")).agg(F.min("depth").alias("head")))
        rows.append(now)
        classes.append(split)
        heads.append(retired)
        ahead = now.where((F.col("depth") == last_of(block)) & ~F.col("ends"))
        active = ahead.join(retired, "conv_id", "left_anti").select("conv_id", F.col("l1").alias("a1"), F.col("l2").alias("a2"))
        block += 1
    none = every.sparkSession.createDataFrame([], "conv_id bigint, head bigint")
    no_rows = every.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, l1 bigint, l2 bigint, n_bytes bigint, ends boolean")
    no_class = every.sparkSession.createDataFrame([], "depth bigint, l1 bigint, l2 bigint, n bigint, m bigint, n_bytes bigint, n_ends bigint")
    return union(rows, no_rows), union(classes, no_class), union(heads, none)


def suffix_sums(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with each of ``names`` summed over the conversation's rows from this one on: within a block,
    then over the later blocks' sums."""
    blocked = rows.withColumn("block", block_of(F.col("depth")))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in names))
    later = totals.select("conv_id", "block", *(F.coalesce(F.sum(x).over(after), F.lit(0)).alias(f"later_{x}") for x in names))
    inner = blocked.select(*(c for c in blocked.columns if c not in names), *(F.sum(x).over(within).alias(x) for x in names))
    return inner.join(later, ["conv_id", "block"]).select(*(c for c in rows.columns if c not in names), *((F.col(x) + F.col(f"later_{x}")).alias(x) for x in names))


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(depth, l1, l2, conv_id)`` in order to pieces ``(depth, l1, l2, first, ids)``."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            found = [[], [], [], [], []]
            columns = (c.slice(start, PIECE).to_pylist() for c in batch.columns)
            for key, rows in groupby(zip(*columns), key=lambda r: r[:3]):
                ids = [r[3] for r in rows]
                for column, x in zip(found, (*key, ids[0], ",".join(map(str, ids)))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in found[:4]), pa.array(found[4], pa.string())], [*CLASS, "first", "ids"])


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to ``(depth, l1, l2, ends_sha256)``; one piece is held at a time."""
    pieces = (row for batch in batches for row in zip(*(c.to_pylist() for c in (batch.column(x) for x in (*CLASS, "ids")))))
    for key, rows in groupby(pieces, key=lambda r: r[:3]):
        sha = hashlib.sha256(next(rows)[3].encode())
        for row in rows:
            sha.update(b"," + row[3].encode())
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([sha.hexdigest()])], [*CLASS, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, l1, l2, conv_id)`` to the SHA-256 of each class's ids, ascending and joined by commas."""
    keys = ", ".join(f"{c} bigint" for c in CLASS)
    ordered = ends.repartitionByRange(*CLASS, "conv_id").sortWithinPartitions(*CLASS, "conv_id")
    pieces = ordered.select(*CLASS, "conv_id").mapInArrow(joined_ids, f"{keys}, first bigint, ids string")
    return pieces.repartition(*CLASS).sortWithinPartitions(*CLASS, "first").mapInArrow(hashed_ids, f"{keys}, ends_sha256 string")


def nodes(every: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes (``NAMES``) of conversations ``(conv_id, n_turns)`` and their turns (``TURN``)."""
    spark = every.sparkSession
    every = checkpointed(every)
    path = stage_path(spark, "turns")
    turns.withColumn("block", block_of(F.col("depth"))).write.partitionBy("block").parquet(path)
    kept = spark.read.schema(f"{TURN}, block int").parquet(path)
    rows, classes, heads = refined(every, kept)
    # Rows of conversations that share their class, and these classes.
    core = rows.join(heads, "conv_id", "left").where(F.col("head").isNull() | (F.col("depth") < F.col("head"))).drop("head")
    shared = classes.where("n > 1")
    zero = F.lit(0).cast("long")
    # What folds back: a class's saved bytes and a leaf at its smallest member's row, a child at the row above it, and the
    # leaf that a retired conversation ends in at its last shared row.
    worth = shared.select(F.col("m").alias("conv_id"), "depth", ((F.col("n") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_ends") == F.col("n")).cast("long").alias("leaves"), zero.alias("kids"))
    below = shared.select(F.col("m").alias("conv_id"), (F.col("depth") - 1).alias("depth"), zero.alias("saved"), zero.alias("leaves"), F.lit(1).cast("long").alias("kids"))
    alone = heads.select("conv_id", (F.col("head") - 1).alias("depth"), zero.alias("saved"), F.lit(1).cast("long").alias("leaves"), F.lit(1).cast("long").alias("kids"))
    marks = worth.union(below).union(alone)
    none = F.lit(None).cast("long")
    both = core.select("conv_id", "depth", "l1", "l2", zero.alias("saved"), zero.alias("leaves"), zero.alias("kids")).union(marks.where("depth > 0").select("conv_id", "depth", none, none, "saved", "leaves", "kids"))
    marked = checkpointed(both.groupBy("conv_id", "depth").agg(F.max("l1").alias("l1"), F.max("l2").alias("l2"), *(F.sum(x).alias(x) for x in ("saved", "leaves", "kids"))))
    sums = suffix_sums(marked, "saved", "leaves").groupBy(*CLASS).agg(F.sum("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = marked.where("kids = 1").join(shared.select(*CLASS, F.col("m").alias("parent_conv_id")), list(CLASS)).select("conv_id", (F.col("depth") + 1).alias("depth"), "parent_conv_id")

    top = every.agg(F.count("*").alias("n"), F.min("conv_id").alias("m")).first()
    ends = core.where("ends").select(*CLASS, "conv_id").union(every.where("n_turns = 0").select(*(zero.alias(c) for c in CLASS), "conv_id"))
    shas = checkpointed(end_digests(ends))
    sha = F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    in_root = F.lit(top["m"]).cast("long")
    parent = F.when(F.col("depth") == 1, in_root).otherwise(F.col("parent_conv_id")).alias("parent_conv_id")
    named = shared.join(sums, list(CLASS)).join(shas, list(CLASS), "left").select(F.col("m").alias("conv_id"), *CLASS, "n", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    inner = named.join(parents, ["conv_id", "depth"], "left").select("conv_id", "depth", parent, F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", sha)

    first = heads.join(parents.withColumnRenamed("depth", "head"), ["conv_id", "head"], "left").join(every, "conv_id")
    chain = kept.select("conv_id", "depth").join(first, "conv_id").where(F.col("depth") >= F.col("head"))
    at_end = F.col("depth") == F.col("n_turns")
    above = F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(parent)
    own_sha = F.when(at_end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS))
    one = F.lit(1).cast("long")
    tails = chain.select("conv_id", "depth", above, one, (~at_end).cast("long"), one, zero, own_sha)

    totals = marks.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if((F.col("depth") == 0) & (F.col("kids") == 1)).alias("kids"))
    root_sha = totals.join(F.broadcast(shas.where("depth = 0").select("ends_sha256")), how="left")
    root = root_sha.select(in_root.alias("conv_id"), zero.alias("depth"), none.alias("parent"), F.lit(top["n"]).cast("long").alias("n"), "kids", F.greatest(F.coalesce("leaves", zero), one).alias("leaves"), F.coalesce("saved", zero).alias("saved"), sha)
    return root.where(F.lit(top["n"] > 0)).union(inner).union(tails).toDF(*NAMES)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations as they are."""
    return nodes(*as_given(checkpointed(turns_of(conversations))))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations."""
    return nodes(*rebuilt(checkpointed(turns_of(conversations))))
