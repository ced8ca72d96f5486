"""Dictionary matching as joins, and the counted word set.

Keys are cut into blocks, or into prefixes of the lengths that the dictionary has, and joined on equality: no nested
loop. Keys are made distinct first, so a key in many rows is cut once. The dictionary is broadcast only
below ``BROADCAST_BYTES``; a larger one is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import grams
from textloom.plans.lineage import checked_broadcast
from textloom.plans.ranks import numbered


def indexed(words: DataFrame) -> DataFrame:
    """DIC-1, DIC-5, ORD-3 (T): ``(idx, word)`` of the distinct words in byte order; no single task has all words."""
    placed = numbered(words.select("word").distinct(), [F.asc_nulls_first("word")], name="idx")
    return placed.select((F.col("idx") - 1).cast("int").alias("idx"), "word")


def exact_match(keys: DataFrame, key_col: str, words: DataFrame) -> DataFrame:
    """DIC-2, DIC-12 (T/H): the rows whose key is a word, with the dictionary's other columns."""
    return keys.join(words, keys[key_col] == words["word"], "left").where(F.col("word").isNotNull())


def is_word(keys: DataFrame, key_col: str, words: DataFrame) -> DataFrame:
    """DIC-10, DIC-11, FLT-4 (T): the rows whose key is a word."""
    return keys.join(words.select(F.col("word").alias(key_col)).distinct(), key_col, "left_semi")


def prefix_matches(keys: DataFrame, key_col: str, words: DataFrame) -> DataFrame:
    """DIC-3, DIC-6, DIC-9 (T/H): each distinct key with every word that it starts with, the word's
    ``length`` in bytes and the dictionary's other columns. Only prefixes of the dictionary's own lengths are made."""
    words = checked_broadcast(words)
    lengths = sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect() if r["n"])
    distinct = keys.select(F.col(key_col)).where(F.length(key_col) > 0).distinct()
    made = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(key_col)), lambda n: F.left(F.col(key_col), n))
    return distinct.select(key_col, F.explode(made).alias("word")).join(words, "word").withColumn("length", F.octet_length("word"))


def substring_matches(keys: DataFrame, key_col: str, words: DataFrame) -> DataFrame:
    """DIC-8 (H): each distinct key with every word in it, at each ``position`` (bytes, from 0). Keys are cut
    into blocks that suit the words' lengths (``grams``), so a large dictionary makes no more rows."""
    distinct = keys.select(F.col(key_col)).where(F.length(key_col) > 0).distinct()
    found = grams.occurrences(distinct, key_col, words, "word")
    return found.withColumn("position", F.octet_length(F.left(F.col(key_col), F.col("at")))).drop("at")


def first_substring_match(keys: DataFrame, key_col: str, words: DataFrame) -> DataFrame:
    """DIC-7 (T; the choice among words at one place X): the word at the first place that has one, the
    longest there."""
    found = substring_matches(keys, key_col, words)
    best = F.min_by(F.struct("word", "position"), F.struct(F.col("position"), -F.octet_length("word")))
    return found.groupBy(key_col).agg(best.alias("best")).select(key_col, "best.word", "best.position")


def record_number(words: DataFrame) -> int:
    """DIC-5 (T): how many strings were added."""
    return words.count()


def word_counts(words: DataFrame) -> DataFrame:
    """TRI-1 (I): ``(word, cnt)``."""
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def without(inserted: DataFrame, removed: DataFrame) -> DataFrame:
    """TRI-2 (I): counts after all removals, which never go below 0."""
    gone = word_counts(removed).withColumnRenamed("cnt", "gone")
    left = F.greatest(F.col("cnt") - F.coalesce("gone", F.lit(0)), F.lit(0))
    return word_counts(inserted).join(gone, "word", "left").select("word", left.alias("cnt"))


def replayed(log: DataFrame) -> DataFrame:
    """TRI-2 (I): ``(word, seq, op)`` with op +1 or -1 in the order of ``seq``: the count at the end,
    floored at 0 after each step. The floor needs no fold: it is the total less the least running
    total, if that is below 0."""
    running = log.withColumn("at", F.sum("op").over(Window.partitionBy("word").orderBy("seq")))
    return running.groupBy("word").agg((F.sum("op") - F.least(F.min("at"), F.lit(0))).alias("cnt"))


def has(counts: DataFrame, word: str) -> bool:
    """TRI-3 (I): never for the empty string."""
    return bool(word) and not counts.where((F.col("word") == word) & (F.col("cnt") > 0)).isEmpty()


def search(counts: DataFrame, prefix: str, cap: int = 0) -> DataFrame:
    """TRI-4, TRI-5, LIM-1, ORD-2 (I): the words with a prefix, in byte order; at most ``cap`` unless
    that is 0. The filter reaches a Parquet scan."""
    found = counts.where(F.col("word").startswith(prefix) & (F.col("cnt") > 0)).select("word").orderBy("word")
    return found.limit(cap) if cap else found
