"""Mixing sources to target weights: tokens per source, repetition rates, whole copies and one
hash-seeded Bernoulli copy. DataFrame functions only.

Defined results
---------------
* A null or empty text has size 0; a source whose size is 0 has target 0 and its documents are
  taken 0 times.
* Null is a source of its own, last in order.
* Rows with the same id, repeated rows included, draw the same Bernoulli copy; each row counts its
  own size.
* A null id draws like an empty one. An empty table gives an empty table.
* Columns of the input are never read but for the three that are named; ``emit`` returns exactly the
  input's columns, whatever their names.

At scale
--------
One pass counts words and shuffles a partial sum for each source and task. The table of sources has
a row for each source; ranking it is one small sort. It is broadcast only below
``BROADCAST_BYTES``, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.text import fresh, unit_hash, word_count
from textloom.plans.lineage import checked_broadcast

#: Production parameters: weights dealt to the sources in order, words to take over all words, most
#: copies of a source's words, seed of the Bernoulli copies.
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    A source stops at ``most`` times its size and the rest is shared again by weight. Sources fill in
    the order of size over weight, so the ones that stop are a prefix of that order, found by running
    sums instead of rounds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    every = Window.partitionBy()
    place = (F.row_number().over(order) - 1) % len(weights)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", F.row_number().over(order))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("total", share * F.sum("source_size").over(every))
        .withColumn("left_over", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("stops", F.col("cap") * F.col("weight_from") <= F.col("weight") * F.col("left_over"))
    )
    level = F.try_divide(
        F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(every),
        F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(every),
    )
    return ranked.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))).select(
        "source", "source_size", "target"
    )


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """floor(rate), and one more with the probability of what is left."""
    whole = F.floor(rate)
    return (whole + F.when(unit_hash(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **params) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target and n_copies, under names that no input column has."""
    name = {k: fresh(docs.columns, f"mix_{k}") for k in ("size", "source", "source_size", "target", "n_copies")}
    sized = docs.withColumn(name["size"], word_count(F.col(f"`{text_col}`")))
    sizes = sized.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(name["size"]).alias("source_size"))
    targets = checked_broadcast(source_targets(sizes, **params)).select(*(F.col(c).alias(name[c]) for c in ("source", "source_size", "target")))
    joined = sized.join(targets, F.col(f"`{source_col}`").eqNullSafe(F.col(name["source"]))).drop(name["source"])
    rate = F.when(F.col(name["source_size"]) > 0, F.col(name["target"]) / F.col(name["source_size"])).otherwise(0.0)
    return joined.withColumn(name["n_copies"], copies(rate, F.col(f"`{id_col}`"), seed)), name


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **params) -> DataFrame:
    """What the mix takes of each document: its id, size, source_size, target and taken words."""
    out, name = rated(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, seed, **params)
    taken = F.col(name["size"]) * F.col(name["n_copies"])
    return out.select(id_col, *(F.col(name[c]).alias(c) for c in ("size", "source_size", "target")), taken.alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **params) -> DataFrame:
    """The documents of the mix: each as often as it is taken, with the columns of the input."""
    out, name = rated(docs, id_col, text_col, source_col, seed, **params)
    again = fresh(docs.columns, "mix_copy")
    copied = out.where(F.col(name["n_copies"]) > 0).withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(name["n_copies"]).cast("int"))))
    return copied.select(*(F.col(f"`{c}`") for c in docs.columns))
