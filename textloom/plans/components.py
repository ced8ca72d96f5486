"""Connected components of an edge table, by alternating large and small stars.

Each half step is a grouped minimum (combined before the shuffle) and a join with one row a node on
the other side, so a node with very many neighbours is split like any skewed join. Labels shrink to
the component's smallest node in a number of rounds that grows with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpointed

#: Edges of one task of a round, so that few edges make no small tasks and files.
EDGES_AT_ONCE = 1_000_000


def _star(arcs: DataFrame) -> DataFrame:
    """``(u, v)`` arcs to ``(v, m)``: each neighbour of u, and u itself, to the least of them all."""
    least = arcs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return arcs.join(least, "u").select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
    return _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    star = _star(down)
    moved = star.select(F.col("v").alias("a"), F.col("m").alias("b")).union(star.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b"))


def _kept(edges: DataFrame, expected: int) -> tuple[DataFrame, tuple]:
    """``edges`` with their lineage cut, in tasks that suit their expected number, and a mark that tells their set from another."""
    kept = checkpointed(edges.coalesce(1 + expected // EDGES_AT_ONCE))
    row = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return kept, (row["n"], row["h"])


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges of any comparable type to ``(node, label)`` for every node of an edge; the
    label is the least node of its component."""
    now = checkpointed(edges.toDF("a", "b").where(F.col("a") != F.col("b")).distinct())
    mark, n = None, now.count()
    while True:
        # Arcs point from a node to a smaller one after each pass; there are never more than a node and its neighbours.
        now, found = _kept(_small(_large(now)).distinct(), n)
        n = found[0]
        if found == mark:
            break
        mark = found
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    roots = now.select(F.col("b").alias("node")).distinct().join(stars.select(F.col("a").alias("node")), "node", "left_anti")
    return stars.toDF("node", "label").union(roots.select("node", F.col("node").alias("label")))
