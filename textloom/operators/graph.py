"""Dependency graphs as edge tables ``(src, dst)``: src depends on dst.

Closures double the length of the known paths each round, so rounds grow with the logarithm of the
longest path. Each round is one join and one distinct, its lineage cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpointed, kept_bytes

#: Above so many edges, a round of peeling looks nodes up in hash tables of its tasks' shares.
HASHED_EDGES = 2_000_000
#: Up to so many bytes, the nodes that a round goes on from are broadcast, and the edges are not shuffled.
FRONT_BYTES = 16 << 20


def closure(edges: DataFrame) -> DataFrame:
    """GRF-1 (T): ``(src, dst)`` for every path of one edge or more."""
    paths = checkpointed(edges.select("src", "dst").distinct())
    n = paths.count()
    while True:
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst")
        paths = checkpointed(paths.union(longer).distinct())
        before, n = n, paths.count()
        if n == before:
            return paths


def dependencies(edges: DataFrame, node: str) -> DataFrame:
    """GRF-2 (T): all that ``node`` depends on. Only what is reachable is followed."""
    reached = checkpointed(edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct())
    front = reached
    while not front.isEmpty():
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = checkpointed(found.join(reached, "node", "left_anti"))
        reached = checkpointed(reached.union(front))
    return reached


def dependents(edges: DataFrame, node: str) -> DataFrame:
    """GRF-2 (T): all that depend on ``node``."""
    return dependencies(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), node)


def _peeled(edges: DataFrame) -> DataFrame:
    """``edges``, kept already, without those of nodes that no edge enters or none leaves, over and over: they are on no cycle."""
    now, n = edges, edges.count()
    while n:
        ends = now.select(F.col("src").alias("node"), F.lit(1).alias("way")).union(now.select("dst", F.lit(2)))
        inner = ends.groupBy("node").agg(F.bit_or("way").alias("ways")).where("ways = 3").select("node")
        # Many edges are not sorted for a test against distinct nodes; with few, AQE sends the nodes to all tasks.
        inner = inner.hint("shuffle_hash") if n > HASHED_EDGES else inner
        left = now.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        now = checkpointed(left)
        before, n = n, now.count()
        if n == before:
            break
    return now


def _coloured(edges: DataFrame) -> DataFrame:
    """``(node, above, below)``: the greatest node that reaches each node along ``edges``, and the greatest that it reaches, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    now = checkpointed(nodes.select("node", F.col("node").alias("above"), F.col("node").alias("below"), F.lit(True).alias("down"), F.lit(True).alias("up")))
    while size := kept_bytes(now.where("down or up")):
        # Only colours that grew in the last round go on, few of them to where the edges lie; of those that meet at a node the greatest counts.
        near = F.broadcast if size <= FRONT_BYTES else lambda front: front
        above, below = (near(now.where(way).select(F.col("node").alias("at"), colour)) for way, colour in (("down", "above"), ("up", "below")))
        sent = edges.join(above, F.col("src") == F.col("at")).select(F.col("dst").alias("node"), F.col("above").alias("a"), F.lit(None).alias("b"))
        sent = sent.union(edges.join(below, F.col("dst") == F.col("at")).select("src", F.lit(None), "below")).groupBy("node").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        grew = [F.coalesce(F.col(x) > F.col(y), F.lit(False)).alias(z) for x, y, z in (("a", "above", "down"), ("b", "below", "up"))]
        now = checkpointed(now.drop("down", "up").join(sent, "node", "left").select("node", F.greatest("above", "a").alias("above"), F.greatest("below", "b").alias("below"), *grew))
    return now.select("node", "above", "below")


def strong_parts(edges: DataFrame) -> DataFrame:
    """GRF-3 (M): ``(node, part)`` of every node on a cycle; ``part`` is the greatest node of its strongly connected part.

    Nodes without edges in or out are peeled off. Colours go both ways at once: each node learns the greatest node that reaches it
    and the greatest that it reaches. Where they are one node, the nodes of these colours are its part. Parts go, and so do edges between
    nodes whose colours differ, which no part holds; the rest is coloured again. No pairs of nodes are made: a round sends two
    colours along each edge at most."""
    kept = checkpointed(edges.select("src", "dst"))
    loops = checkpointed(kept.where("src = dst").select(F.col("src").alias("node")).distinct())
    left = checkpointed(_peeled(kept.where("src <> dst")).distinct())
    parts = None
    while not left.isEmpty():
        colours = _coloured(left)
        found = colours.where("above = below").select("node", F.col("above").alias("colour"))
        parts = found if parts is None else checkpointed(parts.union(found))
        ends = [colours.where("above <> below").select(F.col("node").alias(c), F.struct("above", "below").alias(f"{c}_colours")) for c in ("src", "dst")]
        rest = left.join(ends[0], "src").join(ends[1], "dst").where("src_colours = dst_colours").select("src", "dst")
        left = _peeled(checkpointed(rest))
    if parts is None:
        return loops.select("node", F.col("node").alias("part"))
    shared = parts.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
    real = checkpointed(parts.join(shared, "colour", "left_semi").select("node", F.col("colour").alias("part")))
    return real.union(loops.join(real, "node", "left_anti").select("node", F.col("node").alias("part")))


def cyclic(edges: DataFrame) -> DataFrame:
    """GRF-3 (M): the nodes that are on a cycle."""
    return strong_parts(edges).select("node")


def levels(edges: DataFrame) -> DataFrame:
    """GRF-4 (T): ``(node, level)``, the longest path below a node; a dependency has a smaller level
    than what needs it. Raises for a cycle."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    now = checkpointed(nodes.withColumn("level", F.lit(0)))
    most = now.count()
    front = now
    for step in range(1, most + 1):
        up = edges.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = checkpointed(up.withColumn("level", F.lit(step)))
        if front.isEmpty():
            return now
        now = checkpointed(now.union(front).groupBy("node").agg(F.max("level").alias("level")))
    raise ValueError("the graph has a cycle")


def graphviz(edges: DataFrame) -> DataFrame:
    """GRF-5 (M): one line ``value`` an edge, for ``write_lines``."""
    return edges.select(F.format_string('"%s" -> "%s"', "src", "dst").alias("value"))


class Registry:
    """GRF-6 (I): named functions and variables of a session; functions become SQL functions."""

    def __init__(self, spark):
        self.spark, self.names = spark, {}

    def function(self, name: str, udf) -> None:
        self.names[name] = self.spark.udf.register(name, udf)

    def variable(self, name: str, value: object) -> None:
        self.names[name] = value

    def all(self) -> dict[str, object]:
        return dict(self.names)
