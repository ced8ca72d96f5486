"""Places of rows in an order, overall or within groups, with no task that takes a whole group.

Rows are dealt to ranges of the whole order and kept so in a checkpoint. A row's place is its place in its
range and what earlier ranges hold of its group: one number for each range, since only the group that
a range begins with can have rows before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpointed


def numbered(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order ``order`` among the rows of equal columns ``within``
    (null is a value). Rows that the order cannot tell apart get different places."""
    part = "__part"
    groups = [F.asc_nulls_first(c) for c in within]
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    kept = checkpointed(ranged.select(F.spark_partition_id().alias(part), "*"))
    local = F.row_number().over(Window.partitionBy(part, *within).orderBy(*order))
    sizes = kept.groupBy(part, *within).agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    # Only a group that a range begins with has any: one row a range at most, so the broadcast is bounded by them.
    before = sizes.select(part, *within, earlier.alias("__before")).where("__before > 0")
    before = before.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate((part, *within))), "__before")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate((part, *within))))
    placed = kept.withColumn(name, local).join(F.broadcast(before), same, "left")
    return placed.select(*df.columns, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long").alias(name))
