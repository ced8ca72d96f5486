"""Cutting lineage through the folder that the cluster shares, and size-checked broadcasts.

``spark.checkpoint.dir`` names the shared folder. Only where a session on one machine sets none (tests, a
laptop) is a temporary folder of it used; on a cluster that is an error. Written tables stay until the folder is
emptied, since what is returned reads them; checkpoints go with their frames where
``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast sides stay below this many bytes of rows; above it, the join shuffles and AQE splits skew.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stage tables: the cluster's, else a temporary one set once."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster's machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for one written table."""
    return f"{shared_folder(spark)}/textloom-{uuid.uuid4().hex}/{name}"


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: eight bytes a column, and the length of strings, binaries and arrays."""
    total = F.lit(8 * (len(df.columns) + 1)).cast("long")
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(col), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.octet_length(F.array_join(col, "")) + 16 * F.size(col), F.lit(0))
        elif kind.startswith("array"):
            total = total + F.coalesce(16 * F.size(col), F.lit(0))
    return total


def kept_bytes(kept: DataFrame) -> int:
    """About what the rows of a kept frame take; 0 for none."""
    return kept.agg(F.sum(row_bytes(kept)).alias("n")).first()["n"] or 0


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with its lineage cut; hinted for broadcast if its rows take ``limit`` bytes at most.

    Beyond the limit the frame carries no hint: the join is then a shuffled one, whose hot keys AQE
    splits.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if kept_bytes(kept) <= limit else kept
