"""A sorted key-value store of Parquet runs: batches of puts and deletes, snapshots, range scans, compaction.

A batch becomes one run: its operations get consecutive sequence numbers, the last one of each key is kept (a delete as a
tombstone), and the rows are written in key order. A manifest lists the runs with their ranges of keys and numbers; writing
its next version commits the batch, and a version that another writer has taken is an error. A scan reads only the
runs whose keys and numbers can matter, with the range as a filter on them, and of each key the row with the highest number
up to the snapshot counts. Rows meet by key in a grouped maximum that is combined before the shuffle, so that a key with very
many versions is no single task's.

The manifest has a row a run; ``compact`` keeps their number small. Only its rows come to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.plans.ranks import numbered

#: What a version of the manifest holds: the run's folder, its ends, and the snapshots that a compacted run keeps.
MANIFEST = "run string, first_key string, last_key string, min_seq bigint, max_seq bigint, live array<bigint>"


def _versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """The last committed version of the manifest and the last that was begun; 0 for none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    begun = sorted(int(x.getPath().getName()) for x in fs.listStatus(folder)) if fs.exists(folder) else []
    done = [v for v in begun if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{v:08d}/_SUCCESS"))]
    return max(done, default=0), max(begun, default=0)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest."""
    done, _ = _versions(spark, path)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest/{done:08d}") if done else spark.createDataFrame([], MANIFEST)


def last_snapshot(spark: SparkSession, path: str) -> int:
    """CON-2 (M): the number of the last committed operation; reads at it see what is there now."""
    return runs(spark, path).agg(F.max("max_seq").alias("n")).first()["n"] or 0


def _commit(spark: SparkSession, path: str, rows: DataFrame) -> None:
    _, begun = _versions(spark, path)
    rows.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/{begun + 1:08d}")


def _written(spark: SparkSession, path: str, rows: DataFrame, max_seq: int, live: Sequence[int] = ()) -> DataFrame:
    """Writes a run ``(key, seq, deleted, value)``; its row of the manifest, none if the run is empty."""
    run = f"{path}/runs/{uuid.uuid4().hex}"
    rows.repartitionByRange("key", "seq").sortWithinPartitions("key", F.desc("seq")).write.parquet(run)
    back = spark.read.schema(rows.schema).parquet(run)
    ends = back.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("seq").alias("min_seq"))
    return ends.where("min_seq is not null").select(F.lit(run).alias("run"), "first_key", "last_key", "min_seq", F.lit(max_seq).cast("long").alias("max_seq"), F.array(*map(F.lit, live)).cast("array<bigint>").alias("live"))


def write_batch(spark: SparkSession, path: str, ops: DataFrame, order: Sequence[Column]) -> int:
    """CON-2 (M): applies operations ``(key, value, deleted)`` in their order, all or none; the snapshot after
    them. Null keys are refused."""
    ops = ops.select("*", F.when(F.col("key").isNull(), F.raise_error(F.lit("a key is null"))).otherwise(F.col("key")).alias("__key"))
    before = last_snapshot(spark, path)
    placed = numbered(ops, order, name="seq").select(F.col("__key").alias("key"), (F.col("seq") + before).alias("seq"), "deleted", "value")
    count = placed.count()
    if not count:
        return before
    last = placed.groupBy("key").agg(F.max(F.struct("seq", "deleted", "value")).alias("last")).select("key", "last.*")
    row = _written(spark, path, last, before + count)
    _commit(spark, path, runs(spark, path).union(row))
    return before + count


def _versions_read(spark: SparkSession, path: str, low: str | None, high: str | None, snapshot: int | None) -> DataFrame:
    """The rows of the runs that can hold keys of the range up to the snapshot."""
    listed = runs(spark, path)
    if snapshot is not None:
        lost = listed.where((F.size("live") > 0) & (F.col("max_seq") > snapshot) & ~F.array_contains("live", F.lit(snapshot).cast("long")))
        if not lost.isEmpty():
            raise ValueError(f"compaction has dropped what the snapshot {snapshot} needs")
        listed = listed.where(F.col("min_seq") <= snapshot)
    listed = listed if low is None else listed.where(F.col("last_key") >= low)
    listed = listed if high is None else listed.where(F.col("first_key") < high)
    names = [r["run"] for r in listed.select("run").collect()]
    rows = spark.read.parquet(*names) if names else spark.createDataFrame([], "key string, seq bigint, deleted boolean, value string")
    rows = rows if low is None else rows.where(F.col("key") >= low)
    rows = rows if high is None else rows.where(F.col("key") < high)
    return rows if snapshot is None else rows.where(F.col("seq") <= snapshot)


def scan(spark: SparkSession, path: str, low: str | None = None, high: str | None = None, snapshot: int | None = None) -> DataFrame:
    """CON-2 (M): ``(key, value)`` of the keys with ``low <= key < high`` as of the snapshot, by default the last."""
    rows = _versions_read(spark, path, low, high, snapshot)
    newest = rows.groupBy("key").agg(F.max_by(F.struct("deleted", "value"), "seq").alias("last"))
    return newest.where(~F.col("last.deleted")).select("key", "last.value")


def compact(spark: SparkSession, path: str, live: Sequence[int] = ()) -> None:
    """CON-2 (M): one run in place of all, with the versions that reads as of now and of the snapshots
    ``live`` need. Tombstones go where no older version is left below them. Folders of earlier runs stay for readers."""
    now = last_snapshot(spark, path)
    rows = _versions_read(spark, path, None, None, None)
    seen_by = F.coalesce(*(F.when(F.col("seq") <= s, F.lit(s)) for s in sorted({*live, now}) if s <= now)) if now else F.lit(0)
    kept = rows.groupBy("key", seen_by.alias("__s")).agg(F.max(F.struct("seq", "deleted", "value")).alias("last")).select("key", "last.*")
    # A key has a version for each snapshot at most.
    older = F.count_if(~F.col("deleted")).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    needed = kept.withColumn("__older", F.coalesce(older, F.lit(0))).where(~F.col("deleted") | (F.col("__older") > 0)).drop("__older")
    _commit(spark, path, _written(spark, path, needed, now, sorted({*live, now})))
