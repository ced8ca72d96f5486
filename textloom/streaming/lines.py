"""Line streams: files that arrive in a folder, filtered like ``sources.lines`` and handed on in
bounded batches.

``files_per_batch`` is the bound that a fixed-size queue gives a producer (Q-2); batches take the place
of the pushed lines (Q-5), and exactly-once needs the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from textloom.sources.lines import keeps


def stream_lines(spark: SparkSession, folder: str, skip_empty: bool = True, comment_prefix: str = "", files_per_batch: int = 256) -> DataFrame:
    """Q-2, Q-5 (I): a stream with one column ``value``."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.where(keeps(F.col("value"), skip_empty, comment_prefix))


def for_each_batch(lines: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Q-5, UDF-1 (I): calls back with each batch, until all that is there has been read."""
    return lines.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_words(lines: DataFrame) -> DataFrame:
    """TRI-1 over a stream: running counts of the words in the lines."""
    words = lines.select(F.explode(F.split("value", " +")).alias("word")).where(F.col("word") != "")
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


class _Counted(StatefulProcessor):
    """One word's count, its last operation's number and the latest event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "cnt bigint, seq bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        count, last, timer = self.kept.get() if self.kept.exists() else (0, -1, None)
        # A batch's operations come in any order; those of earlier batches were applied before.
        for row in sorted(rows, key=lambda r: r["seq"]):
            count, last = max(0, count + row["op"]), max(last, row["seq"])
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentWatermarkInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.kept.update((count, last, timer))
        yield Row(word=key[0], cnt=count, seq=last, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        count, last, _ = self.kept.get()
        self.kept.clear()
        yield Row(word=key[0], cnt=count, seq=last, expired=True)

    def close(self) -> None:
        pass


def counted_operations(log: DataFrame, late: str = "0 seconds", idle_ms: int = 86_400_000) -> DataFrame:
    """TRI-1, TRI-2, Q-5 (I): ``(word, seq, op, ts)`` with op 1 (insert) or -1 (remove) as a stream to ``(word, cnt, seq, expired)``: after each
    batch the count of every word that it touched, floored at 0 after each operation in the order of ``seq``. A word that
    has had no operation for ``idle_ms`` of event time past the watermark gives its count once more, as expired, and leaves the
    state, which so holds the words in use and not all that ever came. Needs the RocksDB state store; in update mode."""
    timed = log.withWatermark("ts", late).select("word", "seq", "op", "ts")
    return timed.groupBy("word").transformWithState(
        statefulProcessor=_Counted(idle_ms), outputStructType="word string, cnt bigint, seq bigint, expired boolean", outputMode="Update", timeMode="EventTime"
    )


#: Where ``counted_operations`` keeps its state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed_stream(spark: SparkSession, folder: str, schema: StructType, path: str, files_per_batch: int = 2, idle_ms: int = 86_400_000) -> DataFrame:
    """TRI-2, Q-5 (I): the operations in Parquet files that have arrived in ``folder`` since the last call, through
    ``counted_operations``, to a table of counts under ``path``; returns that table. State and progress are under ``path`` too, so
    that a call after a failure or a restart goes on where the last one ended. Files count in the order of their
    arrival, and operations within a batch in that of ``seq``. Each batch replaces its own part of the table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    counted_operations(log, idle_ms=idle_ms).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("word string, cnt bigint, seq bigint, expired boolean, batch bigint").option("basePath", f"{path}/counts").parquet(f"{path}/counts")
