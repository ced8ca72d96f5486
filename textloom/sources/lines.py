"""Text files as tables of lines, files as values, and the sinks that write them back.

Only ``\\n`` ends a line, so a ``\\r`` before it is kept. Where the original line reader loses the last
character of an unterminated line, or hands on blank lines with their ``\\n``, these functions do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import SkipRestOfInputTableException

from textloom.functions.text import ascii_lower
from textloom.plans.lineage import checked_broadcast


def keeps(line: Column, skip_empty: bool = True, comment_prefix: str = "") -> Column:
    """FLT-1, FLT-2, SRC-4 (I): not blank, and not starting with the prefix in any ASCII case."""
    kept = F.length(line) > 0 if skip_empty else F.lit(True)
    if comment_prefix:
        kept = kept & ~F.startswith(ascii_lower(line), ascii_lower(F.lit(comment_prefix)))
    return kept


def read_lines(spark: SparkSession, path: str, skip_empty: bool = True, comment_prefix: str = "") -> DataFrame:
    """SRC-1, SRC-2 (I): one column ``value``. ``skip_empty=False`` and no prefix is SRC-6 (T)."""
    return spark.read.option("lineSep", "\n").text(path).where(keeps(F.col("value"), skip_empty, comment_prefix))


def split_lines(df: DataFrame, text_col: str, skip_empty: bool = True, comment_prefix: str = "") -> DataFrame:
    """SRC-2 over a column of texts: the other columns with ``line_no`` (from 0) and ``line``. As in a
    file, what a final ``\\n`` ends is not followed by another line."""
    whole = F.regexp_replace(F.col(text_col), r"\n\z", "")
    lines = F.when(F.length(text_col) > 0, F.split(whole, "\n", -1))
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(lines).alias("line_no", "line")).where(keeps(F.col("line"), skip_empty, comment_prefix))


def numbered_lines(spark: SparkSession, path: str, skip_empty: bool = True, comment_prefix: str = "") -> DataFrame:
    """SRC-1, SRC-2 with the order of files: ``file``, and ``block`` and ``at``, which ascend with the lines of a file
    however many tasks read it."""
    lines = read_lines(spark, path, False)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return placed.where(keeps(F.col("value"), skip_empty, comment_prefix))


def until_refused(lines: DataFrame, accepted: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SRC-3, LIM-2 (I): of each group ``by``, the rows before the first, by ``order``, that is not accepted. All tasks look for
    refused rows; the first place of each group is a grouped minimum, so a group of any size is shared among tasks."""
    place = F.struct(*order)
    first = lines.where(~F.coalesce(accepted, F.lit(False))).groupBy(*by).agg(F.min(place).alias("__first"))
    stops = checked_broadcast(first.select(*(F.col(c).alias(f"__{c}") for c in by), "__first"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    return lines.join(stops, same, "left").where(F.col("__first").isNull() | (place < F.col("__first"))).select(*lines.columns)


def process_lines(df: DataFrame, callback: Callable[[str], bool]) -> DataFrame:
    """SRC-3, LIM-2, UDF-1 (I) without an order of files: the lines of each partition for which ``callback`` was true, up to
    the first for which it is false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (x.as_py() for batch in batches for x in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(takewhile(callback, lines), pa.string())], ["value"])

    return df.select("value").mapInArrow(run, "value string")


def process_ordered(lines: DataFrame, callback: Callable[[str], bool], by: Sequence[str], order: Sequence[str], value_col: str = "value") -> DataFrame:
    """SRC-3, LIM-2, UDF-1 (I): the lines for which ``callback`` was true, up to the first of each group ``by`` for which it is
    false. It is called in order and never after that line: the rest of the group is skipped, not read by Python. A group is
    one task's, as calls in order need; ``until_refused`` shares it where a column can say what is refused."""

    class Until:
        def eval(self, row: Row) -> Iterator[tuple]:
            if not callback(row[value_col]):
                raise SkipRestOfInputTableException("refused")
            yield tuple(row)

    return F.udtf(Until, returnType=lines.schema.simpleString().removeprefix("struct<").removesuffix(">"))(lines.asTable().partitionBy(*by).orderBy(*order))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5 (T): each file as one string ``value``."""
    return spark.read.text(path, wholetext=True)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7 (T): ``path`` and ``length`` in bytes; the contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """SNK-1, SNK-2 (T), CON-3 (M): one string column as lines; ``compression`` as of Spark's writer."""
    df.write.option("lineSep", "\n").option("compression", compression).text(path)


def save_dictionary(words: DataFrame, path: str) -> None:
    """SNK-3, ORD-3, ZHC-2 (T/X): a dictionary with its index, sorted by word, as Parquet."""
    words.sort("word").write.mode("overwrite").parquet(path)


def open_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """SNK-3 (T/X)."""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """CON-1 (M): a table of a database; needs its JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_sorted(df: DataFrame, path: str, key: str) -> None:
    """CON-2 (M): key-value rows as Parquet in key order, so that a range of keys reads few files."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def scan_range(spark: SparkSession, path: str, key: str, low: object, high: object) -> DataFrame:
    """CON-2 (M): the rows with ``low <= key < high``; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where((F.col(key) >= low) & (F.col(key) < high))
