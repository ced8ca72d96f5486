"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

What every stage does with odd rows
-----------------------------------
* Null text counts as empty text wherever words are counted; only the last stage turns it into "".
* Null ids, languages and sources are values of their own; repeated rows and ids are rows of their own,
  but for near-dedup, which keeps one row of each component.
* Texts of any length are taken whole. Ties are broken by ids or hashes, never by partitions.
* An empty table stays empty. Other columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from textloom.plans.lineage import stage_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject: null texts and those under ten words, repetitive
    ones, and outliers of their language and source."""
    return quality_rules.passing(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of each source; ``n_chars`` follows the text and is null with it. A text
    may become empty; its row stays. Pages with the same text count once."""
    out = line_dedup.without_boilerplate(docs, ratio=line_dedup.RATIO)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least (id, text hash), of repeated rows the one that hashes
    lowest. Rows without words are no copies of each other and all stay."""
    return near_dedup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice. A source without words goes."""
    return mixing.emit(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids in a column ``ids``, which replaces one of that name; the text is what the
    ids decode to, so an unpaired surrogate would become U+FFFD."""
    return bpe.encoded(docs, decoded_col="text")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL has no BPE; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table of documents. The tables between the stages stay in the shared
    folder, since the result reads the last of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = stage_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
