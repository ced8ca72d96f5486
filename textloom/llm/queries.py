"""The registered queries of this package: each applies one operator, with its production parameters,
to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, fingerprints, line_dedup, mixing, near_dedup, periodic_runs, prefix_trie, quality_classifier, quality_rules, substring_dedup, token_count, topk_search, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.best_matches(table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("distance")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the documents' sources. Lines with a word, those dropped, and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.without_boilerplate(docs, ratio=line_dedup.RATIO, counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_of(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.with_runs(periodic_runs.planted(table(spark, sf_dir, "documents")), keep=["doc_id"])
    sha = {"runs_sha256": periodic_runs.run_lines(F.col("runs")), "collapsed_sha256": F.col("collapsed")}
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *(F.sha2(c.cast("binary"), 256).alias(x) for x, c in sha.items()))


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_quality_rules, op3_quality_classifier, op4_token_counts, op5_mixing,
        op6_line_dedup, op7_url_filter, op8_near_dedup, op9_bpe, op10_substring_dedup,
        op11_prefix_trie, op12_fingerprints, op13_periodic_runs,
    )
}
