"""Registered queries of the training-data operators: thin digests over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import chaining, covertree, htmltext, imatch, importance, knnquality, linededup, minhash, mixing, packing, suffixdedup, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on 4-word shingles at similarity 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return imatch.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors at cosine 0.9."""
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    found = toxicity.toxic_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.selectExpr("doc_id", "held_out", "score", "predicted", "n_tokens", "size(segments) AS n_passages")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its sampling probability and decision after raking to source, language and topic shares."""
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of repeated line runs."""
    found = linededup.remove_repeated_lines(_table(spark, sf_dir, "documents"), min_lines=2, min_chars=200)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their place in sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 200-byte strings."""
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"), length=200).drop("spans")


def op9_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that documents share at identity 0.8 or more."""
    return chaining.shared_passages(_table(spark, sf_dir, "documents"), k=5, min_words=50, identity=0.8)


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by votes of its nearest labelled neighbours."""
    return knnquality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by templates deduced from the pages of its host."""
    return htmltext.main_texts(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first 16 whitened components, from exact integer cross-products."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's n-grams, and the 5 % that a Gumbel draw takes."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": op1_minhash,
        "op2_imatch": op2_imatch,
        "op3_cover_tree": op3_cover_tree,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_suffix_array": op8_suffix_array,
        "op9_chaining": op9_chaining,
        "op10_knn_quality": op10_knn_quality,
        "op11_templates": op11_templates,
        "op12_whitening": op12_whitening,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": linededup.oracle_sql(2, 200)}
