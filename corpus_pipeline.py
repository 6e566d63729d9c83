"""A corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import linededup, minhash, mixing, packing, toxicity
from pagemill.llm.common import keyed, stored

#: No stage but line dedup can be written in SQL. The tests hold the operators against brute force, and the stages' columns and packing.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is among those of gone; rows with a null id stay."""
    return docs.join(gone.select(F.col("doc_id").alias("_gone_id")).distinct(), docs["doc_id"] == F.col("_gone_id"), "left_anti")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one column, so that no name of a caller's column meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject at the balanced cut of its training rows."""
    scored = toxicity.toxic_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=None)
    return _without(docs, scored.where("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that lose all their lines go, n_chars follows the text."""
    found = linededup.remove_repeated_lines(_packed(docs)).where("n_removed = 0 or n_removed < n_lines")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") == 0, F.col("_row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group on 5-word shingles at similarity 0.8, and one row for each id and text; rows with
    a null id stay."""
    numbered = keyed(_packed(docs.where("doc_id is not null")), name="_number")
    found = minhash.near_duplicates(numbered.select("_number", "text"), id_col="_number", shingle_words=5, percent=80)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    once = numbered.dropDuplicates(["_number"]).join(gone, F.col("_number") == F.col("_gone"), "left_anti")
    return once.select("_row.*").unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet tempered shares of source, language and topic."""
    return _without(docs, mixing.mix_documents(docs).where("not selected"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, capacity=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash", dedup_near), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
