"""A training-corpus pipeline over `documents`: each stage is written as Parquet and read again by the next.

Every stage but the last returns the columns of documents, in rows that it kept, changed or put in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import bpe, mixing, quality, simhash, substring
from marlpit.llm.text import materialize, row_keys


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from labels, accepts (score of 0.3 or more)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: of each group the document with the smallest doc_id stays."""
    return simhash.keep_one(docs, radius=2, shingle=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has too are cut from the texts."""
    return substring.without_repeats(docs, window=50)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their sources interleaved to target weights: the order of rows in the files."""
    return mixing.in_order(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, slot, position): position counts the rows in mixed order from 0.

    Files are read again in any order, so the place of a row goes along as columns. It follows from the rows alone: the
    mix of docs here is the one that source_mixing wrote.
    """
    key, check = row_keys("doc_id", "text")
    row = F.struct("doc_id", "source", key.alias("row_key"), check.alias("row_check"))
    encoded = bpe.encode(docs.select(row.alias("row"), "text"), id_col="row").select("row.*", "n_tokens", "ids", "ids_sha256")
    encoded = materialize(encoded.withColumn("tie", F.monotonically_increasing_id()), "pipeline-encoded")
    places = mixing.places(encoded.select("doc_id", "source", "row_key", "row_check", "tie")).select("tie", "slot", "position")
    return encoded.join(places, "tie").select("doc_id", "n_tokens", "ids", "ids_sha256", "slot", "position")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
