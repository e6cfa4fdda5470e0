"""A corpus pipeline: reject bad text, keep one of each near-duplicate group, drop benchmark text, blank secrets, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; `run` writes each result as Parquet
below ``spark.checkpoint.dir`` and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import bpe, decontaminate, neardup, quality, secret_scan
from vantage.llm.common import small_batches
from vantage.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id."""
    return neardup.keep_first(_columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and `n_chars` counted anew where there were any."""
    rows = secret_scan.scan(_columns(docs)).withColumn("clean", secret_scan.redacted(F.col("text"), F.col("found")))
    chars = F.when(F.size("found") > 0, F.char_length("clean").cast("long")).otherwise(F.col("input.n_chars"))
    return rows.select("doc_id", F.col("clean").alias("text"), F.col("input.lang").alias("lang"), F.col("input.source").alias("source"), chars.alias("n_chars"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's whole text, and whether they decode to it."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_checked(_columns(docs), path).select("doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("encoding", encode_stage),
]

#: Learned scores and sketches are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
