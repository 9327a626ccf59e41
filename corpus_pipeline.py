"""The corpus pipeline: quality classifier, near duplicates, decontamination, personal data, tokens.

Each stage takes the documents that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, importance, near_dedup, pieces, pii
from quillspark.llm._shared import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return importance.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by [kind]; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    return pieces.encode(docs.select("doc_id", "text")).select("doc_id", "n_pieces", "pieces", "lossless")


STAGES = [("quality", quality), ("near_duplicates", deduplication), ("decontamination", decontaminated), ("personal_data", private), ("tokens", tokens)]
#: The sketches, the weights and the draws have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
        # the table of the stage before has been read
        space.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
