"""Corpus preparation as a chain of stages over the documents table.

Each stage is a function of (spark, docs, sf_dir) that returns what it kept; ``run`` writes each result as Parquet to the
shared folder and reads it again for the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import _common, decontamination, packing, quality_rules, secret_scan, simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model over the quality rules keeps."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash group."""
    return simhash_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secret scan", secrets), ("packing", pack)]

#: The label model and the fingerprints can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
