"""Passes over observed files: what becomes of each, and how many of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.plans.registry import Registry
from parchment.sources.tables import table
from parchment.streaming import files

REGISTRY = Registry()


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as observations of files: every fifth comes without a new time of change, and some turns are decisions."""
    k, turn = F.col("conv_id"), F.col("turn")
    kind = F.when(k % 2 == 0, "guiding.bylaws").when(k % 3 == 0, "bill.other").otherwise("minutes.senate")
    action = F.when((turn > 1) & ((k + turn) % 6 == 0), F.when(k % 4 == 0, "reject").otherwise("accept")).otherwise("seen")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((turn - F.when(turn % 5 == 4, 1).otherwise(0)).cast("int"))
    return table(spark, sf_dir, "conversations").select(k.alias("file_id"), turn.alias("seq"), action.alias("action"), kind.alias("kind"), at.alias("modified"), F.col("text").alias("content"))


@REGISTRY()
def file_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every observation, and what is published, held and refused after it."""
    return files.lives(observations(spark, sf_dir))


@REGISTRY()
def files_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of a pass: observations by what became of them."""
    return file_lives(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))
