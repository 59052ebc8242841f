"""Writes that replace what is there by key or by partition, over parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(held: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Held and new rows with the latest of each key; among equals the new one wins."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def inserted_where_absent(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't held, each key once."""
    return new.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti")


def replace_partitions(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Writes ``rows`` over exactly the partitions that they have; others stay."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*partition_by).parquet(path)
