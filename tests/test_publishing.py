"""A run is seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from parchment.sources.publishing import Published
from parchment.sources.scratch import folder


def rows(spark, version, chunk):
    return spark.range(5).select((F.col("id") + 10 * chunk).alias("id"), F.lit(version).alias("version"))


def seen(table):
    return sorted((r.id, r.version, r.chunk) for r in table.read().collect())


def test_a_failed_chunk_leaves_what_was_there(spark):
    table = Published(spark, folder(spark, "published"))
    assert table.read() is None
    table.publish("a", {k: rows(spark, 1, k) for k in range(3)})
    first = seen(table)
    assert len(first) == 15 and {v for _, v, _ in first} == {1}
    broken = rows(spark, 2, 1).withColumn("version", F.when(F.col("id") == 13, F.raise_error(F.lit("killed"))).otherwise(F.lit(2)).cast("int"))
    with pytest.raises(Exception, match="killed"):
        table.publish("b", {0: rows(spark, 2, 0), 1: broken, 2: rows(spark, 2, 2)})
    assert seen(table) == first and table.staged("b", range(3)) == [0]
    with pytest.raises(ValueError, match=r"chunks \[1, 2\] of run b"):
        table.commit("b", range(3))
    assert seen(table) == first
    table.publish("b", {k: rows(spark, 2, k) for k in range(3)})
    assert {v for _, v, _ in seen(table)} == {2} and len(seen(table)) == 15


def test_a_run_again_changes_nothing_and_stray_chunks_are_not_seen(spark):
    table = Published(spark, folder(spark, "published"))
    table.publish("a", {0: rows(spark, 1, 0), 1: rows(spark, 1, 1)})
    before = seen(table)
    table.stage("a", 7, rows(spark, 9, 7))
    table.publish("a", {0: rows(spark, 5, 0), 1: rows(spark, 5, 1)})
    assert seen(table) == before
    table.publish("c", {4: rows(spark, 3, 4)})
    assert {c for _, _, c in seen(table)} == {4}
