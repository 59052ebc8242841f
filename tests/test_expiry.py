"""State with a time to live: the same end state as in batch for any cut of the input."""

import pytest
from pyspark.sql import functions as F

from parchment.streaming import expiry
from tests.oracles import SMALL

DAY = 86400
LIVES, OTHERWISE = {"purchase": 30 * DAY, "signup": 7 * DAY}, 900


@pytest.mark.parametrize("files, order", [(1, "ts"), (5, "ts"), (4, "event_id % 7, ts")])
def test_the_end_state_is_that_of_batch(spark, tmp_path, files, order):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    rows = events.orderBy(*[F.expr(o) for o in order.split(", ")]).collect()
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = "3650 days" if "%" in order else "0 seconds"  # out of order: nothing may be late
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = expiry.expiring_state(stream, LIVES, OTHERWISE, late=late)
    name = f"expiry_{files}"
    out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(100)
    got = spark.table(name)
    at = events.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    life = F.lit(OTHERWISE)
    for kind, n in LIVES.items():
        life = F.when(F.col("event_type") == kind, n).otherwise(life)
    want = events.groupBy("user_id", "event_type").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms")).where(F.col("last_ms") + life.cast("long") * 1000 >= at)
    assert {tuple(r) for r in expiry.live_at(got, at).collect()} == {tuple(r) for r in want.collect()}
    gone = got.where("not live").collect()
    assert all(r.ends_ms <= at for r in gone)
