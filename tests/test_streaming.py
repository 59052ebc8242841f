from parchment.operators.forum import sliding_log
from parchment.streaming import limiters
from tests.oracles import SMALL


def _stream(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def _drain(df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)


def test_fixed_windows_agree_with_batch(spark, tmp_path):
    _drain(limiters.fixed_window_counts(_stream(spark, tmp_path)), "fixed", "complete", tmp_path)
    got = {(r.user_id, r.starts): r.used for r in spark.table("fixed").collect()}
    want = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("user_id", "date_trunc('hour', cast(ts as timestamp)) as starts").groupBy("user_id", "starts").count().collect()
    assert got == {(r.user_id, r.starts): r["count"] for r in want}


def test_sliding_log_agrees_with_batch(spark, tmp_path):
    _drain(limiters.sliding_log_stream(_stream(spark, tmp_path), 3, 86400.0), "sliding", "append", tmp_path)
    got = {r.event_id: r.allowed for r in spark.table("sliding").collect()}
    want = {r.event_id: r.allowed for r in sliding_log(spark.read.parquet(f"{SMALL}/events.parquet"), "user_id", "ts", "event_id", 3, 86400.0).collect()}
    assert got == want and len(got) > 100
