"""Streams give what the same operators give on tables."""

from pyspark.sql import functions as F

from quantloom.streaming import ticks as T


def _run(stream, tmp_path, name, mode):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    run.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_latest_ticks(spark, sf_dir, tmp_path):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
    ticks.write.parquet(f"{tmp_path}/in")
    got = _run(T.latest_ticks(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")), tmp_path, "latest_out", "complete")
    want = T.latest_ticks(ticks)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_snapshot_dedup(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:00:20"), ("b", "2024-01-01 10:00:20")]
    df = spark.createDataFrame(rows, "key string, at string").select("key", F.to_timestamp("at").alias("captured_at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = _run(T.snapshot_dedup(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["key"]), tmp_path, "dedup_out", "append")
    assert sorted(r["key"] for r in got.collect()) == ["a", "b"]


def test_repeats_look_at_the_oldest(spark):
    rows = [(1, 1, "2024-01-01 10:00:00", "x"), (1, 2, "2024-01-01 10:00:30", "y"), (1, 3, "2024-01-01 10:00:40", "x"), (1, 4, "2024-01-01 10:01:10", "x")]
    df = spark.createDataFrame(rows, "k int, event_id int, at string, content string").select("k", "event_id", F.to_timestamp("at").alias("ts"), "content")
    # the fourth looks back to the second, whose content differs
    assert {r["event_id"]: r["repeat"] for r in T.repeats(df, "content", 60, "k").collect()} == {1: False, 2: False, 3: True, 4: False}
