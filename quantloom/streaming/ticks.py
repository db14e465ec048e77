"""Live ticks with Structured Streaming: bars by event time, and the latest tick of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "3 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ``symbol, ts, event_id, price``; ticks over ``late`` behind are dropped.

    A watermark needs TIMESTAMP, so naive times are read in the session's time zone.
    """
    at = F.struct("ts", "event_id")
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
        .select("symbol", F.col("window.start").alias("open_time"), "open", "high", "low", "close", "volume")
    )


def latest_ticks(ticks: DataFrame) -> DataFrame:
    """The last tick of each symbol, for update or complete output."""
    last = F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id"))
    return ticks.groupBy("symbol").agg(last.alias("last")).select("symbol", "last.*")


def snapshot_dedup(snapshots: DataFrame, keys: list[str], within: str = "60 seconds") -> DataFrame:
    """Snapshots of a stream without those of the same key within ``within``."""
    return snapshots.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", within).dropDuplicatesWithinWatermark(keys)


def freshness(latest: DataFrame, now: DataFrame, stale_after: int = 10) -> DataFrame:
    """LIVE or STALE for each symbol: no tick for ``stale_after`` seconds before ``now`` (one row, ``now``)."""
    age = F.timestamp_diff("SECOND", "ts", "now")
    return latest.join(F.broadcast(now)).select("symbol", age.alias("age_seconds"), F.when(age > stale_after, "STALE").otherwise("LIVE").alias("status"))


def rebuilt_chain(ticks: DataFrame) -> DataFrame:
    """The chain of a symbol and expiry from the latest tick of each option: one row a strike, both sides; rows that are no option are left out."""
    last = F.max_by(F.struct("price", "ts"), F.struct("ts", "event_id"))
    x = ticks.filter("option_type in ('CE', 'PE')").groupBy("symbol", "expiry", "strike", "option_type").agg(last.alias("l"))
    of = lambda t, c: F.max(F.when(F.col("option_type") == t, F.col(f"l.{c}")))
    return x.groupBy("symbol", "expiry", "strike").agg(of("CE", "price").alias("call"), of("PE", "price").alias("put"), F.max("l.ts").alias("as_of"))


def repeats(snapshots: DataFrame, content: str, within: int, *by: str) -> DataFrame:
    """Snapshots with ``repeat``: whether the oldest of the same key in the ``within`` seconds up to it has the same content."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-within * 1_000_000, 0)
    oldest = F.min(F.struct("ts", "event_id", content)).over(w)
    return snapshots.withColumn("o", oldest).select(*snapshots.columns, ((F.col("o.event_id") != F.col("event_id")) & (F.col(f"o.{content}") == F.col(content))).alias("repeat"))
