"""Price bars: building, validation, gaps, coverage, as-of alignment, forward returns.

All windows are partitioned by symbol, or by symbol and day where a symbol alone may be too large.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ohlcv(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of one ``unit``: first, highest, lowest and last price, and the number of ticks."""
    at = F.struct("ts", "event_id")
    return (
        ticks.withColumn("open_time", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
        .groupBy("symbol", "open_time")
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    )


def validate(bars: DataFrame) -> DataFrame:
    """Error and warning codes of each bar. A bar with errors gets no warnings."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    errors = F.array_compact(F.array(
        F.when(F.least(o, h, lo, c) <= 0, "NON_POSITIVE"), F.when(o.isNull() | h.isNull() | lo.isNull() | c.isNull(), "MISSING_PRICE"),
        F.when(h < F.greatest(o, c), "HIGH_TOO_LOW"), F.when(lo > F.least(o, c), "LOW_TOO_HIGH"), F.when(h < lo, "HIGH_BELOW_LOW"),
        F.when(v < 0, "NEGATIVE_VOLUME"), F.when(F.col("open_time").isNull(), "MISSING_TIME"),
    ))
    warnings = F.array_compact(F.array(F.when(v == 0, "ZERO_VOLUME"), F.when(F.try_divide(h - lo, c) > 0.02, "WIDE_RANGE")))
    return bars.withColumn("errors", errors).select("*", (F.size("errors") == 0).alias("valid"), F.when(F.size("errors") == 0, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def gaps(bars: DataFrame, minutes: int = 60) -> DataFrame:
    """Stretches without bars within a day, longer than 1.5 intervals."""
    day = Window.partitionBy("symbol", F.to_date("open_time")).orderBy("open_time")
    x = bars.withColumn("next", F.lead("open_time").over(day)).withColumn("away", F.timestamp_diff("MINUTE", "open_time", "next"))
    return x.filter(F.col("away") > 1.5 * minutes).select("symbol", F.col("open_time").alias("gap_start"), F.col("next").alias("gap_end"), (F.bround(F.col("away") / minutes) - 1).cast("long").alias("missing"))


def daily_coverage(bars: DataFrame, expected: int = 24) -> DataFrame:
    return bars.groupBy("symbol", F.to_date("open_time").alias("d")).agg(F.count(F.lit(1)).alias("bars"), F.min("open_time").alias("first"), F.max("open_time").alias("last")).withColumn(
        "pct", F.round(F.least(F.col("bars") * 100.0 / expected, F.lit(100.0)), 1)
    )


def missing_ranges(days: DataFrame, keys: Sequence[str] = ("symbol",), d: str = "d") -> DataFrame:
    """By key, islands of weekdays without a row between the key's first and last day; a weekend ends an island."""
    have = days.select(*keys, F.col(d).alias("d")).distinct()
    span = have.groupBy(*keys).agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is not null")
    weekdays = span.select(*keys, F.explode(F.sequence("a", "b")).alias("d")).filter(F.weekday("d") < 5)
    gone = weekdays.join(have, [*keys, "d"], "left_anti")
    run = F.datediff("d", F.lit("1970-01-01")) - F.row_number().over(Window.partitionBy(*keys).orderBy("d"))
    return gone.withColumn("run", run).groupBy(*keys, "run").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count(F.lit(1)).alias("days")).drop("run")


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], bucket: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Each left row with the latest right row at or before its time, by key; null if there is none.

    Both sides meet in one union, and a window carries the last right values forward: one shuffle, no
    range join. ``bucket`` (such as ``F.to_date``) splits a key's rows by time, so that a large key
    spreads over tasks; the last values of the buckets before come from one row a bucket.
    """
    packed = F.struct(*(F.col(v) for v in values))
    part = (lambda c: bucket(F.col(c))) if bucket else (lambda c: F.lit(0))
    a = left.select(*keys, part(left_time).alias("_b"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    b = right.select(*keys, part(right_time).alias("_b"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    if bucket:
        ends = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_end"))
        earlier = ends.select(*keys, "_b", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
        found = found.join(earlier, [*keys, "_b"]).withColumn("_v", F.coalesce("_v", "_carried"))
    return found.select("_row.*", *(F.col(f"_v.{v}").alias(f"asof_{v}") for v in values))


def forward_returns(bars: DataFrame, horizons: Sequence[int] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """Close-to-close returns in per cent, k bars later, and the best and worst close on the way."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    close = F.col("close")
    ret = lambda x: F.round(F.try_divide((x - close) * 100, close), 4)
    ahead = w.rowsBetween(0, max(horizons))
    return bars.select("symbol", "open_time", *(ret(F.lead("close", k).over(w)).alias(f"ret_{k}") for k in horizons), ret(F.max("close").over(ahead)).alias("mfe"), ret(F.min("close").over(ahead)).alias("mae"))


def forward_range(bars: DataFrame, k: int = 10) -> DataFrame:
    """Range, upside and downside of the next k bars as a share of the close; null without k bars."""
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(1, k)
    hi, lo, n, c = F.max("high").over(w), F.min("low").over(w), F.count(F.lit(1)).over(w), F.col("close")
    part = lambda x: F.round(F.when(n == k, F.try_divide(x, c)), 6)
    return bars.select("symbol", "open_time", part(hi - lo).alias("range"), part(hi - c).alias("upside"), part(c - lo).alias("downside"))


def last_write_wins(bars: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Upsert semantics over an append log: of rows with equal keys the latest arrival, kept by an aggregate that needs no sort of the log."""
    rest = [c for c in bars.columns if c not in keys]
    last = bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("_r"))
    return last.select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in bars.columns))
