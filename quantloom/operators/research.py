"""Statistics of signals and returns: groups, quintiles, corrections, regression, walk-forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gex import regime


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, population deviation, share above 0, nearest-rank quartiles, extremes.

    Quartiles come from ranks in a window, not from one array a group.
    """
    v = F.col(value)
    w = Window.partitionBy(*by).orderBy(v)
    x = df.filter(v.isNotNull()).withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    at = lambda i: F.max(F.when(F.col("_r") == i, v))
    n = F.col("_n")
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.stddev_pop(v), 4).alias("std"),
        F.round(F.avg((v > 0).cast("int")) * 100, 2).alias("win_pct"), at(F.floor(n / 4)).alias("p25"), at(F.least(F.floor(3 * n / 4), n - 1)).alias("p75"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def quintiles(df: DataFrame, feature: str, outcome: str, order: str) -> DataFrame:
    """Mean outcome in fifths of the sorted feature; the last fifth takes what is left over."""
    x = df.filter(F.col(feature).isNotNull() & F.col(outcome).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(feature, order)) - 1
    q = F.least(F.floor(F.try_divide(r, F.greatest(F.floor(n / 5), F.lit(1)))), F.lit(4)) + 1
    return x.withColumn("quintile", q.cast("int")).groupBy("symbol", "quintile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(outcome), 6).alias("mean"), F.min(feature).alias("low"), F.max(feature).alias("high"))


def adjust(df: DataFrame, p: str, name: str) -> DataFrame:
    """Benjamini-Hochberg, Holm and Bonferroni adjusted p-values; one row a test."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    up = Window.orderBy(p, name)
    x = df.withColumn("_n", n).withColumn("_r", F.row_number().over(up))
    bh = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(up.rowsBetween(0, Window.unboundedFollowing))
    holm = F.max(F.col(p) * (F.col("_n") - F.col("_r") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    one = lambda c: F.round(F.least(c, F.lit(1.0)), 6)
    return x.select(name, p, one(bh).alias("bh"), one(holm).alias("holm"), one(F.col(p) * F.col("_n")).alias("bonferroni"))


def ols(df: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.round(F.regr_slope(y, x), 8).alias("beta"), F.round(F.regr_intercept(y, x), 6).alias("alpha"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def signals(daily: DataFrame, ret: str = "ret") -> DataFrame:
    """One row for each signal a day gives, with the return in the signal's direction."""
    w = Window.partitionBy("symbol").orderBy("d")
    net, before = F.col("net_c"), F.lag("net_c").over(w)
    x = daily.withColumn("before", before).withColumn("change", net - before).withColumn("up", F.col("spot") - F.lag("spot").over(w))
    x = x.withColumn("accel", F.col("change") - F.lag("change").over(w)).filter(F.col(ret).isNotNull())
    r = F.col(ret)
    rules: list[tuple[str, Column, Column]] = [
        ("regime_shift", (F.col("before") < 0) & (net > 0), r),
        ("negative_expansion", (net < 0) & (F.col("change") < 0), F.abs(r)),
        ("acceleration", F.col("accel") > 0, r),
        ("bearish_divergence", (F.col("up") > 0) & (F.col("change") <= 0), -r),
        ("bullish_divergence", (F.col("up") <= 0) & (F.col("change") > 0), r),
    ]
    found = F.explode(F.array_compact(F.array(*(F.when(when, F.struct(F.lit(name).alias("signal"), value.alias("value"))) for name, when, value in rules))))
    return x.select("symbol", "d", found.alias("s")).select("symbol", "d", "s.signal", "s.value")


def walk_forward(daily: DataFrame, share: float = 0.7) -> DataFrame:
    """Mean return by regime in the first ``share`` of days and in the rest."""
    n, r = F.count(F.lit(1)).over(Window.partitionBy("symbol")), F.row_number().over(Window.partitionBy("symbol").orderBy("d"))
    part = F.when(r <= F.floor(n * share), "train").otherwise("test")
    x = daily.withColumn("part", part).withColumn("regime", regime(F.col("net_c"))).filter("ret is not null")
    return x.groupBy("symbol", "part", "regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.avg((F.col("ret") > 0).cast("int")) * 100, 2).alias("win_pct"))


def robustness(df: DataFrame, value: str, by: Sequence[str], trim: float = 0.05) -> DataFrame:
    """Mean with and without the extreme ``trim`` of each tail; ROBUST if both are large and agree in sign."""
    n, r = F.count(F.lit(1)).over(Window.partitionBy(*by)), F.row_number().over(Window.partitionBy(*by).orderBy(value, "d"))
    cut = F.greatest(F.floor(F.lit(trim) * n), F.lit(1))
    inner = F.when((r > cut) & (r <= n - cut), F.col(value))
    x = df.withColumn("_inner", inner).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.avg("_inner").alias("t"))
    robust = (F.col("n") >= 30) & (F.abs("m") > 0.001) & (F.signum("m") == F.signum("t"))
    return x.select(*by, "n", F.round("m", 4).alias("mean"), F.round("t", 4).alias("trimmed"), F.coalesce(robust, F.lit(False)).alias("robust"))
