"""Chain reports: lineage joins, top lists, nearest snapshots, zones and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["symbol", "d", "expiry", "strike", "option_type"]


def _share(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(a * 100.0, b), digits)


def oi_lineage(greeks: DataFrame, candles: DataFrame) -> DataFrame:
    """Greek rows with the open interest of their candle: status MATCHED, ZERO_OI or MISSING_OI, by symbol and side."""
    oi = candles.groupBy(*KEYS).agg(F.sum("oi").alias("oi"))
    x = greeks.select(*KEYS).distinct().join(oi, KEYS, "left")
    status = F.when(F.col("oi").isNull(), "MISSING_OI").when(F.col("oi") <= 0, "ZERO_OI").otherwise("MATCHED")
    return x.groupBy("symbol", "option_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("oi").alias("oi"))


def missing_greeks(candles: DataFrame, greeks: DataFrame) -> DataFrame:
    """Candles without Greeks, counted by symbol and expiry."""
    return candles.select(*KEYS).distinct().join(greeks.select(*KEYS).distinct(), KEYS, "left_anti").groupBy("symbol", "expiry").agg(F.count(F.lit(1)).alias("n"))


def expiries_with_both(candles: DataFrame, greeks: DataFrame) -> DataFrame:
    """Expiries of candles that have Greeks at all, with strikes and rows."""
    return candles.join(greeks.select("symbol", "expiry").distinct(), ["symbol", "expiry"], "left_semi").groupBy("symbol", "expiry").agg(F.countDistinct("strike").alias("strikes"), F.count(F.lit(1)).alias("n"))


def side_sums(chain: DataFrame) -> DataFrame:
    """Open interest and premium turnover of both sides by symbol and time, and the change of open interest since the time before."""
    of = lambda t, c: F.sum(F.when(F.col("option_type") == t, c).otherwise(0))
    x = chain.groupBy("symbol", "d").agg(of("CE", F.col("oi")).alias("call_oi"), of("PE", F.col("oi")).alias("put_oi"), of("CE", F.col("oi") * F.col("ltp")).alias("call_value"), of("PE", F.col("oi") * F.col("ltp")).alias("put_value"))
    w = Window.partitionBy("symbol").orderBy("d")
    total = F.col("call_oi") + F.col("put_oi")
    return x.withColumn("oi_change", total - F.lag(total).over(w))


def top_instruments(chain: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` options of each symbol with the most open interest at once."""
    x = chain.groupBy("symbol", "expiry", "strike", "option_type").agg(F.max("oi").alias("max_oi"), F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("max_oi"), F.desc("n"), "expiry", "strike", "option_type"))
    return x.withColumn("rank", r).filter(F.col("rank") <= k)


def closest_time(chain: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target time the nearest time of each symbol; of two the earlier.

    Both neighbours come from one window over times and targets, so no target meets all times.
    """
    times = chain.select("symbol", "d").distinct().select("symbol", F.col("d").alias("at"), F.col("d").alias("seen"), F.lit(False).alias("asked"))
    asked = targets.select("symbol", F.col("target").alias("at"), F.lit(None).cast("date").alias("seen"), F.lit(True).alias("asked"))
    before = Window.partitionBy("symbol").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("symbol").orderBy(F.desc("at"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    x = times.unionByName(asked).withColumn("b", F.last("seen", ignorenulls=True).over(before)).withColumn("a", F.last("seen", ignorenulls=True).over(after)).filter("asked")
    gap_b, gap_a = F.datediff("at", "b"), F.datediff("a", "at")
    return x.select("symbol", F.col("at").alias("target"), F.when(F.col("b").isNull() | (gap_a < gap_b), F.col("a")).otherwise(F.col("b")).alias("closest"))


def zones(chain: DataFrame, lot: int = 5) -> DataFrame:
    """By symbol and distance zone of the strike: rows, open interest and the share that is a whole number of lots."""
    pct = F.abs(F.col("strike") - F.col("spot")) * 100.0 / F.col("spot")
    zone = F.when(pct <= 2, "ATM").when(pct <= 5, "NEAR").when(pct <= 10, "MID").otherwise("FAR")
    return chain.groupBy("symbol", zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.sum("oi").alias("oi"), _share(F.count_if(F.col("oi") % lot == 0), F.count(F.lit(1))).alias("whole_lots_pct"))


def expiry_weekdays(chain: DataFrame) -> DataFrame:
    day = F.date_format("expiry", "EEEE")
    return chain.select("symbol", "expiry").distinct().groupBy("symbol", day.alias("weekday")).agg(F.count(F.lit(1)).alias("expiries"))


def expiry_buckets(chain: DataFrame) -> DataFrame:
    """By symbol and time: open interest to near (7 days), mid (14) and far expiries, and the calls' share of exposure."""
    dte = F.datediff("expiry", "d")
    part = lambda when: F.sum(F.when(when, F.col("oi")).otherwise(0))
    raw = lambda t: F.sum(F.when(F.col("option_type") == t, F.col("gamma_c") * F.col("oi")).otherwise(0))
    x = chain.filter("option_type in ('CE', 'PE') and oi > 0").groupBy("symbol", "d").agg(part(dte <= 7).alias("near"), part((dte > 7) & (dte <= 14)).alias("mid"), part(dte > 14).alias("far"), raw("CE").alias("c"), raw("PE").alias("p"))
    return x.select("symbol", "d", "near", "mid", "far", _share(F.col("c"), F.col("c") + F.col("p")).alias("call_share_pct"))


def greek_totals(positions: DataFrame, *by: str) -> DataFrame:
    """Signed sums of a Greek (``delta_m``, thousandths) where it is known: total, status, and each group's share of all."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")) * F.col("delta_m")
    x = positions.groupBy(*by).agg(F.sum(signed).alias("total_m"), F.count("delta_m").alias("known"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("known") == 0, "unavailable").when(F.col("known") < F.col("n"), "partial").otherwise("available")
    # one row a group
    return x.select(*by, "total_m", "known", status.alias("status"), _share(F.abs("total_m"), F.sum(F.abs("total_m")).over(Window.partitionBy())).alias("share_pct"))
