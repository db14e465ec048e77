"""Does exposure compress the range: rolling windows, straddles sold at high and at low exposure, and what a feature adds to price alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .factors import exact_mean


def _series() -> Window:
    return Window.partitionBy("symbol").orderBy("d")


def with_ranges(rows: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """``range_<horizon>``: highest less lowest spot of so many rows ahead in per cent of spot; null where there are fewer."""
    out = {}
    for h, k in horizons.items():
        ahead = _series().rowsBetween(1, k)
        width = (F.max("spot").over(ahead) - F.min("spot").over(ahead)) * 100.0 / F.col("spot")
        out[f"range_{h}"] = F.when(F.count("spot").over(ahead) == k, F.round(width, 4))
    return rows.withColumns(out)


def _at(value: str, percent: int, *by: str) -> tuple[Column, Column]:
    """Rank and place of the lower percentile: the value at the floor of its share of the last place."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(value, "d")) - 1
    return rank, F.floor(F.lit(percent) * (F.count(F.lit(1)).over(w) - 1) / 100)


def _levels(x: DataFrame, value: str, *by: str) -> DataFrame:
    """``x`` with the lower 20th and 80th percentile of ``value`` within its groups, and their size."""
    rank, low = _at(value, 20, *by)
    _, high = _at(value, 80, *by)
    x = x.withColumns({"_rank": rank, "_low": low, "_high": high, "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    pick = lambda place: F.max(F.when(F.col("_rank") == F.col(place), F.col(value))).over(Window.partitionBy(*by))
    return x.withColumns({"q20": pick("_low"), "q80": pick("_high")}).drop("_rank", "_low", "_high")


def stability(rows: DataFrame, value: str = "abs_gex", range_col: str = "range_15m", days: int = 90, step: int = 30, least: int = 20) -> DataFrame:
    """Windows of ``days`` that begin every ``step`` days from a symbol's first: mean range where exposure is under its 20th and over its 80th percentile.

    Windows that would reach beyond the last day are left out, as are those with few rows or an empty side.
    """
    x = rows.filter(F.col(range_col).isNotNull()).select("symbol", "d", value, F.col(range_col).alias("range"))
    whole = Window.partitionBy("symbol")
    x = x.withColumn("at", F.datediff("d", F.min("d").over(whole))).withColumn("end", F.max("at").over(whole)).withColumn("begin", F.min("d").over(whole))
    first = F.greatest(F.floor((F.col("at") - days) / step) + 1, F.lit(0))
    last = F.least(F.floor(F.col("at") / step), F.floor((F.col("end") - days) / step))
    x = x.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    x = _levels(x, value, "symbol", "k").filter(F.col("n") >= least)
    side = lambda when: exact_mean(F.col("range"), when)
    g = x.groupBy("symbol", F.date_add("begin", (F.col("k") * step).cast("int")).alias("start"), "n").agg(side(F.col(value) < F.col("q20")).alias("low"), side(F.col(value) > F.col("q80")).alias("high"))
    return g.filter("low is not null and high is not null").select("symbol", "start", "n", F.col("low").alias("low_range"), F.col("high").alias("high_range"), (F.col("low") - F.col("high")).alias("compression"))


def straddles(chain: DataFrame) -> DataFrame:
    """symbol, d, strike, expiry, premium: the option pair nearest to spot (ties: lower strike, earlier expiry), where both sides have a price."""
    of = lambda t: F.max(F.when(F.col("option_type") == t, F.col("ltp")))
    pairs = chain.filter("option_type in ('CE', 'PE')").groupBy("symbol", "d", "strike", "expiry").agg(of("CE").alias("call"), of("PE").alias("put"), F.min("spot").alias("spot"))
    near = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("far"), "strike", "expiry", "call", "put")).alias("m")
    return pairs.groupBy("symbol", "d").agg(near).select("symbol", "d", "m.strike", "m.expiry", (F.col("m.call") + F.col("m.put")).alias("premium")).filter("premium is not null")


def straddle_study(rows: DataFrame, pairs: DataFrame, horizons: Sequence[str], value: str = "abs_gex", cost: float = 0.0015) -> DataFrame:
    """Straddles sold where exposure is over its 80th percentile (HIGH) and under its 20th (LOW): premium, ranges ahead, and result before and after costs.

    A range in points is that share of the symbol's first spot; the result is premium less the first horizon's.
    """
    x = rows.join(pairs.select("symbol", "d", "premium"), ["symbol", "d"])
    x = _levels(x, value, "symbol").withColumn("first", F.min(F.struct("d", "spot")).over(Window.partitionBy("symbol"))["spot"])
    x = x.withColumn("side", F.when(F.col(value) > F.col("q80"), "HIGH").when(F.col(value) < F.col("q20"), "LOW")).filter("side is not null")
    g = x.groupBy("symbol", "side", "first").agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col("premium")).alias("p"), *(exact_mean(F.col(f"range_{h}")).alias(f"r_{h}") for h in horizons))
    points = F.col(f"r_{horizons[0]}") / 100 * F.col("first")
    return g.select(
        "symbol", "side", "n", F.col("p").alias("premium"), *(F.col(f"r_{h}").alias(f"range_{h}") for h in horizons), (F.col("p") * cost).alias("cost"),
        (F.col("p") - points).alias("result"), (F.col("p") - points - F.col("p") * cost).alias("result_after_cost"),
    )


def baseline(rows: DataFrame, back: int = 5) -> DataFrame:
    """Rows with what price alone tells: the last return, volatility, range, momentum and the distances from high and low of ``back`` rows; 0 where unknown."""
    w = _series().rowsBetween(1 - back, 0)
    spot, before = F.col("spot"), F.lag("spot").over(_series())
    x = rows.withColumn("previous_return", F.coalesce(F.round((spot - before) * 100.0 / before, 6), F.lit(0.0)))
    high, low = F.max("spot").over(w), F.min("spot").over(w)
    return x.withColumns({
        "realized_volatility": F.round(F.coalesce(F.stddev_samp("previous_return").over(w), F.lit(0.0)), 6), "recent_range": F.round((high - low) * 100.0 / spot, 6),
        "momentum": F.coalesce(spot - F.lag("spot", 3).over(_series()), F.lit(0)), "from_high": F.round((spot - high) * 100.0 / high, 6), "from_low": F.round((spot - low) * 100.0 / low, 6),
    })


BASELINE = ("previous_return", "realized_volatility", "recent_range", "momentum", "from_high", "from_low")


def adds_information(rows: DataFrame, features: Sequence[str], outcome: str, least: int = 50, enough: float = 0.001) -> DataFrame:
    """By symbol and feature: the largest r² of any baseline feature alone, that with the feature, and whether it adds more than ``enough``.

    Features are unpivoted, so one aggregate gives every correlation of every feature's rows.
    """
    long = rows.select("symbol", F.col(outcome).alias("y"), *BASELINE, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")).select("*", "f.*").filter("x is not null and y is not null")
    # a feature that does not vary has no correlation, where corr() would divide by 0
    square = lambda c: F.coalesce(F.pow(F.try_divide(F.covar_pop(c, F.col("y")), F.stddev_pop(c) * F.stddev_pop("y")), 2), F.lit(0.0))
    g = long.groupBy("symbol", "feature").agg(F.count(F.lit(1)).alias("n"), F.greatest(*(square(F.col(c).cast("double")) for c in BASELINE)).alias("base"), square(F.col("x")).alias("own")).filter(F.col("n") >= least)
    both = F.greatest("base", "own")
    return g.select("symbol", "feature", "n", F.round("base", 8).alias("baseline_r2"), F.round(both, 8).alias("combined_r2"), F.round(both - F.col("base"), 8).alias("incremental_r2"), (both - F.col("base") > enough).alias("adds_information"))
