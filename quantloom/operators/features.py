"""Features and outcomes of bars, anomalies of series, walls by local maxima, strike grids, sweeps.

Bar windows run within a symbol; a frame holds a bounded number of bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import normal_pdf


def _pct(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide((a - b) * 100.0, b), digits)


def baseline(bars: DataFrame, n: int = 20) -> DataFrame:
    """Of the ``n`` bars strictly before each bar: last return, realised volatility, range, momentum, distances; null without all of them."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    x = bars.withColumn("r", F.try_divide(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)))
    f = w.rowsBetween(-n, -1)
    full = F.count("close").over(f) == n
    hi, lo, first, last = F.max("high").over(f), F.min("low").over(f), F.first("close").over(f), F.lag("close").over(w)
    part = lambda c: F.when(full, c)
    return x.select(
        "symbol", "open_time", F.round(F.lag("r").over(w) * 100, 6).alias("previous_return"), F.round(part(F.stddev_pop("r").over(f)) * 100, 6).alias("realised_vol"), part(_pct(hi, lo)).alias("range_pct"),
        part(_pct(last, first)).alias("momentum_pct"), part(_pct(hi, F.col("close"))).alias("to_high_pct"), part(_pct(lo, F.col("close"))).alias("to_low_pct"),
    )


def outcomes(bars: DataFrame, horizons: Sequence[int] = (1, 3, 5, 10, 15, 30)) -> DataFrame:
    """By horizon: return, excursions by the final direction and the bars there were; a shorter tail is taken as it is."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    close = F.col("close")

    def of(k: int) -> Column:
        f = w.rowsBetween(1, k)
        return F.struct(F.lit(k).alias("horizon"), F.count("close").over(f).alias("bars"), F.last("close").over(f).alias("end"), F.max("high").over(f).alias("hi"), F.min("low").over(f).alias("lo"))

    x = bars.select("symbol", "open_time", "close", F.array(*(of(k) for k in horizons)).alias("h")).select("symbol", "open_time", "close", F.explode("h").alias("h")).select("symbol", "open_time", "close", "h.*").filter("bars > 0")
    up = F.col("end") >= close
    return x.select(
        "symbol", "open_time", "horizon", "bars", _pct(F.col("end"), close, 4).alias("ret"),
        F.when(up, _pct(F.col("hi"), close, 4)).otherwise(-_pct(F.col("lo"), close, 4)).alias("mfe"), F.when(up, _pct(F.col("lo"), close, 4)).otherwise(-_pct(F.col("hi"), close, 4)).alias("mae"),
    )


def session_as_of(options: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each option row with the last index close above 0 of the same day's session (09:15 to 15:30) at or before it; null if there is none.

    The day is a key, so that a symbol spreads over its days.
    """
    minute = lambda t: F.hour(t) * 60 + F.minute(t)
    build = index.filter((F.col("close") > 0) & minute(F.col("open_time")).between(555, 930)).select(*keys, F.to_date("open_time").alias("day"), F.col("open_time").alias("t"), F.lit(0).alias("ask"), "close", F.lit(None).cast("long").alias("row"))
    probe = options.select(*keys, F.to_date("ts").alias("day"), F.col("ts").alias("t"), F.lit(1).alias("ask"), F.lit(None).cast("double").alias("close"), F.col("event_id").alias("row"))
    w = Window.partitionBy(*keys, "day").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return build.unionByName(probe).withColumn("spot", F.last("close", ignorenulls=True).over(w)).filter("ask = 1").select(*keys, F.col("row").alias("event_id"), "spot")


def anomalies(series: DataFrame, value: str, window: int = 20, least: int = 5) -> DataFrame:
    """Trailing mean, median, extremes and z of each value, and its size as a share of three deviations."""
    w = Window.partitionBy("symbol").orderBy("d").rowsBetween(1 - window, 0)
    v = F.col(value)
    x = series.withColumn("n", F.count(v).over(w)).withColumn("m", F.avg(v).over(w)).withColumn("sd", F.stddev_pop(v).over(w)).withColumn("seen", F.array_sort(F.collect_list(v).over(w))).withColumn("lo", F.min(v).over(w)).withColumn("hi", F.max(v).over(w))
    z = F.when((F.col("n") >= least) & (F.col("sd") > 0), (v - F.col("m")) / F.col("sd"))
    size = F.least(F.abs("z") / 3 * 100, F.lit(100.0))
    half = lambda k: F.element_at("seen", k.cast("int"))
    median = (half(F.floor((F.col("n") + 1) / 2)) + half(F.floor(F.col("n") / 2) + 1)) / 2.0
    return x.withColumn("z", z).select(
        "symbol", "d", "n", F.round("m", 6).alias("mean"), F.round(median, 6).alias("median"), "lo", "hi", F.round("z", 4).alias("z"), F.round(size, 2).alias("magnitude"),
        F.when(F.col("z").isNull(), "insufficient").when(F.abs("z") >= 3, "extreme").when(F.abs("z") >= 2, "unusual").otherwise("normal").alias("status"),
    )


def local_walls(strikes: DataFrame, top: int = 3) -> DataFrame:
    """Strikes whose size is no less than both neighbours' and more than one of them (a missing one counts): the largest ``top`` of each sign, those on their own side of spot first."""
    w = Window.partitionBy("symbol", "d").orderBy("strike")
    size = F.abs("net_c")
    x = strikes.filter("net_c <> 0").withColumn("size", size)
    x = x.withColumn("l", F.coalesce(F.lag("size").over(w), F.lit(-1))).withColumn("r", F.coalesce(F.lead("size").over(w), F.lit(-1)))
    peak = x.filter("size >= l and size >= r and (size > l or size > r)")
    side = F.when(F.col("net_c") > 0, "POSITIVE").otherwise("NEGATIVE")
    own = F.when(F.col("net_c") > 0, F.col("strike") >= F.col("spot")).otherwise(F.col("strike") <= F.col("spot"))
    peak = peak.withColumn("side", side).withColumn("own_side", own)
    rank = F.row_number().over(Window.partitionBy("symbol", "d", "side").orderBy(F.desc("own_side"), F.desc("size"), "strike"))
    return peak.withColumn("rank", rank).filter(F.col("rank") <= top).select("symbol", "d", "side", "rank", "strike", "own_side", "net_c")


def monthly_expiries(chain: DataFrame) -> DataFrame:
    """The last listed expiry of each month, by symbol."""
    return chain.groupBy("symbol", F.date_format("expiry", "yyyy-MM").alias("month")).agg(F.max("expiry").alias("expiry"))


def strike_universe(days: DataFrame, grid: int = 25, steps: int = 3) -> DataFrame:
    """The grid strikes around spot, rounded half-even to the grid."""
    centre = (F.bround(F.col("spot").cast("decimal(20,6)") / F.lit(grid).cast("decimal(10,0)"), 0) * grid).cast("long")
    return days.select("symbol", "d", F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("step"), centre.alias("centre")).select("symbol", "d", "step", (F.col("centre") + F.col("step") * grid).alias("strike"))


def ring(rows: DataFrame, keep: int, order: str, *by: str) -> DataFrame:
    """The latest ``keep`` rows of each group, as a first-in first-out buffer holds them."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("age", r - 1).filter(F.col("age") < keep)


def sweep(chain: DataFrame, points: int = 51, width: float = 0.3, rate: float = 0.065) -> DataFrame:
    """symbol, d, i, at, net: net model exposure at spots around its own, each option with its expiry's time and its own volatility."""
    legs = chain.filter("option_type in ('CE', 'PE') and oi > 0 and iv_bp > 0 and expiry > d").groupBy("symbol", "d", "spot", "expiry", "strike", "iv_bp").agg(F.sum(F.when(F.col("option_type") == "CE", F.col("oi")).otherwise(-F.col("oi"))).alias("oi"))
    x = legs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("spot") * (1 - width + 2 * width * F.col("i") / (points - 1)))
    t, sigma = F.datediff("expiry", "d") / F.lit(365.0), F.col("iv_bp") / 10000.0
    d1 = (F.ln(F.col("at") / F.col("strike")) + (rate + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    gamma = normal_pdf(d1) / (F.col("at") * sigma * F.sqrt(t))
    return x.groupBy("symbol", "d", "spot", "i", "at").agg(F.sum(gamma * F.col("oi") * F.col("at") * F.col("at") * 0.01).alias("net"))


def primary_flip(swept: DataFrame) -> DataFrame:
    """Where a sweep changes sign: the crossings and the one that scores best by nearness (0.5), strength (0.3) and steepness (0.2); ties go to the lower."""
    w = Window.partitionBy("symbol", "d").orderBy("i")
    x = swept.withColumn("a2", F.lead("at").over(w)).withColumn("n2", F.lead("net").over(w)).withColumn("most", F.max(F.abs("net")).over(Window.partitionBy("symbol", "d")))
    x = x.filter(F.col("net") * F.col("n2") < 0)
    level = F.col("at") + (F.col("a2") - F.col("at")) * F.col("net") / (F.col("net") - F.col("n2"))
    near = F.greatest(1 - F.abs(F.col("level") - F.col("spot")) / (F.col("spot") * 0.3), F.lit(0.0))
    strength = F.least(F.abs(F.col("net") - F.col("n2")) / F.col("most"), F.lit(1.0))
    quality = 1 - F.abs(F.abs("net") - F.abs("n2")) / (F.abs("net") + F.abs("n2"))
    x = x.withColumn("level", level).withColumn("score", F.round(0.5 * near + 0.3 * strength + 0.2 * quality, 6))
    best = F.min(F.struct((-F.col("score")).alias("s"), "level"))
    return x.groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("crossings"), best.alias("b")).select("symbol", "d", "crossings", F.round("b.level", 4).alias("flip"), (-F.col("b.s")).alias("score"))
