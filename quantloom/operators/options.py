"""Chain metrics, payoff and scenario algebra, strike and expiry resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import greeks, normal_pdf


def put_call_ratio(chain: DataFrame) -> DataFrame:
    side = lambda t: F.sum(F.when(F.col("option_type") == t, F.coalesce("oi", F.lit(0))).otherwise(0))
    return chain.groupBy("symbol", "d").agg(side("CE").alias("call_oi"), side("PE").alias("put_oi")).withColumn("pcr", F.round(F.try_divide(F.col("put_oi").cast("double"), F.nullif(F.col("call_oi"), F.lit(0))), 6))


def max_pain(chain: DataFrame) -> DataFrame:
    """The strike at which the options of a day pay least; ties go to the lower one.

    Strikes of a day meet as prefix sums over the sorted strikes, not as pairs.
    """
    t = chain.filter("option_type in ('CE', 'PE')").groupBy("symbol", "d", "strike").agg(*(F.sum(F.when(F.col("option_type") == k, F.col("oi")).otherwise(0)).alias(k) for k in ("CE", "PE")))
    below = Window.partitionBy("symbol", "d").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("symbol", "d").orderBy("strike").rowsBetween(0, Window.unboundedFollowing)
    k = F.col("strike")
    pain = k * F.sum("CE").over(below) - F.sum(F.col("CE") * k).over(below) + F.sum(F.col("PE") * k).over(above) - k * F.sum("PE").over(above)
    return t.withColumn("pain", pain).groupBy("symbol", "d").agg(F.min(F.struct("pain", "strike")).alias("m")).select("symbol", "d", F.col("m.strike").alias("max_pain"), F.col("m.pain").alias("pain"))


def oi_quadrants(daily_oi: DataFrame) -> DataFrame:
    """Price and open-interest direction against the day before."""
    w = Window.partitionBy("symbol").orderBy("d")
    p, o = F.col("spot") - F.lag("spot").over(w), F.col("oi") - F.lag("oi").over(w)
    label = F.when((p > 0) & (o > 0), "LONG_BUILDUP").when((p < 0) & (o > 0), "SHORT_BUILDUP").when((p > 0) & (o < 0), "SHORT_COVERING").when((p < 0) & (o < 0), "LONG_UNWINDING").otherwise("NEUTRAL")
    return daily_oi.select("symbol", "d", label.alias("quadrant"))


def oi_status(chain: DataFrame) -> DataFrame:
    label = F.when(F.col("oi").isNull(), "NULL").when(F.col("oi") == 0, "ZERO").when(F.col("oi") < 0, "NEGATIVE").otherwise("OK")
    return chain.groupBy("option_type", label.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("strike").alias("strikes"))


def call_put_pairs(chain: DataFrame) -> DataFrame:
    """Strikes of a day and expiry with both sides: one grouping instead of a self-join."""
    n = lambda t: F.count_if(F.col("option_type") == t)
    return chain.groupBy("symbol", "d", "expiry", "strike").agg(n("CE").alias("calls"), n("PE").alias("puts")).filter("calls > 0 and puts > 0")


def pnl(legs: Column, price: Column) -> Column:
    """Result at expiry of legs (type, action, strike, qty, premium)."""
    inner = lambda x: F.greatest(F.when(x["type"] == "CE", price - x["strike"]).otherwise(x["strike"] - price), F.lit(0.0))
    return F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + F.when(x["action"] == "buy", 1.0).otherwise(-1.0) * (inner(x) - x["premium"]) * x["qty"])


def payoff_curve(strategies: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """Result of each strategy (name, legs) on a price grid."""
    grid = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step)))
    return strategies.select("name", "legs", grid.alias("price")).select("name", "price", F.round(pnl(F.col("legs"), F.col("price").cast("double")), 6).alias("pnl"))


def breakevens(curve: DataFrame) -> DataFrame:
    """Prices where a curve crosses 0, interpolated."""
    w = Window.partitionBy("name").orderBy("price")
    x = curve.withColumn("p2", F.lead("price").over(w)).withColumn("v2", F.lead("pnl").over(w))
    crosses = x.filter((F.col("pnl") * F.col("v2") < 0) | ((F.col("pnl") == 0) & F.col("v2").isNotNull() & (F.col("v2") != 0)))
    return crosses.select("name", F.round(F.col("price") + (F.col("p2") - F.col("price")) * F.try_divide(-F.col("pnl"), F.col("v2") - F.col("pnl")), 4).alias("breakeven"))


def spot_sweep(chain: DataFrame, points: int = 21, width: float = 0.3, t: float = 30 / 365, sigma: float = 0.2) -> DataFrame:
    """Net model exposure of a day's chain at spots around its own."""
    c = chain.filter("option_type in ('CE', 'PE') and oi > 0").groupBy("symbol", "d", "spot", "strike").agg(F.sum(F.when(F.col("option_type") == "CE", F.col("oi")).otherwise(-F.col("oi"))).alias("oi"))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    x = c.select("symbol", "d", "spot", "strike", "oi", i).withColumn("at", F.col("spot") * (1 - width + 2 * width * F.col("i") / (points - 1)))
    d1 = (F.ln(F.col("at") / F.col("strike")) + (0.065 + sigma * sigma / 2) * t) / (sigma * t**0.5)
    gamma = normal_pdf(d1) / (F.col("at") * sigma * t**0.5)
    return x.groupBy("symbol", "d", "i").agg(F.round(F.sum(gamma * F.col("oi") * F.col("at") * F.col("at") * 0.01), 2).alias("net_gex"))


def scenario_matrix(legs: DataFrame, spot: float, spots: tuple[float, ...], vols: tuple[float, ...], t: float) -> DataFrame:
    """Value of a book (type, action, strike, qty) for shifted spot and volatility."""
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("shift"), F.lit(v).alias("vol")) for a in spots for v in vols))).alias("g")
    x = legs.select("*", grid).select("*", "g.shift", "g.vol")
    price = greeks(F.col("type"), spot * (1 + F.col("shift")), F.col("strike"), F.lit(t), F.col("vol"))["price"]
    return x.groupBy("shift", "vol").agg(F.round(F.sum(F.when(F.col("action") == "buy", 1.0).otherwise(-1.0) * F.col("qty") * price), 4).alias("value"))


def at_the_money(chain: DataFrame, steps: int = 2) -> DataFrame:
    """The listed strike nearest to spot (ties: lower), and the strikes some steps away, clamped."""
    t = chain.groupBy("symbol", "d", "spot").agg(F.array_sort(F.collect_set("strike")).alias("all"), F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("far"), "strike")).alias("m"))
    at = F.array_position("all", F.col("m.strike"))
    return t.select("symbol", "d", F.col("m.strike").alias("atm"), *(F.element_at("all", F.least(F.greatest(at + k, F.lit(1)), F.size("all").cast("long")).cast("int")).alias(n) for n, k in (("below", -steps), ("above", steps))))


def expiries(chain: DataFrame) -> DataFrame:
    """By day: the first and second expiry from it on, and the last one of its month."""
    e = chain.select("symbol", "d", "expiry").distinct()
    w = Window.partitionBy("symbol", "d").orderBy("expiry")
    x = e.filter("expiry >= d").withColumn("n", F.row_number().over(w)).groupBy("symbol", "d").agg(*(F.max(F.when(F.col("n") == k, F.col("expiry"))).alias(c) for k, c in ((1, "current_week"), (2, "next_week"))))
    monthly = e.select(F.date_trunc("month", "expiry").alias("m"), "expiry").groupBy("m").agg(F.max("expiry").alias("monthly"))
    return x.join(monthly, F.date_trunc("month", x["d"]) == monthly["m"], "left").select("symbol", "d", "current_week", "next_week", "monthly")
