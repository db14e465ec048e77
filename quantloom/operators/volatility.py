"""Implied-volatility analytics of chains: at the money, curve, skew, term structure, rank, relations.

Volatility comes as ``iv_bp``, whole 1/10,000. Windows run over one row a time of one symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def curve(chain: DataFrame) -> DataFrame:
    """By symbol, time, expiry and strike: both sides' volatility, distance to spot and moneyness in per cent."""
    iv = lambda t: F.max(F.when((F.col("option_type") == t) & (F.col("iv_bp") > 0), F.col("iv_bp")))
    x = chain.filter("option_type in ('CE', 'PE')").groupBy("symbol", "d", "expiry", "spot", "strike").agg(iv("CE").alias("call_iv"), iv("PE").alias("put_iv"))
    gap = F.col("strike") - F.col("spot")
    return x.withColumn("distance", gap).withColumn("moneyness_pct", F.round(F.try_divide(gap * 100.0, F.col("spot")), 6))


def at_the_money(curve: DataFrame) -> DataFrame:
    """By symbol, time and expiry: the strike nearest to spot and its volatility; the mean only if both sides have one."""
    m = F.min(F.struct(F.abs("distance").alias("far"), "strike", "call_iv", "put_iv")).alias("m")
    x = curve.groupBy("symbol", "d", "expiry").agg(m).select("symbol", "d", "expiry", F.col("m.strike").alias("strike"), "m.call_iv", "m.put_iv")
    both, one = F.col("call_iv").isNotNull() & F.col("put_iv").isNotNull(), F.coalesce("call_iv", "put_iv").isNotNull()
    return x.withColumn("atm_iv", F.when(both, (F.col("call_iv") + F.col("put_iv")) / 2.0)).withColumn("status", F.when(both, "available").when(one, "partial").otherwise("unavailable"))


def skew(curve: DataFrame, atm: DataFrame, offset_pct: float = 2.0) -> DataFrame:
    """Volatility points of calls at ``offset_pct`` and puts at minus that, against the money; null without it."""
    near = lambda target: F.min(F.struct(F.abs(F.col("moneyness_pct") - target).alias("off"), "strike", "call_iv", "put_iv"))
    x = curve.groupBy("symbol", "d", "expiry").agg(near(offset_pct).alias("up"), near(-offset_pct).alias("down"))
    points = lambda c: F.round((F.col(c) - F.col("atm_iv")) / 100.0, 4)
    return x.join(atm.select("symbol", "d", "expiry", "atm_iv"), ["symbol", "d", "expiry"]).select(
        "symbol", "d", "expiry", F.col("up.strike").alias("call_strike"), F.col("down.strike").alias("put_strike"), points("up.call_iv").alias("call_skew"), points("down.put_iv").alias("put_skew")
    )


def term_structure(atm: DataFrame) -> DataFrame:
    """Available volatility at the money by days to expiry, with the slope to the next one (points a day)."""
    w = Window.partitionBy("symbol", "d").orderBy("dte")
    x = atm.filter("status = 'available'").withColumn("dte", F.datediff("expiry", "d")).withColumn("next_iv", F.lead("atm_iv").over(w)).withColumn("next_dte", F.lead("dte").over(w))
    return x.select("symbol", "d", "dte", "atm_iv", F.round(F.try_divide(F.col("next_iv") - F.col("atm_iv"), (F.col("next_dte") - F.col("dte")) * 100.0), 6).alias("slope"))


def front(atm: DataFrame) -> DataFrame:
    """symbol, d, iv: the available volatility of the first expiry at each time."""
    return atm.filter("status = 'available'").groupBy("symbol", "d").agg(F.min_by("atm_iv", "expiry").alias("iv"))


def _share(values: Column, keep) -> Column:
    return F.size(F.filter(values, keep)).cast("double") / F.size(values)


def rank(front: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """Share of the trailing values that are at most (rank) and below (percentile) the current one."""
    w = Window.partitionBy("symbol").orderBy("d").rowsBetween(1 - window, 0)
    x = front.withColumn("seen", F.collect_list("iv").over(w))
    ok = F.size("seen") >= least
    return x.select(
        "symbol", "d", "iv", F.when(ok, F.round(_share(F.col("seen"), lambda v: v <= F.col("iv")), 6)).alias("iv_rank"),
        F.when(ok, F.round(_share(F.col("seen"), lambda v: v < F.col("iv")) * 100, 6)).alias("iv_percentile"),
    )


def changes(front: DataFrame) -> DataFrame:
    """Change of volatility: absolute, in points and in per cent of the one before."""
    before = F.lag("iv").over(Window.partitionBy("symbol").orderBy("d"))
    x = front.withColumn("before", before).withColumn("change", F.col("iv") - F.col("before"))
    return x.select("symbol", "d", F.round(F.col("change") / 10000.0, 8).alias("change"), F.round(F.col("change") / 100.0, 6).alias("vol_points"), F.round(F.try_divide(F.col("change") * 100.0, F.col("before")), 6).alias("change_pct"))


def correlation(pairs: DataFrame, a: str, b: str, *by: str, least: int = 3) -> DataFrame:
    """Pearson correlation of the finite pairs of each group; null below ``least`` pairs or without variance."""
    x = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    r = F.when((F.count(F.lit(1)) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(r, 6).alias("r"))


# decomposition of the change of exposure between two snapshots


def snapshots(chain: DataFrame) -> DataFrame:
    """By symbol, time and strike: gamma (hundredths), open interest and volatility of both sides."""
    of = lambda f, t, c: f(F.when(F.col("option_type") == t, F.col(c)))
    return chain.filter("option_type in ('CE', 'PE') and oi > 0").groupBy("symbol", "d", "spot", "strike").agg(
        of(F.max, "CE", "gamma_c").alias("call_gamma"), of(F.max, "PE", "gamma_c").alias("put_gamma"), F.coalesce(of(F.sum, "CE", "oi"), F.lit(0)).alias("call_oi"), F.coalesce(of(F.sum, "PE", "oi"), F.lit(0)).alias("put_oi"),
        of(F.max, "CE", "iv_bp").alias("call_iv"), of(F.max, "PE", "iv_bp").alias("put_iv"),
    )


def _model_gamma(spot: Column, strike: Column, iv_bp: Column, t: float) -> Column:
    sigma = iv_bp / 10000.0
    d1 = (F.ln(spot / strike) + sigma * sigma / 2 * t) / (sigma * t**0.5)
    return F.exp(-d1 * d1 / 2) / (2 * 3.141592653589793) ** 0.5 / (spot * sigma * t**0.5)


def decompose(snapshots: DataFrame, t: float = 1 / 52) -> DataFrame:
    """Change of net exposure since the snapshot before: by spot, open interest, volatility, and the rest.

    The parts look at strikes that both snapshots have: spot with gamma and open interest held; open
    interest with model gamma held; volatility as the model gamma's change at the new open interest.
    """
    order = Window.partitionBy("symbol").orderBy("d")
    raw = lambda g, o: F.coalesce(F.col(g) * F.col(o), F.lit(0))
    net = F.sum((raw("call_gamma", "call_oi") - raw("put_gamma", "put_oi")) * F.col("spot") * F.col("spot"))
    times = snapshots.groupBy("symbol", "d", "spot").agg(net.alias("net_c")).withColumn("i", F.row_number().over(order)).withColumn("spot0", F.lag("spot").over(order)).withColumn("net0", F.lag("net_c").over(order))
    x = snapshots.drop("spot").join(times, ["symbol", "d"])
    w = Window.partitionBy("symbol", "strike").orderBy("d")
    was = lambda c: F.when(F.lag("i").over(w) == F.col("i") - 1, F.lag(c).over(w))
    x = x.select("*", *(was(c).alias(f"{c}0") for c in ("call_gamma", "put_gamma", "call_oi", "put_oi", "call_iv", "put_iv")))
    s0, k = F.col("spot0").cast("double"), F.col("strike").cast("double")
    spot_c = (raw("call_gamma0", "call_oi0") - raw("put_gamma0", "put_oi0")) * (F.col("spot") * F.col("spot") - F.col("spot0") * F.col("spot0"))

    def parts(side: str) -> tuple[Column, Column]:
        old, new = _model_gamma(s0, k, F.col(f"{side}_iv0"), t), _model_gamma(s0, k, F.col(f"{side}_iv"), t)
        unit = s0 * s0 * 0.01
        return F.coalesce((F.col(f"{side}_oi") - F.col(f"{side}_oi0")) * old * unit, F.lit(0.0)), F.coalesce(F.col(f"{side}_oi") * (new - old) * unit, F.lit(0.0))

    (call_oi, call_iv), (put_oi, put_iv) = parts("call"), parts("put")
    total = x.groupBy("symbol", "d", "net_c", "net0").agg(F.sum(spot_c).alias("spot_c"), F.sum(call_oi - put_oi).alias("by_oi"), F.sum(call_iv - put_iv).alias("by_iv")).filter("net0 is not null")
    total = total.withColumn("total", (F.col("net_c") - F.col("net0")) * 1e-4).withColumn("by_spot", F.coalesce(F.col("spot_c") * 1e-4, F.lit(0.0)))
    total = total.withColumn("residual", F.col("total") - F.col("by_spot") - F.col("by_oi") - F.col("by_iv"))
    return total.select("symbol", "d", *(F.round(c, 4).alias(c) for c in ("total", "by_spot", "by_oi", "by_iv", "residual")), F.round(F.try_divide(F.col("by_spot") * 100, F.abs("total")), 2).alias("spot_pct"))
