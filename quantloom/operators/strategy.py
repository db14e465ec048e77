"""Strategy legs: strike and expiry resolution against listed chains, prices, changes, payoff metrics.

The strikes and expiries listed for one symbol and time, and the legs of one strategy, are arrays:
an exchange and a strategy bound their length. Everything else is a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import greeks


def listed(chain: DataFrame) -> DataFrame:
    """symbol, d, spot, strikes, expiries: what is listed at each time."""
    return chain.filter("option_type in ('CE', 'PE')").groupBy("symbol", "d", "spot").agg(F.array_sort(F.collect_set("strike")).alias("strikes"), F.array_sort(F.collect_set("expiry")).alias("expiries"))


def nearest(strikes: Column, target: Column) -> Column:
    """The listed strike nearest to a target; of two the lower."""
    return F.array_min(F.transform(strikes, lambda k: F.struct(F.abs(k - target).alias("far"), k.alias("k"))))["k"]


def model_delta(spot: Column, strike: Column) -> Column:
    """A linear stand-in for a quoted call delta, in thousandths."""
    return 500 + spot - strike


def resolve_strike(mode: Column, value: Column, spot: Column, strikes: Column, delta: Column | None = None) -> Column:
    """struct<strike, error, warning> of a strike formula.

    Modes: fixed, atm, atm_offset_steps, atm_offset, spot_offset, delta (thousandths; off by more than
    200 is an error, by more than 100 a warning; ties go to the strike nearer to the money).
    """
    done = lambda k, warning: F.struct(k.alias("strike"), F.lit(None).cast("string").alias("error"), warning.alias("warning"))
    failed = lambda error: F.struct(F.lit(None).cast("long").alias("strike"), F.lit(error).alias("error"), F.lit(None).cast("string").alias("warning"))
    none = F.lit(None).cast("string")
    atm = nearest(strikes, spot)
    at = F.array_position(strikes, atm) + value
    inside = F.greatest(F.least(at, F.size(strikes).cast("long")), F.lit(1).cast("long"))
    shifted = lambda target: done(nearest(strikes, target), F.when(~F.array_contains(strikes, target), "NORMALISED"))
    best = F.array_min(F.transform(strikes, lambda k: F.struct(F.abs(model_delta(spot, k) - value).alias("off"), F.abs(k - spot).alias("far"), k.alias("k")))) if delta is None else delta
    return (
        F.when(F.size(strikes) == 0, failed("NO_STRIKES"))
        .when(mode == "fixed", F.when(F.array_contains(strikes, value), done(value, none)).otherwise(failed("STRIKE_UNAVAILABLE")))
        .when(mode == "atm", done(atm, none))
        .when(mode == "atm_offset_steps", done(F.element_at(strikes, inside.cast("int")), F.when(at != inside, "CLAMPED")))
        .when(mode == "atm_offset", shifted(atm + value))
        .when(mode == "spot_offset", shifted(spot + value))
        .when(mode == "delta", F.when(best["off"] > 200, failed("DELTA_TOO_FAR")).otherwise(done(best["k"], F.when(best["off"] > 100, "DELTA_OFF"))))
        .otherwise(failed("UNKNOWN_MODE"))
    )


def resolve_expiry(mode: Column, today: Column, fixed: Column, expiries: Column, low: int, high: int) -> Column:
    """The expiry of a formula; null if there is none.

    fixed must be listed; current_week is the first from today on, else the nearest; next_week the
    second from today on; monthly the last of today's month (it may be past), else the last of the
    next listed month; dte_range the latest with so many days to go.
    """
    ahead = F.filter(expiries, lambda e: e >= today)
    closest = F.array_min(F.transform(expiries, lambda e: F.struct(F.abs(F.datediff(e, today)).alias("far"), e.alias("e"))))["e"]
    month = lambda e: F.trunc(e, "month")
    this = F.array_max(F.filter(expiries, lambda e: month(e) == month(today)))
    later = F.filter(expiries, lambda e: month(e) > month(today))
    following = F.array_max(F.filter(later, lambda e: month(e) == month(F.array_min(later))))
    return (
        F.when(mode == "fixed", F.when(F.array_contains(expiries, fixed), fixed))
        .when(mode == "current_week", F.coalesce(F.get(ahead, F.lit(0)), closest))
        .when(mode == "next_week", F.get(ahead, F.lit(1)))
        .when(mode == "monthly", F.coalesce(this, following))
        .when(mode == "dte_range", F.array_max(F.filter(expiries, lambda e: F.datediff(e, today).between(low, high))))
    )


def resolve_legs(days: DataFrame, formulas: Sequence[tuple[int, str, int, str, str]], low: int = 5, high: int = 15) -> DataFrame:
    """One row for each time and leg formula (leg, strike mode, value, expiry mode, side), strike first."""
    table = F.array(*(F.struct(F.lit(a).alias("leg"), F.lit(m).alias("mode"), F.lit(v).cast("long").alias("value"), F.lit(e).alias("expiry_mode"), F.lit(s).alias("side")) for a, m, v, e, s in formulas))
    x = days.withColumn("f", F.explode(table)).select("*", "f.*")
    today = F.date_add("d", (10 * (F.dayofmonth("d") % 4)).cast("int"))
    x = x.withColumn("r", resolve_strike(F.col("mode"), F.col("value"), F.col("spot"), F.col("strikes"))).withColumn(
        "expiry", resolve_expiry(F.col("expiry_mode"), today, F.date_add("d", 14), F.col("expiries"), low, high)
    )
    status = F.when(F.col("r.error").isNotNull(), F.col("r.error")).when(F.col("expiry").isNull(), "EXPIRY_UNAVAILABLE").otherwise("RESOLVED")
    return x.select("symbol", "d", "leg", "side", F.col("r.strike").alias("strike"), "expiry", F.col("r.warning").alias("warning"), status.alias("status"))


def compare_resolutions(legs: DataFrame, step: int = 50) -> DataFrame:
    """What changed in each leg since the time before, and whether the strike moved a step or more."""
    w = Window.partitionBy("symbol", "leg").orderBy("d")
    x = legs.withColumn("k0", F.lag("strike").over(w)).withColumn("e0", F.lag("expiry").over(w))
    k, e = ~F.col("strike").eqNullSafe(F.col("k0")), ~F.col("expiry").eqNullSafe(F.col("e0"))
    change = F.when(k & e, "CHANGED_BOTH").when(k, "CHANGED_STRIKE").when(e, "CHANGED_EXPIRY").otherwise("UNCHANGED")
    return x.select("symbol", "d", "leg", change.alias("change"), (F.col("strike") - F.col("k0")).alias("strike_move"), F.coalesce(F.abs(F.col("strike") - F.col("k0")) >= step, F.lit(False)).alias("material"))


def chain_prices(legs: DataFrame, chain: DataFrame) -> DataFrame:
    """Each resolved leg with the lowest positive price of its option, or NO_PRICE."""
    prices = chain.filter("ltp > 0").groupBy("symbol", "d", "expiry", "strike", F.col("option_type").alias("side")).agg(F.min("ltp").alias("price"))
    x = legs.filter("status = 'RESOLVED'").join(prices, ["symbol", "d", "expiry", "strike", "side"], "left")
    return x.select("symbol", "d", "leg", "price", F.when(F.col("price").isNull(), "NO_PRICE").otherwise("PRICED").alias("status"))


def atm_straddle(chain: DataFrame) -> DataFrame:
    """symbol, d, expiry, strike, straddle: the option pair nearest to spot, if both sides have a price."""
    price = lambda t: F.min(F.when((F.col("option_type") == t) & (F.col("ltp") > 0), F.col("ltp")))
    x = chain.filter("option_type in ('CE', 'PE')").groupBy("symbol", "d", "spot", "expiry", "strike").agg(price("CE").alias("ce"), price("PE").alias("pe"))
    near = x.groupBy("symbol", "d").agg(F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("far"), "strike", "expiry", "ce", "pe")).alias("m")).select("symbol", "d", "m.*")
    return near.filter("ce is not null and pe is not null").select("symbol", "d", "expiry", "strike", (F.col("ce") + F.col("pe")).alias("straddle"))


def around_the_money(chain: DataFrame, steps: int = 2) -> DataFrame:
    """Listed strikes within some steps of the one nearest to spot, by symbol, time and expiry."""
    x = chain.filter("option_type in ('CE', 'PE')").groupBy("symbol", "d", "expiry", "spot").agg(F.array_sort(F.collect_set("strike")).alias("all"))
    at = F.array_position("all", nearest(F.col("all"), F.col("spot")))
    first = F.greatest(at - steps, F.lit(1).cast("long"))
    return x.select("symbol", "d", "expiry", F.posexplode(F.slice("all", first.cast("int"), (at + steps - first + 1).cast("int"))).alias("i", "strike"), first.alias("first"), at.alias("at")).select(
        "symbol", "d", "expiry", "strike", (F.col("i") + F.col("first") - F.col("at")).cast("long").alias("step")
    )


# payoff metrics, in cents


def pnl_c(legs: Column, price: Column) -> Column:
    inner = lambda x: F.greatest(F.when(x["type"] == "CE", price - x["strike"]).otherwise(x["strike"] - price), F.lit(0).cast("long"))
    sign = lambda x: F.when(x["action"] == "buy", 1).otherwise(-1)
    return F.aggregate(legs, F.lit(0).cast("long"), lambda acc, x: acc + sign(x) * (inner(x) * 100 - x["premium_c"]) * x["qty"])


def leg_payoffs(strategies: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """strategy_id, leg, price, pnl_c: the payoff of each leg on a price grid."""
    x = strategies.select("strategy_id", F.explode("legs").alias("x")).withColumn("price", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"), F.lit(step).cast("long"))))
    return x.select("strategy_id", F.col("x.leg").alias("leg"), "price", pnl_c(F.array("x"), F.col("price")).alias("pnl_c"))


def metrics(strategies: DataFrame) -> DataFrame:
    """Exact payoff metrics of strategies (strategy_id, legs) at expiry.

    The payoff is linear between the strikes, so its values at 0 and the strikes and the slope beyond
    the last give the extremes, the unbounded tails and the breakevens. A breakpoint at zero counts
    if the payoff is not zero on both sides of it.
    """
    sign = lambda x: F.when(x["action"] == "buy", 1).otherwise(-1)
    total = lambda f: F.aggregate("legs", F.lit(0).cast("long"), lambda acc, x: acc + f(x))
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.transform("legs", lambda x: x["strike"]))))
    x = strategies.select(
        "strategy_id", "legs", F.transform(points, lambda p: F.struct(p.alias("p"), pnl_c(F.col("legs"), p).alias("v"))).alias("at"),
        total(lambda x: F.when(x["type"] == "CE", sign(x) * x["qty"]).otherwise(0)).alias("slope"),
        total(lambda x: sign(x) * x["premium_c"] * x["qty"]).alias("net_c"), total(lambda x: F.when(x["action"] == "buy", x["premium_c"] * x["qty"]).otherwise(0)).alias("outlay_c"),
        (F.size(F.array_distinct(F.transform("legs", lambda x: x["far"]))) > 1).alias("mixed_expiry"),
    )
    last = F.element_at("at", -1)
    tail = F.struct((last["p"] + 1).alias("p"), (last["v"] + F.col("slope") * 100).alias("v"))
    # a point far enough on the tail stands for it
    pairs = F.zip_with(F.concat(F.array(F.struct(F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("v"))), "at"), F.concat("at", F.array(tail)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inner = F.transform(F.filter(F.slice(pairs, 2, F.size("at") - 1), lambda q: q["a"]["v"] * q["b"]["v"] < 0), lambda q: F.round(q["a"]["p"] + (q["b"]["p"] - q["a"]["p"]) * F.try_divide(-q["a"]["v"].cast("double"), (q["b"]["v"] - q["a"]["v"]).cast("double")), 4))
    exact = F.transform(
        F.filter(F.zip_with(pairs, F.slice(pairs, 2, F.size("at")), lambda q, r: F.struct(q["a"]["v"].alias("before"), r["a"]["p"].alias("p"), r["a"]["v"].alias("v"), r["b"]["v"].alias("after"))), lambda t: (t["v"] == 0) & ((F.coalesce(t["before"], F.lit(0).cast("long")) != 0) | (t["after"] != 0))),
        lambda t: t["p"].cast("double"),
    )
    beyond = F.when((last["v"] * F.col("slope")) < 0, F.array(F.round(last["p"] - last["v"] / (F.col("slope") * 100.0), 4))).otherwise(F.array().cast("array<double>"))
    high, low = F.array_max(F.transform("at", lambda a: a["v"])), F.array_min(F.transform("at", lambda a: a["v"]))
    x = x.withColumn("max_c", high).withColumn("min_c", low).withColumn("breakevens", F.array_sort(F.concat(inner, exact, beyond)))
    bounded = F.col("slope") == 0
    return x.select(
        "strategy_id", F.size("legs").cast("long").alias("legs"), "mixed_expiry", "net_c", "outlay_c", "max_c", "min_c", (F.col("slope") > 0).alias("unlimited_profit"), (F.col("slope") < 0).alias("unlimited_loss"), "breakevens",
        F.round(F.when(bounded & (F.col("min_c") < 0), F.try_divide(F.col("max_c").cast("double"), -F.col("min_c"))), 4).alias("reward_risk"),
        F.round(F.when((F.col("slope") <= 0) & (F.col("net_c") > 0), F.try_divide(F.col("max_c") * 100.0, F.col("net_c"))), 4).alias("roi_pct"),
        # a single bought leg ties up its premium, others their worst loss; an unlimited loss has no figure
        F.when(F.col("slope") < 0, F.lit(None).cast("long")).when((F.size("legs") == 1) & (F.col("outlay_c") > 0), F.col("outlay_c")).otherwise(F.greatest(-F.col("min_c"), F.lit(0))).alias("capital_c"),
    )


def validate_legs(strategies: DataFrame) -> DataFrame:
    """strategy_id, leg, problem: legs with an unknown side or action, or a number out of range."""
    x = strategies.select("strategy_id", F.inline("legs"))
    problem = (
        F.when(~F.col("type").isin("CE", "PE"), "TYPE").when(~F.col("action").isin("buy", "sell"), "ACTION").when(F.col("qty").isNull() | (F.col("qty") <= 0), "QUANTITY")
        .when(F.col("strike").isNull() | (F.col("strike") <= 0), "STRIKE").when(F.col("premium_c").isNull() | (F.col("premium_c") < 0), "PRICE")
    )
    return x.withColumn("problem", problem).filter("problem is not null").select("strategy_id", "leg", "problem")


def strikes_by_delta(chain: DataFrame, targets: Sequence[tuple[str, int]], warn: int = 100, fail: int = 200) -> DataFrame:
    """symbol, d, expiry, side, target, strike, delta, status: the listed option whose quoted delta is nearest to each target, in thousandths.

    A quote's delta is that of its mean volatility. Ties go to the strike nearer to spot, then the lower.
    RESOLVED, DELTA_OFF (more than ``warn`` away), or DELTA_TOO_FAR (more than ``fail``; no strike).
    """
    q = chain.filter("option_type in ('CE', 'PE') and iv_bp > 0 and expiry > d").groupBy("symbol", "d", "expiry", "strike", "option_type", "spot").agg((F.avg("iv_bp") / 10_000).alias("sigma"))
    delta = greeks(F.col("option_type"), F.col("spot").cast("double"), F.col("strike").cast("double"), F.datediff("expiry", "d") / 365.0, F.col("sigma"))["delta"]
    q = q.withColumn("delta", F.round(delta * 1000).cast("long"))
    asked = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(v).alias("target")) for s, v in targets))
    x = q.withColumn("t", F.explode(F.filter(asked, lambda t: t["side"] == F.col("option_type"))))
    best = F.min(F.struct(F.abs(F.col("delta") - F.col("t.target")).alias("off"), F.abs(F.col("strike") - F.col("spot")).alias("far"), "strike", "delta"))
    g = x.groupBy("symbol", "d", "expiry", F.col("t.side").alias("side"), F.col("t.target").alias("target")).agg(best.alias("b"))
    near = F.col("b.off") <= fail
    status = F.when(~near, "DELTA_TOO_FAR").when(F.col("b.off") > warn, "DELTA_OFF").otherwise("RESOLVED")
    return g.select("symbol", "d", "expiry", "side", "target", F.when(near, F.col("b.strike")).alias("strike"), F.when(near, F.col("b.delta")).alias("delta"), status.alias("status"))
