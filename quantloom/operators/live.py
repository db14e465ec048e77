"""Live chains: broker payloads into chain rows, exposure with availability, and Greeks of stored bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing, rules
from . import bars as B

_MARKET = "market_data: STRUCT<ltp: DOUBLE, oi: STRING, prev_oi: DOUBLE, volume: DOUBLE, last_trade_time: STRING, last_update_time: STRING>"
_GREEKS = "option_greeks: STRUCT<iv: DOUBLE, delta: DOUBLE, theta: DOUBLE, gamma: STRING, vega: DOUBLE, pop: DOUBLE>"
PAYLOAD = f"data ARRAY<STRUCT<strike_price: DOUBLE, underlying_spot_price: DOUBLE, call_options: STRUCT<{_MARKET}, {_GREEKS}>, put_options: STRUCT<{_MARKET}, {_GREEKS}>>>"
#: What exposure is multiplied by.
FACTOR = 0.01


def _leg(side: Column) -> Column:
    market, greeks = side["market_data"], side["option_greeks"]
    oi = market["oi"].try_cast("double")
    given = lambda c: F.when(c != "", c)
    return F.struct(
        market["ltp"].alias("ltp"), market["oi"].alias("oi"), (oi - market["prev_oi"]).alias("chg_oi"), market["volume"].alias("volume"),
        F.coalesce(given(market["last_trade_time"]), given(market["last_update_time"])).alias("quote_time"),
        *(greeks[c].alias(c) for c in ("iv", "delta", "theta", "gamma", "vega", "pop")),
    )


def canonical_chain(payloads: DataFrame, json_col: str = "raw") -> DataFrame:
    """symbol, expiry, captured_at, spot and ``chain``: an array of strike, call and put, in order of strike.

    Spot is the first that any strike gives. Open interest and gamma stay as they were sent, so that
    what is missing and what is no number can be told apart; a payload that is no JSON has a null chain.
    """
    item = F.from_json(json_col, PAYLOAD)["data"]
    x = payloads.withColumn("items", item)
    rows = F.transform("items", lambda i: F.struct(i["strike_price"].alias("strike"), _leg(i["call_options"]).alias("call"), _leg(i["put_options"]).alias("put")))
    spots = F.filter(F.transform("items", lambda i: i["underlying_spot_price"]), lambda s: s.isNotNull())
    return x.select("symbol", "expiry", "captured_at", F.get(spots, F.lit(0)).alias("spot"), F.array_sort(rows, lambda a, b: F.when(a["strike"] < b["strike"], -1).when(a["strike"] > b["strike"], 1).otherwise(0)).alias("chain"))


def chain_rows(chains: DataFrame) -> DataFrame:
    """A row a strike and side that was sent, with its change in open interest and quote time."""
    x = chains.select("symbol", "expiry", "spot", F.explode("chain").alias("r")).select("symbol", "expiry", "spot", "r.strike", F.explode(F.array(F.struct(F.lit("CE").alias("type"), F.col("r.call").alias("leg")), F.struct(F.lit("PE").alias("type"), F.col("r.put").alias("leg")))).alias("s"))
    return x.select("symbol", "expiry", "spot", "strike", "s.type", "s.leg.*").filter("oi is not null or ltp is not null or quote_time is not null")


def _positive(c: Column) -> Column:
    """The number if it is finite and above 0."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (n < float("inf")) & (n > 0), n)


def side_reason(gamma: Column, oi: Column) -> Column:
    """Why a side has no exposure; null if it has."""
    g, o = gamma.try_cast("double"), oi.try_cast("double")
    bad_gamma = F.when(gamma.isNull(), "MISSING_GAMMA").when(g.isNull() | F.isnan(g) | (F.abs(g) == float("inf")), "INVALID_GAMMA").when(g < 0, "NEGATIVE_GAMMA").otherwise("INVALID_GAMMA")
    bad_oi = F.when(oi.isNull(), "MISSING_OI").when(o == 0, "ZERO_OI").otherwise("INVALID_OI")
    return F.when(_positive(gamma).isNull(), bad_gamma).when(_positive(oi).isNull(), bad_oi)


def _strike(r: Column, spot: Column) -> Column:
    call, put = (side_reason(r[s]["gamma"], r[s]["oi"]) for s in ("call", "put"))
    raw = lambda s: _positive(r[s]["gamma"]) * _positive(r[s]["oi"]) * spot * spot
    wrong = lambda e: e.isin("INVALID_GAMMA", "NEGATIVE_GAMMA")
    status = (
        F.when(call.isNull() & put.isNull(), "available").when(call.isNull() | put.isNull(), "partial")
        .when(wrong(call) | wrong(put), "invalid").otherwise("unavailable")
    )
    return F.struct(
        r["strike"].alias("strike"), F.when(call.isNull(), raw("call")).alias("call"), F.when(put.isNull(), -raw("put")).alias("put"), call.alias("call_reason"), put.alias("put_reason"), status.alias("status"),
    )


def _instant(text: Column) -> Column:
    """Milliseconds of an ISO time, in UTC where it names no offset; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(F.when(text.rlike(r"[+-]\d\d:?\d\d$|Z$"), text).otherwise(F.concat(text, F.lit("Z")))))


def _exposures(chains: DataFrame) -> DataFrame:
    x = chains.withColumn("good_spot", _positive(F.col("spot")))
    none = F.expr("filter(array(named_struct('strike', 0D, 'call', 0D, 'put', 0D, 'call_reason', '', 'put_reason', '', 'status', '')), s -> false)")
    return x.withColumn("strikes", F.when(F.col("good_spot").isNull() | F.col("chain").isNull(), none).otherwise(F.transform("chain", lambda r: _strike(r, F.col("good_spot")))))


def strike_exposure(chains: DataFrame) -> DataFrame:
    """A row a strike: exposure of either side, net if both have one, and why not; none for a chain without a valid spot."""
    x = _exposures(chains).select("symbol", "expiry", F.explode("strikes").alias("s")).select("symbol", "expiry", "s.*")
    money = lambda c: c * FACTOR
    return x.select("symbol", "expiry", "strike", money(F.col("call")).alias("call_gex"), money(F.col("put")).alias("put_gex"), money(F.col("call") + F.col("put")).alias("net_gex"), "call_reason", "put_reason", "status")


def chain_exposure(chains: DataFrame) -> DataFrame:
    """A row a chain: totals of the sides, net if both have any, availability, counts, and the age of its oldest quote.

    Available: every strike is; partial: some strike is, or is in part; else invalid if some strike is.
    """
    total = lambda side: F.aggregate(F.filter(F.transform("strikes", lambda s: s[side]), lambda v: v.isNotNull()), F.lit(None).cast("double"), lambda a, v: F.coalesce(a, F.lit(0.0)) + v)
    having = lambda status: F.size(F.filter("strikes", lambda s: s["status"] == status))
    quotes = F.array_min(F.flatten(F.transform("chain", lambda r: F.array(_instant(r["call"]["quote_time"]), _instant(r["put"]["quote_time"])))))
    x = _exposures(chains).withColumns({"call": total("call"), "put": total("put"), "available": having("available"), "some": having("partial"), "wrong": having("invalid"), "all": F.size("strikes"), "oldest": quotes})
    status = F.when((F.col("available") == F.col("all")) & (F.col("available") > 0), "available").when(F.col("available") + F.col("some") > 0, "partial").when(F.col("wrong") > 0, "invalid").otherwise("unavailable")
    age = F.when((F.col("all") > 0) & F.col("oldest").isNotNull(), F.greatest(F.unix_millis(F.col("captured_at").cast("timestamp")) - F.col("oldest"), F.lit(0)))
    return x.select(
        "symbol", "expiry", "spot", (F.col("call") * FACTOR).alias("call_gex"), (F.col("put") * FACTOR).alias("put_gex"), ((F.col("call") + F.col("put")) * FACTOR).alias("net_gex"),
        status.alias("status"), (F.col("available") + F.col("some")).alias("valid_strikes"), F.col("all").alias("strikes"), age.alias("age_ms"),
    )


def bar_greeks(option_bars: DataFrame, known: DataFrame, index: DataFrame, r: float = 0.065) -> DataFrame:
    """Volatility and Greeks of stored option bars (instrument, open_time, price), with a status for each.

    Spot is the last index close above 0 of the same day, at or before the bar. Bars of no known contract
    are left out. Status: INSUFFICIENT_DATA (no spot, shown as 0), INVALID_PRICE (not above 0), NO_IV (with
    the solver's reason), NUMERICAL_ERROR, or SUCCESS; at expiry the delta is a step and there is no volatility.
    """
    x = option_bars.join(known, "instrument").withColumn("day", F.to_date("open_time"))
    spots = index.filter("close > 0").select("symbol", F.to_date("open_time").alias("day"), F.col("open_time").alias("at"), "close")
    x = B.as_of(x, spots, ["symbol", "day"], "open_time", "at", ["close"]).withColumn("t", rules.years_to_expiry(F.col("open_time"), F.col("expiry")))
    kind, s, k, t, price = F.col("option_type"), F.col("asof_close"), F.col("strike").cast("double"), F.col("t"), F.col("price")
    x = x.withColumn("solved", pricing.implied_vol(kind, s, k, t, price, r))
    live = s.isNotNull() & (price > 0) & (t > 0)
    g = pricing.greeks(kind, s, k, t, F.col("iv"), r)
    x = x.withColumn("iv", F.when(live, F.col("solved.iv"))).withColumns({n: g[n] for n in ("delta", "gamma", "vega", "theta")})
    expired = (price > 0) & (t <= 0)
    step = F.when(kind == "CE", F.when(s > k, 1.0).otherwise(0.0)).otherwise(F.when(s < k, -1.0).otherwise(0.0))
    broken = F.lit(False)
    for n in ("delta", "gamma", "vega", "theta"):
        broken = broken | F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    status = F.when(s.isNull(), "INSUFFICIENT_DATA").when(price <= 0, "INVALID_PRICE").when(expired, "SUCCESS").when(F.col("iv").isNull(), "NO_IV").when(broken, "NUMERICAL_ERROR").otherwise("SUCCESS")
    error = F.when(s.isNull(), "NO_SPOT").when(price <= 0, "ZERO_PRICE").when(expired, None).when(F.col("iv").isNull(), F.col("solved.status")).when(broken, "GREEK_CALC_FAILED")
    done = (F.col("status") == "SUCCESS") & ~expired
    of = lambda n, at_expiry: F.when(s.isNotNull() & expired, at_expiry).when(done, F.col(n)).alias(n)
    x = x.withColumn("status", status).withColumn("error", error)
    return x.select(
        "instrument", "open_time", "option_type", "strike", "expiry", F.coalesce(s, F.lit(0.0)).alias("spot"), "price", "lot_size", "t", F.when(s.isNotNull(), pricing.intrinsic(kind, s, k)).alias("intrinsic"),
        F.when(F.col("status").isin("SUCCESS", "NUMERICAL_ERROR"), F.col("iv")).alias("iv"), of("delta", step), of("gamma", F.lit(0.0)), of("vega", F.lit(0.0)), of("theta", F.lit(0.0)), "status", "error",
    )
