"""Operators on literal rows."""

from datetime import date, datetime

from pyspark.sql import functions as F

from quantloom.functions import rules
from quantloom.operators import landing, ledger, portfolio, quality, reports, strategy

LEG = "struct<leg:bigint,type:string,action:string,strike:bigint,qty:bigint,premium_c:bigint,far:boolean>"


def _metrics(spark, legs):
    rows = [(1, [(i, *leg, False) for i, leg in enumerate(legs)])]
    return strategy.metrics(spark.createDataFrame(rows, f"strategy_id long, legs array<{LEG}>")).first()


def test_bull_call_spread(spark):
    r = _metrics(spark, [("CE", "buy", 100, 1, 500), ("CE", "sell", 110, 1, 200)])
    assert (r["net_c"], r["max_c"], r["min_c"], r["unlimited_profit"], r["unlimited_loss"]) == (300, 700, -300, False, False)
    assert r["breakevens"] == [103.0] and r["reward_risk"] == round(7 / 3, 4) and r["roi_pct"] == round(700 / 3, 4) and r["capital_c"] == 300


def test_straddles(spark):
    r = _metrics(spark, [("CE", "buy", 100, 1, 500), ("PE", "buy", 100, 1, 500)])
    assert r["breakevens"] == [90.0, 110.0] and r["unlimited_profit"] and r["reward_risk"] is None and r["roi_pct"] is None
    r = _metrics(spark, [("CE", "sell", 100, 1, 500)])
    assert r["breakevens"] == [105.0] and r["unlimited_loss"] and r["capital_c"] is None
    # flat at zero counts nothing
    assert _metrics(spark, [("CE", "buy", 100, 1, 0), ("CE", "sell", 100, 1, 0)])["breakevens"] == []


def _strike(spark, mode, value, spot=1012, strikes=(950, 1000, 1050)):
    x = spark.createDataFrame([(spot, list(strikes))], "spot long, strikes array<bigint>")
    r = x.select(strategy.resolve_strike(F.lit(mode), F.lit(value).cast("long"), F.col("spot"), F.col("strikes")).alias("r")).first()["r"]
    return r["strike"], r["error"], r["warning"]


def test_strike_formulas(spark):
    assert _strike(spark, "fixed", 1000) == (1000, None, None)
    assert _strike(spark, "fixed", 1010) == (None, "STRIKE_UNAVAILABLE", None)
    assert _strike(spark, "atm", 0, spot=1025) == (1000, None, None)  # ties go down
    assert _strike(spark, "atm_offset_steps", 5) == (1050, None, "CLAMPED")
    assert _strike(spark, "atm_offset", 50) == (1050, None, None)
    assert _strike(spark, "spot_offset", 50) == (1050, None, "NORMALISED")
    assert _strike(spark, "delta", 512) == (1000, None, None)
    assert _strike(spark, "delta", 700) == (950, None, "DELTA_OFF")
    assert _strike(spark, "delta", 5000)[1] == "DELTA_TOO_FAR"
    assert _strike(spark, "atm", 0, strikes=())[1] == "NO_STRIKES"


def test_exits_first_in_first_out(spark):
    exposures = spark.createDataFrame([(1, 1, "buy", 5), (1, 2, "buy", 5), (1, 3, "sell", 2), (2, 1, "buy", 3), (2, 2, "sell", 3), (3, 1, "sell", 4)], "position long, id long, side string, remaining long")
    exits = spark.createDataFrame([(1, 7), (2, 1), (3, 5), (4, 1)], "position long, quantity long")
    got = {(r["position"], r["id"]): (r["taken"], r["left"], r["error"]) for r in ledger.allocate_exits(exposures, exits).collect()}
    assert got == {(1, 1): (5, 0, None), (1, 2): (2, 3, None), (2, None): (None, None, "MIXED_SIDES"), (3, None): (None, None, "INSUFFICIENT"), (4, None): (None, None, "NO_EXPOSURE")}


def test_wall_clock(spark):
    stamps = ["2025-01-12T15:15:00+05:30", "2025-01-12T09:45:00Z", "2025-01-12 15:15:00", " ", "x", None]
    x = spark.createDataFrame([(s,) for s in stamps], "s string").select(rules.wall_clock(F.col("s")).alias("t"))
    assert [r["t"] for r in x.collect()] == [datetime(2025, 1, 12, 15, 15)] * 3 + [None] * 3


def test_contract_upsert(spark):
    old = spark.createDataFrame([("a", "X", None), ("b", "X", 50), ("c", "X", 50)], "k string, brand string, lot int")
    new = spark.createDataFrame([("a", "X", 75), ("b", "Y", 50), ("c", "X", 75), ("d", "Z", 1), (None, "Q", 1)], "k string, brand string, lot int")
    got = {r["k"]: (r["brand"], r["lot"], r["action"]) for r in landing.contract_actions(old, new, "k", ["brand"], "lot").collect()}
    assert got == {"a": ("X", 75, "filled"), "b": ("X", 50, "conflict"), "c": ("X", 50, "conflict"), "d": ("Z", 1, "insert"), None: ("Q", 1, "error")}


def test_upper_median_and_empty(spark):
    rows = [("S", date(2024, 1, d), 100, "CE", date(2024, 2, 1), 1, 1, 100) for d in (1, 2, 2, 3, 3, 3, 4, 4, 4, 4)]
    chain = spark.createDataFrame(rows, "symbol string, d date, strike long, option_type string, expiry date, oi long, gamma_c long, spot long")
    r = quality.completeness(chain).first()
    assert (r["chains"], r["median"], r["mean"], r["complete"]) == (4, 3, 2.5, 3)
    assert quality.completeness(chain.limit(0)).count() == 0
    assert quality.coverage(chain.limit(0)).first()["oi_coverage"] == 0.0


def test_equity_baseline(spark):
    rows = [(1, 7, date(2024, 1, 5), date(2024, 1, 2), 100, True), (2, 7, date(2024, 1, 4), date(2024, 1, 3), -300, True), (3, 7, date(2024, 1, 9), date(2024, 1, 1), 5, False)]
    trades = spark.createDataFrame(rows, "execution_id long, user_id long, exit_date date, entry_date date, pnl_c long, closed boolean")
    curve = portfolio.equity(trades, 1000).orderBy("step").collect()
    assert [(r["step"], r["execution_id"], r["equity"], r["drawdown"]) for r in curve] == [(0, None, 10.0, 0.0), (1, 1, 11.0, 0.0), (2, 2, 8.0, -3.0)]
    assert curve[0]["exit_date"] == date(2024, 1, 4)
    r = portfolio.max_drawdown(portfolio.equity(trades, 1000)).first()
    assert (r["max_drawdown"], r["current"], r["equity"]) == (-3.0, -3.0, 8.0)


def test_closest_time(spark):
    chain = spark.createDataFrame([("S", date(2024, 1, 1)), ("S", date(2024, 1, 5))], "symbol string, d date")
    targets = spark.createDataFrame([("S", date(2024, 1, d)) for d in (1, 3, 4, 9)], "symbol string, target date")
    got = {r["target"].day: r["closest"].day for r in reports.closest_time(chain, targets).collect()}
    assert got == {1: 1, 3: 1, 4: 5, 9: 5}
