"""Payloads, exposure with availability, Greeks of bars and thinned series on literal rows."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import live as L
from quantloom.operators import spacing as X


def side(gamma, oi, **market):
    return {"market_data": {"oi": oi, **market}, "option_greeks": {"gamma": gamma}}


def chains(spark, *items, spot=100.0):
    raw = [i if isinstance(i, str) else json.dumps({"data": i}) for i in items]
    df = spark.createDataFrame([(f"S{n}", "2024-01-25", datetime(2024, 1, 20, 10), r) for n, r in enumerate(raw)], "symbol string, expiry string, captured_at timestamp, raw string")
    return L.canonical_chain(df)


def row(strike, call=None, put=None, spot=100.0):
    return {"strike_price": strike, "underlying_spot_price": spot, "call_options": call, "put_options": put}


def test_canonical_chain(spark):
    items = [row(150, side(0.1, 5, prev_oi=2, ltp=1.5, last_trade_time="", last_update_time="u"), None, None), row(100, None, side("x", 7, last_trade_time="t", last_update_time="u"), 99.5), row(120, spot=70)]
    (c,) = chains(spark, items).collect()
    assert c["spot"] == 99.5 and [r["strike"] for r in c["chain"]] == [100, 120, 150]
    last, first = c["chain"][2]["call"], c["chain"][0]["put"]
    assert (last["oi"], last["chg_oi"], last["ltp"], last["quote_time"]) == ("5", 3.0, 1.5, "u") and (first["chg_oi"], first["gamma"], first["quote_time"]) == (None, "x", "t")


CASES = [
    (side(0.5, 10), side(0.25, 10), "available", 500.0, -250.0),
    (side(0.5, 10), side(0.25, 0), "partial", 500.0, None),
    (None, side(0.25, 10), "partial", None, -250.0),
    (side(-1, 10), side(0.25, 0), "invalid", None, None),
    (side("n/a", 10), None, "invalid", None, None),
    (side(None, 10), side(0.25, None), "unavailable", None, None),
    (side(0.5, -3), side(0.5, "many"), "unavailable", None, None),
    (side(0, 10), None, "invalid", None, None),
]


@pytest.mark.parametrize("call,put,status,call_gex,put_gex", CASES)
def test_strike_status(spark, call, put, status, call_gex, put_gex):
    (r,) = L.strike_exposure(chains(spark, [row(100, call, put)])).collect()
    assert (r["status"], r["call_gex"], r["put_gex"]) == (status, call_gex, put_gex)
    assert r["net_gex"] == (None if None in (call_gex, put_gex) else call_gex + put_gex)


def test_chain_status_totals_and_age(spark):
    full, half, bad, none = (row(k, *CASES[i][:2]) for k, i in ((100, 0), (110, 1), (120, 3), (130, 5)))
    aged = row(100, side(0.5, 10, last_trade_time="2024-01-20T09:59:00Z"), side(0.5, 10, last_trade_time="2024-01-20T15:28:30+05:30"))
    found = L.chain_exposure(chains(spark, [full, full], [full, bad], [half], [bad, none], [none], [], "no json", [row(100, *CASES[0][:2], spot=-1)], [aged, row(110, side(1, 1, last_trade_time="soon"))])).orderBy("symbol").collect()
    assert [(r["status"], r["call_gex"], r["put_gex"], r["net_gex"], r["valid_strikes"], r["strikes"], r["age_ms"]) for r in found] == [
        ("available", 1000.0, -500.0, 500.0, 2, 2, None), ("partial", 500.0, -250.0, 250.0, 1, 2, None), ("partial", 500.0, None, None, 1, 1, None), ("invalid", None, None, None, 0, 2, None),
        ("unavailable", None, None, None, 0, 1, None), ("unavailable", None, None, None, 0, 0, None), ("unavailable", None, None, None, 0, 0, None), ("unavailable", None, None, None, 0, 0, None),
        ("partial", 600.0, -500.0, 100.0, 2, 2, 90_000),
    ]


def test_bar_greeks_statuses(spark):
    at = datetime(2024, 1, 23, 10)
    known = spark.createDataFrame([("c", "X", "CE", 100, "2024-01-30", 50), ("p", "X", "PE", 100, "2024-01-23", 50)], "instrument string, symbol string, option_type string, strike long, expiry string, lot_size int").withColumn("expiry", F.to_date("expiry"))
    bars = [("c", at, 5.0), ("c", at, 0.0), ("c", at, 1.0), ("c", at.replace(day=24), 5.0), ("p", at.replace(hour=12), 2.0), ("unknown", at, 5.0), ("c", at.replace(hour=9, minute=20), 200.0)]
    index = [("X", at.replace(hour=9, minute=15), 104.0), ("X", at.replace(hour=9, minute=50), 0.0), ("X", at.replace(hour=11), 90.0)]
    ts = "open_time timestamp"
    found = L.bar_greeks(spark.createDataFrame(bars, f"instrument string, {ts}, price double"), known, spark.createDataFrame(index, f"symbol string, {ts}, close double")).collect()
    got = {(r["instrument"], r["open_time"], r["price"]): r for r in found}
    assert len(found) == 6
    r = got["c", at, 5.0]
    assert (r["status"], r["error"], r["spot"], r["intrinsic"]) == ("SUCCESS", None, 104.0, 4.0) and 0 < r["delta"] < 1 and r["theta"] < 0
    t, v = r["t"], r["iv"]
    d1 = (math.log(1.04) + (0.065 + v * v / 2) * t) / (v * math.sqrt(t))
    cdf = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
    assert 104 * cdf(d1) - 100 * math.exp(-0.065 * t) * cdf(d1 - v * math.sqrt(t)) == pytest.approx(5.0, abs=1e-4)
    assert [(got[k]["status"], got[k]["error"], got[k]["spot"], got[k]["delta"], got[k]["iv"]) for k in (("c", at, 0.0), ("c", at, 1.0), ("c", at.replace(day=24), 5.0), ("p", at.replace(hour=12), 2.0), ("c", at.replace(hour=9, minute=20), 200.0))] == [
        ("INVALID_PRICE", "ZERO_PRICE", 104.0, None, None), ("NO_IV", "BELOW_INTRINSIC", 104.0, None, None), ("INSUFFICIENT_DATA", "NO_SPOT", 0.0, None, None), ("SUCCESS", None, 90.0, -1.0, None), ("NO_IV", "ABOVE_MAX", 104.0, None, None),
    ]


@pytest.mark.parametrize("flat", [False, True])
def test_spacing_takes_one_after_the_other(spark, flat):
    rng, begin = random.Random(5), datetime(2024, 1, 1)
    rows = [(k, begin + timedelta(seconds=rng.randrange(4000)), i, rng.randrange(3)) for i, k in enumerate("ab" * 200)] + [("c", None, 900, 1), (None, begin, 901, 1), (None, begin, 902, 2)]
    df = spark.createDataFrame(rows, "k string, at timestamp, n int, v int")
    want, last = set(), {}
    for k, at, n, v in sorted(rows, key=lambda r: (r[1] or begin, r[2])):
        if at is not None and (k not in last or ((at - last[k][0]).total_seconds() >= 60 and not (flat and v == last[k][1]))):
            last[k] = at, v
            want.add(n)
    assert {r["n"] for r in X.spaced(df, "k", "at", "v", 60, skip_flat=flat, tie="n").collect()} == want
    assert X.spaced(df.limit(0), "k", "at", "v", 60).count() == 0


def test_newest_and_cleaned(spark):
    day = datetime(2024, 1, 5, 15, 29)  # a Friday
    rows = [("a", day, 1, 5), ("a", day + timedelta(minutes=1), 2, 5), ("a", day + timedelta(minutes=2), 3, 9), ("a", day + timedelta(days=1), 4, 6), ("a", day + timedelta(days=3), 5, 5), ("a", day + timedelta(days=3, minutes=1), 6, 7)]
    df = spark.createDataFrame(rows, "k string, at timestamp, n int, v int")
    assert sorted(r["n"] for r in X.cleaned(df, "k", "at", "v", "n").collect()) == [1, 6]
    assert sorted(r["n"] for r in X.newest(df, "k", "at", 2).collect()) == [5, 6]
