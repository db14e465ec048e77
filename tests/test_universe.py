"""Contract selection, range compression and added information on literal rows."""

import math
import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import compression as C
from quantloom.operators import universe as U
from quantloom.plans import QUERIES


def test_first_open_of_the_session_decides(spark):
    at = datetime(2024, 1, 4, 9, 15)
    rows = [("X", at - timedelta(minutes=5), 1.0), ("X", at, 100.0), ("X", at + timedelta(minutes=3), 200.0), ("X", at + timedelta(days=1), 0.0), ("X", at + timedelta(days=1, minutes=3), 300.0), ("X", at.replace(day=6, hour=15, minute=28), 400.0), ("X", at.replace(day=7, hour=15, minute=27), 500.0)]
    got = {r["day"]: r["open"] for r in U.first_opens(spark.createDataFrame(rows, "symbol string, open_time timestamp, open double")).collect()}
    assert got == {date(2024, 1, 4): 100.0, date(2024, 1, 7): 500.0}  # a day whose first bar is no price is left out


@pytest.mark.parametrize("back,want", [(0, (1000, 0)), (3, (1000, 3)), (5, (1000, 5)), (6, None)])
def test_look_back_is_bounded(spark, back, want):
    day = date(2024, 1, 31)
    opens = spark.createDataFrame([("X", day - timedelta(days=back), 1012.0), ("X", day - timedelta(days=back + 1), 9999.0), ("X", day + timedelta(days=1), 1.0), ("Y", day, 1.0)], "symbol string, day date, open double")
    got = U.historical_atm(spark.createDataFrame([("X", day)], "symbol string, target date"), opens).collect()
    assert [(r["atm"], r["days_back"]) for r in got] == ([want] if want else [])


def test_halves_go_to_the_even_strike(spark):
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate((1012.5, 1037.5, 1012.4, 1037.6, 24.0))], "i int, v double").orderBy("i").select(U.on_grid(F.col("v"))).collect()]
    assert got == [1000, 1050, 1000, 1050, 25]


@pytest.mark.parametrize("strikes", [[100], [100, 200], [300, 100, 200], [100, 100, 100, 900], [0, 100, 200, 300, 400], [500, 500, 100, 100]])
def test_upper_median(spark, strikes):
    df = spark.createDataFrame([("X", "e", k) for k in strikes], "symbol string, expiry string, strike long")
    real = sorted(k for k in strikes if k > 0)
    assert U.upper_median_strikes(df).first()["median"] == real[len(real) // 2]


def test_all_three_sources_of_the_money(spark, sf_dir):
    found = QUERIES["tier_one_report"](spark, sf_dir).collect()
    assert {r["source"] for r in found} == {"EXACT", "LOOKBACK", "MEDIAN"}
    assert all(r["lowest"] >= r["atm"] - 500 and r["highest"] <= r["atm"] + 500 and r["contracts"] == r["calls"] + r["puts"] for r in found)


def lower(values, percent):
    return sorted(values)[int(percent / 100 * (len(values) - 1))]


def test_windows_against_a_plain_version(spark):
    rng, begin = random.Random(4), date(2024, 1, 1)
    rows = [("X", begin + timedelta(days=i), rng.randrange(50), rng.choice([None, round(rng.random(), 4)])) for i in range(200) if rng.random() < 0.8]
    rows[0], rows[-1] = (*rows[0][:3], 0.5), (*rows[-1][:3], 0.5)
    got = {r["start"]: (r["n"], r["low_range"], r["high_range"], r["compression"]) for r in C.stability(spark.createDataFrame(rows, "symbol string, d date, abs_gex long, range_15m double")).collect()}
    real, want, at = [r for r in rows if r[3] is not None], {}, rows[0][1]
    while at + timedelta(days=90) <= real[-1][1]:
        w = [(g, v) for _, d, g, v in real if at <= d < at + timedelta(days=90)]
        low, high = ([v for g, v in w if when(g)] for when in (lambda g: g < lower([x for x, _ in w], 20), lambda g: g > lower([x for x, _ in w], 80)))
        if len(w) >= 20 and low and high:
            a, b = statistics.mean(low), statistics.mean(high)
            want[at] = (len(w), pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-6), pytest.approx(a - b, abs=2e-6))
        at += timedelta(days=30)
    assert got == want and len(want) >= 3


def test_straddles_and_costs(spark):
    chain = [("X", 1, 100, "e", "CE", 5, 104), ("X", 1, 100, "e", "PE", 3, 104), ("X", 1, 100, "e", "PE", 2, 104), ("X", 1, 150, "e", "CE", 9, 104), ("X", 2, 100, "e", "CE", 5, 104), ("X", 2, 108, "e", "CE", 5, 104), ("X", 2, 108, "e", "PE", 5, 104), ("X", 3, 100, "f", "PE", 1, 104), ("X", 3, 108, "a", "CE", 5, 104)]
    got = [(r["d"], r["strike"], r["premium"]) for r in C.straddles(spark.createDataFrame(chain, "symbol string, d int, strike long, expiry string, option_type string, ltp long, spot long")).collect()]
    assert got == [(1, 100, 8)]  # on the second day the nearest strike lacks a side, and a further one does not stand in
    rows = [("X", i, 100 + i, i, 2.0 if i == 9 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, d int, spot long, abs_gex long, range_15m double")
    pairs = spark.createDataFrame([("X", i, 10) for i in range(10)], "symbol string, d int, premium long")
    found = {r["side"]: r for r in C.straddle_study(df, pairs, ["15m"]).collect()}
    assert (found["LOW"]["n"], found["LOW"]["result"], found["LOW"]["cost"], found["LOW"]["result_after_cost"]) == (1, 9.0, 0.015, 8.985)
    assert (found["HIGH"]["n"], found["HIGH"]["result"]) == (2, 8.5)


def test_a_feature_adds_what_price_does_not_tell(spark):
    rng = random.Random(6)
    rows = [("X", i, rng.randrange(90, 110), float(rng.randrange(9)), 1.0) for i in range(80)]
    rows = [(*r, 0.5 * r[3] + rng.gauss(0, 0.1)) for r in rows]
    df = C.baseline(spark.createDataFrame(rows, "symbol string, d int, spot long, f double, flat double, y double"))
    got = {r["feature"]: r for r in C.adds_information(df, ["f", "flat"], "y").collect()}
    x, y = [r[3] for r in rows], [r[5] for r in rows]
    assert got["f"]["combined_r2"] == pytest.approx(statistics.correlation(x, y) ** 2, abs=1e-6) and got["f"]["adds_information"]
    assert not got["flat"]["adds_information"] and got["flat"]["incremental_r2"] == 0 and not math.isnan(got["flat"]["baseline_r2"])


def test_strikes_by_quoted_delta(spark):
    from quantloom.operators import strategy

    rows = [("X", date(2024, 1, 1), date(2024, 1, 31), k, t, 100, 2000) for k in (80, 95, 100, 105, 130) for t in ("CE", "PE")] + [("X", date(2024, 1, 1), date(2024, 1, 1), 100, "CE", 100, 2000), ("X", date(2024, 1, 1), date(2024, 1, 31), 100, "XX", 100, 2000)]
    df = spark.createDataFrame(rows, "symbol string, d date, expiry date, strike long, option_type string, spot long, iv_bp long")
    cdf = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
    t = 30 / 365
    delta = {k: round(1000 * cdf((math.log(100 / k) + (0.065 + 0.02) * t) / (0.2 * math.sqrt(t)))) for k in (80, 95, 100, 105, 130)}
    targets = [("CE", 540), ("CE", 250), ("PE", -300), ("CE", 700), ("PE", -1500)]
    got = {(r["side"], r["target"]): (r["strike"], r["delta"], r["status"]) for r in strategy.strikes_by_delta(df, targets).collect()}
    assert len(got) == 5 and got["CE", 540] == (100, delta[100], "RESOLVED") and got["CE", 250] == (105, delta[105], "RESOLVED")
    assert got["PE", -300] == (95, delta[95] - 1000, "DELTA_OFF") and got["PE", -1500] == (None, None, "DELTA_TOO_FAR")
    off = min(abs(v - 700) for v in delta.values())
    assert got["CE", 700][2] == ("DELTA_OFF" if off > 100 else "RESOLVED")
