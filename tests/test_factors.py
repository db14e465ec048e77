"""Factor research on literal rows: features by hand, screens and bootstraps against plain versions."""

import hashlib
import math
import random
import statistics

import pytest

from quantloom.operators import factors as R

CHAIN = "symbol string, d string, expiry string, strike long, option_type string, gamma_c long, oi long, spot long, ltp long, iv_bp long"


def test_features_by_hand(spark):
    rows = [
        ("X", "2024-01-01", "e", 100, "CE", 1, 10, 110, 5, 1000), ("X", "2024-01-01", "e", 100, "PE", 4, 10, 110, 5, 1400), ("X", "2024-01-01", "e", 150, "CE", 2, 30, 110, 5, 1200),
        ("X", "2024-01-02", "e", 100, "CE", 2, 10, 120, 5, None), ("X", "2024-01-02", "e", 150, "CE", 1, 10, 120, 5, 1000), ("X", "2024-01-02", "e", 150, "XX", 9, 10, 120, 5, 1000),
        ("X", "2024-01-03", "e", 100, "PE", 1, 10, 90, 5, 1000), ("X", "2024-01-03", "e", 100, "CE", 1, 0, 90, 5, 1000),
        ("X", "2024-01-04", "e", 100, "PE", None, 10, 90, 5, 1000),
    ]
    a, b, c = (r.asDict() for r in R.features(spark.createDataFrame(rows, CHAIN)).orderBy("d").collect())  # the fourth has no exposure
    assert (a["ce_gex"], a["pe_gex"], a["net_gex"], a["abs_gex"]) == ((10 + 60) * 110**2, -40 * 110**2, 30 * 110**2, 110 * 110**2)
    assert (a["gamma_flip"], a["pos_wall"], a["neg_wall"], a["pos_wall_dist"], a["flip_distance"]) == (pytest.approx(100 + 50 * 30 / 90, abs=1e-6), 150, 100, 40, pytest.approx(6.666667))
    assert (a["gex_change"], a["price_momentum"], a["oi_class"], a["gex_momentum_align"], a["regime_momentum"], a["iv_change"]) == (0, 0, "NEUTRAL", 0, "NEUTRAL", None)
    assert (a["ce_iv"], a["pe_iv"], a["atm_iv"], a["iv_skew"]) == (1100.0, 1400.0, 1250.0, 300.0)
    assert b["ce_pe_ratio"] is None and b["pe_iv"] is None and b["atm_iv"] is None and b["gamma_flip"] is None and b["neg_wall"] is None
    assert (b["gex_change"], b["price_momentum"], b["oi_change"], b["oi_class"], b["regime_momentum"]) == (30 * 120**2 - 30 * 110**2, 10, -30, "SHORT_COVERING", "POS_GAMMA_UP")
    assert (c["regime"], c["oi_class"], c["gex_momentum_align"], c["regime_momentum"]) == ("NEG_GAMMA", "LONG_UNWINDING", 1, "NEG_GAMMA_DOWN")
    assert c["gex_acceleration"] == (c["net_gex"] - b["net_gex"]) - (b["net_gex"] - a["net_gex"]) and c["price_acceleration"] == -40


def _t(values):
    return statistics.mean(values) / (statistics.stdev(values) / math.sqrt(len(values)))


def test_screen_takes_the_outer_quartiles_and_adjusts_over_all_tests(spark):
    rng = random.Random(3)
    rows = [("X", i, float(rng.randrange(9)) if i % 11 else None, "ab"[i % 2], "only one" if i == 7 else None, round(rng.gauss(0.1, 1), 4) if i > 2 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, d int, f double, g string, h string, ret_1 double")
    got = {(r["feature"], r["cls"]): r for r in R.screen(df, ["f"], ["g", "h"], ["1"]).collect()}
    assert set(got) == {("f", None), ("g", "a"), ("g", "b")}  # a group of one row is no test
    x = sorted((r[2], r[1], r[5]) for r in rows if r[2] is not None and r[5] is not None)
    n = len(x)
    low, high = [v for *_, v in x[: n // 4]], [v for *_, v in x[3 * n // 4 :]]
    r = got["f", None]
    assert (r["n"], r["q1_mean"], r["spread"], r["t_stat"]) == (len(low + high), pytest.approx(statistics.mean(low), abs=1e-6), pytest.approx(statistics.mean(high) - statistics.mean(low), abs=1e-6), pytest.approx(_t(low + high), abs=1e-6))
    ps = sorted(v["p_value"] for v in got.values())
    want = [min(1, min(p * 3 / (j + 1) for j, p in list(enumerate(ps))[i:])) for i in range(3)]
    assert sorted(v["adj_p_value"] for v in got.values()) == pytest.approx(want, abs=1e-7)


def test_p_values(spark):
    from pyspark.sql import functions as F

    rows = [(t, n) for t in (0.0, 1.0, 1.6, 2.2, -2.7, 3.5, 5.0) for n in (1, 10, 31, 32, 500)]
    got = {(r["t"], r["n"]): r["p"] for r in spark.createDataFrame(rows, "t double, n long").select("t", "n", R.tail_p(F.col("t"), F.col("n")).alias("p")).collect()}
    for t, n in rows:
        x = abs(t)
        tail = min(2 * (math.exp(-x * x / 2) / (x * math.sqrt(2 * math.pi)) if x else 0.5), 1.0)
        steps = next((p for level, p in ((4, 0.001), (3, 0.005), (2.5, 0.02), (2.0, 0.05), (1.5, 0.15)) if x > level), 0.3)
        assert got[t, n] == pytest.approx(1.0 if n < 2 else tail if n > 31 else steps)


@pytest.mark.parametrize("n,block", [(7, 2), (12, 3), (30, 1), (41, 5), (3, 2), (4, 2)])
def test_block_bootstrap_against_drawn_rows(spark, n, block):
    values = [round(math.sin(i) * 3, 4) for i in range(n)]
    rows = [("X", i, v) for i, v in enumerate(values)] + [("X", -1, None), ("Y", 0, 1.0)]
    got = {r["symbol"]: r for r in R.block_bootstrap(spark.createDataFrame(rows, "symbol string, d int, v double"), "v", ["symbol"], "d", block=block, replicates=100).collect()}
    r = got["X"]
    assert r["n"] == n and r["mean"] == pytest.approx(statistics.mean(values), abs=1e-6) and (got["Y"]["n"], got["Y"]["ci_low"]) == (1, None)
    if n < 2 * block:
        assert r["ci_low"] is r["ci_high"] is r["se"] is None
        return
    means = []
    for rep in range(100):
        drawn = []
        for b in range(-(-n // block)):
            at = int(hashlib.md5(f"{rep}:{b}".encode()).hexdigest()[:8], 16) % (n - block + 1)
            drawn += values[at : at + block]
        means.append(statistics.mean(drawn[:n]))
    means.sort()
    assert (r["ci_low"], r["ci_high"], r["se"]) == (pytest.approx(means[2], abs=1e-6), pytest.approx(means[96], abs=1e-6), pytest.approx(statistics.stdev(means), abs=1e-6))


def test_parts_are_of_all_times(spark):
    rows = [("X", i, i, "POS_GAMMA", 1 if i % 2 else -1, None, 0, 0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, d int, idx int, regime string, price_momentum int, iv_change double, oi_change int, gex_momentum_align int, ret_15m double")
    got = {(r["candidate"], r["part"]): (r["n"], r["sufficient"]) for r in R.walk_forward(df, least=2).collect()}
    assert got == {(c, p): (n, n >= 2) for c in ("POS_GAMMA_UP", "POS_GAMMA_DOWN") for p, n in (("Train", 3), ("Val", 1), ("Test", 1))}
