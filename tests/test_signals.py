"""Signals and flip groups from their rules, one row after the other."""

import random

from pyspark.sql import functions as F

from quantloom.operators import study as R

DATA = "symbol string, d int, spot long, net_c long, before long, change long, accel long, dist double, wall_pos long, wall_neg long, oi long, oi_change long, up long, momentum long, ret_15 double, ret_30 double"


def series(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        spot, net, oi = rng.randrange(990, 1010), rng.randrange(-9, 10), rng.randrange(50)
        last = rows[-1] if rows else None
        change = net - last["net_c"] if last else None
        rows.append({
            "symbol": "X", "d": i, "spot": spot, "net_c": net, "before": last and last["net_c"], "change": change, "accel": change - last["change"] if last and last["change"] is not None else None,
            "dist": rng.choice([None, *(float(x) for x in range(-60, 61, 5))]), "wall_pos": rng.choice([None, 1000, 1003]), "wall_neg": None, "oi": oi, "oi_change": last and oi - last["oi"], "up": last and spot - last["spot"], "momentum": None,
            "ret_15": rng.choice([None, round(rng.gauss(0, 1), 4)]), "ret_30": rng.choice([None, round(rng.gauss(0, 1), 4)]),
        })
    return rows


def by_rule(rows):
    out = []
    for i, r in enumerate(rows):
        p, q = (rows[i - k] if i >= k else None for k in (1, 2))
        found = []
        d, d1, d2 = r["dist"], p and p["dist"], q and q["dist"]
        if d1 is not None and d is not None and d1 < 0 < d:
            found.append(("flip_break", r["ret_15"]))
        if None not in (d, d1, d2) and abs(d1) < 30 and abs(d) > abs(d1) * 1.5:
            found.append(("flip_rejection", None if r["ret_15"] is None else -r["ret_15"]))
        if p and r["change"] is not None and r["ret_15"] is not None:
            price_up, gex_up = r["spot"] > p["spot"], r["change"] > 0
            if price_up and not gex_up:
                found.append(("divergence", -r["ret_15"]))
            elif not price_up and gex_up:
                found.append(("divergence", r["ret_15"]))
        out += [(i, n, v) for n, v in found if v is not None]
    return sorted(out)


def test_flip_and_divergence_signals(spark):
    rows = series(400, 8)
    got = R.signals(spark.createDataFrame([tuple(r.values()) for r in rows], DATA)).filter(F.col("signal").isin("flip_break", "flip_rejection", "divergence")).collect()
    want = by_rule(rows)
    assert sorted((r["d"], r["signal"], r["value"]) for r in got) == want and len({w[1] for w in want}) == 3


def test_the_distance_is_above_0_if_the_flip_is_above_spot(spark):
    chain = [("X", f"2024-01-0{d}", "e", k, kind, 1, oi, spot, 5, 1000) for d, spot in ((1, 100), (2, 190)) for k, kind, oi in ((100, "PE", 10), (200, "CE", 10))]
    found = R.dataset(spark.createDataFrame(chain, "symbol string, d string, expiry string, strike long, option_type string, gamma_c long, oi long, spot long, ltp long, iv_bp long")).orderBy("d").collect()
    assert [r["dist"] for r in found] == [50.0, -40.0]


def test_flip_groups(spark):
    dist = [None, -30.0, 25.0, 5.0, -5.0, 40.0, 0.0, -60.0]
    df = spark.createDataFrame([("X", i, d, 1.0) for i, d in enumerate(dist)], "symbol string, d int, dist double, ret_15 double")
    got = {r["grp"]: r["n"] for r in R.grouped(df, R.flip_groups(), "ret_15").collect()}
    assert got == {"near": 3, "above": 2, "below": 2, "crossing_up": 2, "crossing_down": 2}
