"""Registered queries: research dataset, signals, grouped outcomes, splits and effects, each with its SQL."""

from __future__ import annotations

from ..operators import study as R
from ..sources import adapters as S
from .queries import DESCRIBE, STRIKES, _cdf, query

H = (3, 6, 9, 15, 30, 60)
FLIPS = """, fn AS (SELECT symbol, d, spot, strike, CAST(net_c AS DOUBLE) AS a, lead(strike) OVER w AS k2, CAST(lead(net_c) OVER w AS DOUBLE) AS b FROM strikes WINDOW w AS (PARTITION BY symbol, d ORDER BY strike)),
fx AS (SELECT *, CASE WHEN b IS NULL OR NOT (a * b < 0 OR a = 0) THEN NULL WHEN a = 0 THEN CAST(strike AS DOUBLE) ELSE strike + (k2 - strike) * (abs(a) / (abs(a) + abs(b))) END AS level FROM fn),
flips AS (SELECT symbol, d, round(arg_min(level, (abs(level - spot), level)) FILTER (level IS NOT NULL), 6) AS flip FROM fx GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY symbol, d, net_c > 0 ORDER BY abs(net_c) DESC, strike) AS r FROM strikes WHERE net_c <> 0), walls AS (SELECT symbol, d, max(strike) FILTER (net_c > 0 AND r = 1) AS wall_pos, max(strike) FILTER (net_c < 0 AND r = 1) AS wall_neg FROM wr GROUP BY ALL)"""
DATA = STRIKES + FLIPS + """, base AS (SELECT symbol, d, spot, CAST(sum(net_c) AS BIGINT) AS net_c, CAST(sum(oi) AS BIGINT) AS oi FROM strikes GROUP BY ALL),
b1 AS (SELECT *, lag(net_c) OVER (PARTITION BY symbol ORDER BY d) AS before FROM base), b2 AS (SELECT *, net_c - before AS change FROM b1 JOIN flips USING (symbol, d) LEFT JOIN walls USING (symbol, d)),
data AS (SELECT symbol, d, spot, net_c, before, change, change - lag(change) OVER w AS accel, CASE WHEN net_c > 0 THEN 'POSITIVE' WHEN net_c < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS regime, round(flip - spot, 6) AS dist, wall_pos, wall_neg, oi,
  oi - lag(oi) OVER w AS oi_change, spot - lag(spot) OVER w AS up, spot - lag(spot, 3) OVER w AS momentum, """ + ", ".join(f"round((lead(spot, {k}) OVER w - spot) * 100.0::DOUBLE / spot, 4) AS ret_{k}" for k in H) + """ FROM b2 WINDOW w AS (PARTITION BY symbol ORDER BY d))"""


def _signals(source: str) -> str:
    rules = [
        ("regime_shift", "before < 0 AND net_c > 0", "ret_15"), ("flip_break", "dist1 < 0 AND dist > 0", "ret_15"), ("flip_rejection", "dist2 IS NOT NULL AND abs(dist1) < 30 AND abs(dist) > abs(dist1) * 1.5", "-ret_15"),
        ("positive_pin", "net_c > 0 AND abs(spot - wall_pos) * 100.0::DOUBLE / spot < 0.3", "abs(ret_30)"), ("negative_expansion", "net_c < 0 AND change < 0", "abs(ret_15)"), ("acceleration", "accel > 0", "ret_15"),
        ("negative_oi_up", "net_c < 0 AND oi_change > 0", "-ret_15"), ("wall_rejection", "i > 2 AND wall_pos IS NOT NULL AND abs(spot1 - wall1) * 100.0::DOUBLE / spot1 < 0.5 AND spot < spot1", "ret_15"),
        ("wall_breakout", "spot1 < wall1 AND spot > wall_pos", "ret_15"), ("divergence", "(up > 0 AND change <= 0) OR (up <= 0 AND change > 0)", "(CASE WHEN up > 0 THEN -ret_15 ELSE ret_15 END)"),
    ]
    found = " UNION ALL ".join(f"SELECT symbol, d, '{n}' AS signal, {v} AS value FROM lagged WHERE ({when}) AND {v} IS NOT NULL" for n, when, v in rules)
    return f""", lagged AS (SELECT *, lag(dist) OVER w AS dist1, lag(dist, 2) OVER w AS dist2, lag(spot) OVER w AS spot1, lag(wall_pos) OVER w AS wall1, row_number() OVER w AS i FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY d)), signals AS ({found})"""


def _data(s, d):
    return R.dataset(S.chain(s, d))


@query(DATA + " SELECT * FROM data")
def research_dataset(s, d):
    return _data(s, d)


@query(DATA + _signals("data") + " SELECT * FROM signals")
def ten_signals(s, d):
    return R.signals(_data(s, d))


@query(DATA + _signals("data") + """, g AS (SELECT symbol, signal, count(*) AS n, round(avg(value), 4) AS mean, round(avg(CASE WHEN value > 0 THEN 1 ELSE 0 END) * 100, 2) AS win_pct FROM signals GROUP BY ALL)
SELECT *, CASE WHEN n < 10 THEN 'INSUFFICIENT' WHEN n < 50 THEN 'LOW' WHEN win_pct BETWEEN 45 AND 55 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(mean) DESC, signal) AS INTEGER) AS rank FROM g""")
def signal_ranking(s, d):
    return R.ranking(R.signals(_data(s, d)))


def _grouped(groups: dict[str, str], value: str) -> str:
    rows = " UNION ALL ".join(f"SELECT symbol, '{n}' AS grp, {value} FROM lagged WHERE {when}" for n, when in groups.items())
    return f", g AS ({rows}) SELECT symbol, grp, {DESCRIBE.replace('ret', value)} FROM g WHERE {value} IS NOT NULL GROUP BY ALL"


LAGGED = DATA + ", lagged AS (SELECT *, lag(dist) OVER w AS dist1, lag(change) OVER w AS last FROM data WINDOW w AS (PARTITION BY symbol ORDER BY d))"


@query(LAGGED + _grouped({"near": "abs(dist) < 20", "above": "dist >= 20", "below": "dist <= -20", "crossing_up": "dist1 <= 0 AND dist > 0", "crossing_down": "dist1 >= 0 AND dist < 0"}, "ret_15"))
def flip_reactions(s, d):
    return R.grouped(_data(s, d), R.flip_groups(), "ret_15")


COMBOS = {
    "increasing": "change > 0", "decreasing": "change < 0", "flat": "change = 0",
    **{f"{a}_{b}": f"{x} AND {y}" for a, x in (("pos", "net_c > 0"), ("neg", "NOT net_c > 0"), ("rising", "change > 0"), ("falling", "NOT change > 0")) for b, y in (("up", "momentum > 0"), ("down", "NOT momentum > 0"), ("oi_up", "oi_change > 0"), ("oi_down", "NOT oi_change > 0"))},
    "rising_twice": "change > 0 AND last > 0", "falling_twice": "change < 0 AND last < 0", "accelerating": "accel > 0", "decelerating": "accel < 0", "turned_positive": "before < 0 AND net_c > 0", "turned_negative": "before > 0 AND net_c < 0",
    "thursday": "isodow(d) = 4", "other_day": "isodow(d) <> 4",
}


@query(LAGGED + _grouped(COMBOS, "ret_15"))
def outcome_groups(s, d):
    return R.grouped(_data(s, d), R.combo_groups(), "ret_15")


@query(DATA + ", h AS (" + " UNION ALL ".join(f"SELECT symbol, regime, {k} AS horizon, ret_{k} AS ret FROM data" for k in H) + f") SELECT symbol, regime, CAST(horizon AS INTEGER) AS horizon, {DESCRIBE} FROM h WHERE ret IS NOT NULL GROUP BY ALL")
def regime_by_horizon(s, d):
    return R.regime_by_horizon(_data(s, d))


@query(DATA + """, l AS (SELECT *, list(spot) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS later FROM data), e AS (SELECT symbol, spot, later, 'POSITIVE' AS side, 1 AS sign, wall_pos AS wall FROM l WHERE len(later) >= 3 AND wall_pos IS NOT NULL
  UNION ALL SELECT symbol, spot, later, 'NEGATIVE', -1, wall_neg FROM l WHERE len(later) >= 3 AND wall_pos IS NOT NULL), f AS (SELECT *, list_filter(list_transform(later, lambda v: CASE WHEN (v - wall) * sign * 100.0::DOUBLE / wall > 0.3 THEN 'BREAK' WHEN (v - wall) * sign * 100.0::DOUBLE / wall < -0.5 THEN 'REJECTION' END), lambda x: x IS NOT NULL)[1] AS ev
  FROM e WHERE abs(wall - spot) * 100.0::DOUBLE / spot < 0.5) SELECT symbol, side, coalesce(ev, 'TOUCH') AS event, count(*) AS n FROM f GROUP BY ALL""")
def wall_behaviour(s, d):
    return R.wall_events(_data(s, d))


@query(DATA + """, parts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY d) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7) THEN 'train' ELSE 'test' END AS part FROM data),
o1 AS (SELECT * EXCLUDE (symbol, part, before, change, oi_change, up, accel), symbol || '|' || part AS symbol, lag(net_c) OVER w AS before, net_c - lag(net_c) OVER w AS change, oi - lag(oi) OVER w AS oi_change, spot - lag(spot) OVER w AS up FROM parts WINDOW w AS (PARTITION BY symbol, part ORDER BY d)),
own AS (SELECT *, change - lag(change) OVER (PARTITION BY symbol ORDER BY d) AS accel FROM o1)""" + _signals("own") + """ SELECT string_split(symbol, '|')[1] AS symbol, string_split(symbol, '|')[2] AS part, signal, count(*) AS n, round(avg(value), 4) AS mean, round(avg(CASE WHEN value > 0 THEN 1 ELSE 0 END) * 100, 2) AS win_pct FROM signals GROUP BY ALL""")
def signal_walk_forward(s, d):
    return R.walk_forward(_data(s, d))


@query(DATA + """, x AS (SELECT symbol, ret_15 AS y, row_number() OVER (PARTITION BY symbol ORDER BY net_c, d) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM data WHERE ret_15 IS NOT NULL), q AS (SELECT *, least(floor(r / floor(n / 5)), 4) + 1 AS q FROM x WHERE n >= 200),
g AS (SELECT symbol, n, avg(y) AS m, avg(y) FILTER (q = 1) AS m1, avg(y) FILTER (q = 5) AS m5, var_samp(y) FILTER (q = 1) AS v1, var_samp(y) FILTER (q = 5) AS v5, count(*) FILTER (q = 1) AS n1, count(*) FILTER (q = 5) AS n5 FROM q GROUP BY symbol, n)
SELECT symbol, n, round(m1, 6) AS bottom, round(m5, 6) AS top, round(m5 - m, 6) AS lift, round(m5 - m1, 6) AS spread, round((m5 - m1) / sqrt(((n1 - 1) * v1 + (n5 - 1) * v5) / (n1 + n5 - 2)), 6) AS cohen_d FROM g""")
def quintile_effect(s, d):
    return R.quintile_effect(_data(s, d), "net_c", "ret_15")


@query(DATA + f""", g AS (SELECT symbol, regime, count(*) AS n, avg(ret_15) AS m, stddev_samp(ret_15) AS sd FROM data WHERE ret_15 IS NOT NULL GROUP BY ALL), t AS (SELECT *, m / (sd / sqrt(n)) AS t, abs(m / (sd / sqrt(n))) AS a FROM g)
SELECT symbol, regime, n, round(m, 6) AS mean, round(t, 6) AS t, round(CASE WHEN n > 31 THEN 2 * (1 - {_cdf("a")}) WHEN a > 3.5 THEN 0.001 WHEN a > 2.75 THEN 0.01 WHEN a > 2.04 THEN 0.05 WHEN a > 1.7 THEN 0.1 ELSE 0.5 END, 6) AS p, round(m - sd / sqrt(n) * 1.96, 6) AS low95, round(m + sd / sqrt(n) * 1.96, 6) AS high95, round(m / sd, 6) AS cohen_d FROM t""")
def regime_t_test(s, d):
    return R.t_test(_data(s, d), "ret_15", "symbol", "regime")


@query(DATA + """, l AS (SELECT symbol, quantile_cont(net_c::DOUBLE, 0.2) AS p20, quantile_cont(net_c::DOUBLE, 0.8) AS p80 FROM data GROUP BY symbol)
SELECT symbol, CASE WHEN net_c <= p20 THEN 'LOW' WHEN net_c >= p80 THEN 'HIGH' ELSE 'MID' END AS band, count(*) AS n, round(avg(ret_15), 8) AS mean FROM data JOIN l USING (symbol) WHERE ret_15 IS NOT NULL GROUP BY ALL""")
def percentile_bands(s, d):
    return R.regimes_by_percentile(_data(s, d), "net_c", "ret_15")


@query(DATA + """, x AS (SELECT symbol, ret_15, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM data WHERE ret_15 IS NOT NULL), k AS (SELECT symbol, unnest(generate_series(0, (any_value(n) - 400) // 100)) AS k FROM x GROUP BY symbol HAVING any_value(n) >= 400),
g AS (SELECT symbol, k, avg(ret_15) FILTER (i - k * 100 < 300) AS a, avg(ret_15) FILTER (i - k * 100 >= 300) AS b FROM x JOIN k USING (symbol) WHERE i >= k * 100 AND i < k * 100 + 400 GROUP BY ALL)
SELECT symbol, k AS "window", round(a, 6) AS train, round(b, 6) AS test, sign(a) = sign(b) AS agrees, round(1 - abs(b) / abs(a), 6) AS degradation FROM g""")
def walk_forward_windows(s, d):
    return R.split_windows(_data(s, d), "ret_15")


@query(DATA + """, x AS (SELECT symbol, ret_15 AS v, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM data WHERE ret_15 IS NOT NULL), r AS (SELECT symbol, rep, ('0x' || substr(md5(rep || ':' || i), 1, 8))::BIGINT % n AS i FROM x, generate_series(0, 99) g(rep)),
m AS (SELECT r.symbol, rep, avg(v) AS m FROM r JOIN x ON r.symbol = x.symbol AND r.i = x.i GROUP BY ALL) SELECT symbol, count(*) AS replicates, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY symbol""")
def bootstrap_interval(s, d):
    return R.bootstrap(_data(s, d), "ret_15")


@query(DATA + """, w AS (SELECT symbol, ret_15, unnest([k, k - 1, k - 2]) AS k FROM (SELECT *, date_diff('day', DATE '1970-01-01', d) // 30 AS k FROM data WHERE ret_15 IS NOT NULL))
SELECT symbol, CAST(DATE '1970-01-01' + CAST(k * 30 AS INTEGER) AS DATE) AS start, count(*) AS n, round(avg(ret_15), 6) AS mean, round(avg(CASE WHEN ret_15 > 0 THEN 1 ELSE 0 END) * 100, 4) AS win_pct FROM w GROUP BY ALL HAVING count(*) >= 5""")
def rolling_90_days(s, d):
    return R.rolling_windows(_data(s, d), "ret_15")
