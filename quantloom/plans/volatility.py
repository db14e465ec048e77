"""Registered queries: implied volatility and the decomposition of exposure changes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import volatility as V
from ..sources import adapters as S
from .queries import CHAIN, query

CURVE = CHAIN + """, c AS (SELECT symbol, d, expiry, spot, strike, max(iv_bp) FILTER (option_type = 'CE' AND iv_bp > 0) AS call_iv, max(iv_bp) FILTER (option_type = 'PE' AND iv_bp > 0) AS put_iv FROM chain WHERE option_type <> 'XX' GROUP BY ALL),
curve AS (SELECT *, strike - spot AS distance, round((strike - spot) * 100.0::DOUBLE / spot, 6) AS moneyness_pct FROM c)"""
ATM = CURVE + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol, d, expiry ORDER BY abs(distance), strike) AS r FROM curve),
atm AS (SELECT symbol, d, expiry, strike, call_iv, put_iv, (call_iv + put_iv) / 2.0::DOUBLE AS atm_iv, CASE WHEN call_iv IS NOT NULL AND put_iv IS NOT NULL THEN 'available' WHEN coalesce(call_iv, put_iv) IS NOT NULL THEN 'partial' ELSE 'unavailable' END AS status FROM n WHERE r = 1)"""
FRONT = ATM + ", front AS (SELECT symbol, d, arg_min(atm_iv, expiry) AS iv FROM atm WHERE status = 'available' GROUP BY ALL)"


def _curve(s, d):
    return V.curve(S.chain(s, d))


def _front(s, d):
    return V.front(V.at_the_money(_curve(s, d)))


@query(CURVE + " SELECT * FROM curve")
def iv_curve(s, d):
    return _curve(s, d)


@query(ATM + " SELECT * FROM atm")
def iv_at_the_money(s, d):
    return V.at_the_money(_curve(s, d))


@query(ATM + """, u AS (SELECT *, row_number() OVER (PARTITION BY symbol, d, expiry ORDER BY abs(moneyness_pct - 2), strike) AS up, row_number() OVER (PARTITION BY symbol, d, expiry ORDER BY abs(moneyness_pct + 2), strike) AS down FROM curve),
g AS (SELECT symbol, d, expiry, max(strike) FILTER (up = 1) AS call_strike, max(strike) FILTER (down = 1) AS put_strike, max(call_iv) FILTER (up = 1) AS ci, max(put_iv) FILTER (down = 1) AS pi FROM u GROUP BY ALL)
SELECT symbol, d, expiry, call_strike, put_strike, round((ci - atm_iv) / 100, 4) AS call_skew, round((pi - atm_iv) / 100, 4) AS put_skew FROM g JOIN atm USING (symbol, d, expiry)""")
def iv_skew(s, d):
    curve = _curve(s, d)
    return V.skew(curve, V.at_the_money(curve))


@query(ATM + """, t AS (SELECT symbol, d, CAST(expiry - d AS INTEGER) AS dte, atm_iv FROM atm WHERE status = 'available')
SELECT *, round((lead(atm_iv) OVER w - atm_iv) / ((lead(dte) OVER w - dte) * 100.0::DOUBLE), 6) AS slope FROM t WINDOW w AS (PARTITION BY symbol, d ORDER BY dte)""")
def iv_term_structure(s, d):
    return V.term_structure(V.at_the_money(_curve(s, d)))


@query(FRONT + """, x AS (SELECT *, list(iv) OVER (PARTITION BY symbol ORDER BY d ROWS 59 PRECEDING) AS seen FROM front)
SELECT symbol, d, iv, CASE WHEN len(seen) >= 30 THEN round(len(list_filter(seen, lambda v: v <= iv))::DOUBLE / len(seen), 6) END AS iv_rank, CASE WHEN len(seen) >= 30 THEN round(len(list_filter(seen, lambda v: v < iv))::DOUBLE / len(seen) * 100, 6) END AS iv_percentile FROM x""")
def iv_rank(s, d):
    return V.rank(_front(s, d))


@query(FRONT + """, x AS (SELECT *, lag(iv) OVER (PARTITION BY symbol ORDER BY d) AS b FROM front) SELECT symbol, d, round((iv - b) / 10000, 8) AS change, round((iv - b) / 100, 6) AS vol_points, round((iv - b) * 100 / b, 6) AS change_pct FROM x""")
def iv_changes(s, d):
    return V.changes(_front(s, d))


@query(FRONT + """, sp AS (SELECT DISTINCT symbol, d, spot FROM chain), x AS (SELECT symbol, d, iv - lag(iv) OVER w AS a, CAST(spot - lag(spot) OVER w AS DOUBLE) AS b FROM front JOIN sp USING (symbol, d) WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS r FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY symbol""")
def iv_price_correlation(s, d):
    w = Window.partitionBy("symbol").orderBy("d")
    x = _front(s, d).join(S.chain(s, d).select("symbol", "d", "spot").distinct(), ["symbol", "d"])
    return V.correlation(x.select("symbol", (F.col("iv") - F.lag("iv").over(w)).alias("a"), (F.col("spot") - F.lag("spot").over(w)).cast("double").alias("b")), "a", "b", "symbol")


def _gamma(iv: str) -> str:
    s = f"({iv} / 10000.0::DOUBLE)"
    t = "(1::DOUBLE / 52)"
    d1 = f"((ln(spot0 / strike) + {s} * {s} / 2 * {t}) / ({s} * sqrt({t})))"
    return f"(exp(-{d1} * {d1} / 2) / sqrt(2 * pi()) / (spot0 * {s} * sqrt({t})))"


@query(CHAIN + f""", sn AS (SELECT symbol, d, spot, strike, max(gamma_c) FILTER (option_type = 'CE') AS cg, max(gamma_c) FILTER (option_type = 'PE') AS pg, coalesce(CAST(sum(oi) FILTER (option_type = 'CE') AS BIGINT), 0) AS co, coalesce(CAST(sum(oi) FILTER (option_type = 'PE') AS BIGINT), 0) AS po,
  max(iv_bp) FILTER (option_type = 'CE') AS ci, max(iv_bp) FILTER (option_type = 'PE') AS pi FROM chain WHERE option_type <> 'XX' AND oi > 0 GROUP BY ALL),
t AS (SELECT symbol, d, spot, CAST(sum((coalesce(cg * co, 0) - coalesce(pg * po, 0)) * spot * spot) AS BIGINT) AS net_c FROM sn GROUP BY ALL), tt AS (SELECT *, lag(d) OVER w AS d0, lag(spot) OVER w AS spot0, lag(net_c) OVER w AS net0 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY d)),
j AS (SELECT tt.symbol, tt.d, tt.net_c, tt.net0, tt.spot, CAST(tt.spot0 AS DOUBLE) AS spot0, b.strike, b.co, b.po, b.ci, b.pi, a.cg AS cg0, a.pg AS pg0, a.co AS co0, a.po AS po0, a.ci AS ci0, a.pi AS pi0
  FROM tt JOIN sn b ON b.symbol = tt.symbol AND b.d = tt.d LEFT JOIN sn a ON a.symbol = tt.symbol AND a.d = tt.d0 AND a.strike = b.strike WHERE net0 IS NOT NULL),
p AS (SELECT symbol, d, (net_c - net0) * 1e-4::DOUBLE AS total, coalesce(sum((coalesce(cg0 * co0, 0) - coalesce(pg0 * po0, 0)) * (spot * spot - spot0 * spot0)) * 1e-4::DOUBLE, 0) AS by_spot,
  sum(coalesce((co - co0) * {_gamma("ci0")} * spot0 * spot0 * 0.01::DOUBLE, 0) - coalesce((po - po0) * {_gamma("pi0")} * spot0 * spot0 * 0.01::DOUBLE, 0)) AS by_oi,
  sum(coalesce(co * ({_gamma("ci")} - {_gamma("ci0")}) * spot0 * spot0 * 0.01::DOUBLE, 0) - coalesce(po * ({_gamma("pi")} - {_gamma("pi0")}) * spot0 * spot0 * 0.01::DOUBLE, 0)) AS by_iv FROM j GROUP BY symbol, d, net_c, net0)
SELECT symbol, d, round(total, 4) AS total, round(by_spot, 4) AS by_spot, round(by_oi, 4) AS by_oi, round(by_iv, 4) AS by_iv, round(total - by_spot - by_oi - by_iv, 4) AS residual, round(by_spot * 100 / abs(nullif(total, 0)), 2) AS spot_pct FROM p""")
def gex_decomposition(s, d):
    return V.decompose(V.snapshots(S.chain(s, d)))
