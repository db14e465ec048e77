"""Registered queries: contracts of a history, range compression, straddles and added information, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compression as C
from ..operators import factors as R
from ..operators import universe as U
from ..sources import adapters as S
from ..sources import payloads as P
from .factors import FEATURES, HORIZONS, RETURNS
from .queries import CHAIN, query

UNIVERSE = CHAIN + """, known AS (SELECT DISTINCT symbol || '|' || CAST(CAST(expiry - INTERVAL 7 DAY AS DATE) AS VARCHAR) || '|' || strike || '|' || option_type AS instrument, symbol, option_type, strike, CAST(expiry - INTERVAL 7 DAY AS DATE) AS expiry FROM chain WHERE option_type <> 'XX'),
opens AS (SELECT symbol, d AS day, CAST(spot - 2 AS DOUBLE) AS open FROM (SELECT DISTINCT symbol, d, spot FROM chain WHERE dayofyear(d) % 37 <> 0 AND dayofyear(d) % 5 <> 0 AND (symbol <> 'S2' OR year(d) >= 1997))),
monthly AS (SELECT symbol, max(expiry) AS expiry FROM known GROUP BY symbol, strftime(expiry, '%Y-%m')),
backed AS (SELECT m.symbol, m.expiry, arg_min(open, back) AS open, min(back) AS days_back FROM monthly m, range(6) g(back) JOIN opens o ON o.symbol = m.symbol AND o.day = CAST(m.expiry - to_days(CAST(back AS INTEGER)) AS DATE) GROUP BY ALL),
medians AS (SELECT symbol, expiry, list_sort(list(strike))[count(*) // 2 + 1] AS median FROM known SEMI JOIN monthly USING (symbol, expiry) WHERE strike > 0 GROUP BY ALL),
money AS (SELECT m.symbol, m.expiry, CAST(round_even(coalesce(open, median) / 25, 0) * 25 AS BIGINT) AS atm, CASE WHEN days_back = 0 THEN 'EXACT' WHEN days_back > 0 THEN 'LOOKBACK' ELSE 'MEDIAN' END AS source, CAST(days_back AS INTEGER) AS days_back FROM monthly m LEFT JOIN backed USING (symbol, expiry) LEFT JOIN medians USING (symbol, expiry)),
chosen AS (SELECT symbol, expiry, atm, source, days_back, instrument, option_type, strike, 50 AS lot_size FROM known JOIN money USING (symbol, expiry) WHERE strike BETWEEN atm - 500 AND atm + 500)"""


def _chosen(s, d):
    bars = P.index_bars(s, d).withColumnRenamed("close", "open").filter((F.dayofyear("open_time") % 5 != 0) & ((F.col("symbol") != "S2") | (F.year("open_time") >= 1997)))
    return U.tier_one(P.contracts(s, d), U.first_opens(bars))


@query(UNIVERSE + " SELECT * FROM chosen")
def tier_one_contracts(s, d):
    return _chosen(s, d)


@query(UNIVERSE + """ SELECT symbol, expiry, atm, source, days_back, min(strike) AS lowest, max(strike) AS highest, count(DISTINCT strike) AS strikes, count(*) FILTER (option_type = 'CE') AS calls, count(*) FILTER (option_type = 'PE') AS puts, count(*) AS contracts, count(DISTINCT lot_size) AS lot_sizes
FROM chosen GROUP BY ALL""")
def tier_one_report(s, d):
    return U.selection_report(_chosen(s, d))


RANGES = FEATURES + ", ranged AS (SELECT *, " + ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) = {k} THEN round((max(spot) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) - min(spot) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)) * 100.0::DOUBLE / spot, 4) END AS range_{h}" for h, k in HORIZONS.items()) + " FROM features)"


def _ranged(s, d):
    return C.with_ranges(R.features(S.chain(s, d)), HORIZONS)


@query(RANGES + """, x AS (SELECT symbol, d, abs_gex, range_15m AS range, min(d) OVER (PARTITION BY symbol) AS begin, max(d) OVER (PARTITION BY symbol) AS finish FROM ranged WHERE range_15m IS NOT NULL),
w AS (SELECT x.*, CAST(begin + to_days(CAST(30 * k AS INTEGER)) AS DATE) AS start FROM x, range(400) g(k) WHERE d >= begin + to_days(CAST(30 * k AS INTEGER)) AND d < begin + to_days(CAST(30 * k + 90 AS INTEGER)) AND begin + to_days(CAST(30 * k + 90 AS INTEGER)) <= finish),
l AS (SELECT symbol, start, count(*) AS n, list_sort(list(abs_gex)) AS g FROM w GROUP BY ALL HAVING count(*) >= 20),
o AS (SELECT w.symbol, w.start, n, CAST(sum(CAST(round(range * 10000) AS BIGINT)) FILTER (abs_gex < g[20 * (n - 1) // 100 + 1]) AS DOUBLE) / count(range) FILTER (abs_gex < g[20 * (n - 1) // 100 + 1]) / 10000 AS low, CAST(sum(CAST(round(range * 10000) AS BIGINT)) FILTER (abs_gex > g[80 * (n - 1) // 100 + 1]) AS DOUBLE) / count(range) FILTER (abs_gex > g[80 * (n - 1) // 100 + 1]) / 10000 AS high FROM w JOIN l USING (symbol, start) GROUP BY ALL)
SELECT symbol, start, n, low AS low_range, high AS high_range, low - high AS compression FROM o WHERE low IS NOT NULL AND high IS NOT NULL""")
def compression_windows(s, d):
    return C.stability(_ranged(s, d))


@query(RANGES + """, pairs AS (SELECT symbol, d, strike, expiry, max(ltp) FILTER (option_type = 'CE') AS call, max(ltp) FILTER (option_type = 'PE') AS put, min(spot) AS spot FROM chain WHERE option_type <> 'XX' GROUP BY ALL),
near AS (SELECT symbol, d, arg_min({'c': call, 'p': put}, (abs(strike - spot), strike, expiry)) AS m FROM pairs GROUP BY ALL), sold AS (SELECT symbol, d, m.c + m.p AS premium FROM near WHERE m.c + m.p IS NOT NULL),
x AS (SELECT * FROM ranged JOIN sold USING (symbol, d)), l AS (SELECT symbol, count(*) AS n, list_sort(list(abs_gex)) AS g, arg_min(spot, d) AS first FROM x GROUP BY symbol),
y AS (SELECT x.*, first, CASE WHEN abs_gex > g[80 * (n - 1) // 100 + 1] THEN 'HIGH' WHEN abs_gex < g[20 * (n - 1) // 100 + 1] THEN 'LOW' END AS side FROM x JOIN l USING (symbol)),
z AS (SELECT symbol, side, first, count(*) AS n, CAST(sum(CAST(round(premium * 10000) AS BIGINT)) AS DOUBLE) / count(premium) / 10000 AS p, CAST(sum(CAST(round(range_15m * 10000) AS BIGINT)) AS DOUBLE) / count(range_15m) / 10000 AS a, CAST(sum(CAST(round(range_30m * 10000) AS BIGINT)) AS DOUBLE) / count(range_30m) / 10000 AS b, CAST(sum(CAST(round(range_60m * 10000) AS BIGINT)) AS DOUBLE) / count(range_60m) / 10000 AS c FROM y WHERE side IS NOT NULL GROUP BY ALL)
SELECT symbol, side, n, p AS premium, a AS range_15m, b AS range_30m, c AS range_60m, p * 0.0015::DOUBLE AS cost, p - a / 100 * first AS result, p - a / 100 * first - p * 0.0015::DOUBLE AS result_after_cost FROM z""")
def straddle_study(s, d):
    return C.straddle_study(_ranged(s, d), C.straddles(S.chain(s, d)), tuple(HORIZONS))


GEX_FEATURES = ("net_gex", "gex_change", "flip_distance", "gex_imbalance")
LONG = " UNION ALL ".join(f"SELECT symbol, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, ret_15m AS y, b1, b2, b3, b4, b5, b6 FROM based WHERE {f} IS NOT NULL AND ret_15m IS NOT NULL" for f in GEX_FEATURES)


@query(RETURNS + """, b0 AS (SELECT *, coalesce(round((spot - lag(spot) OVER w) * 100.0::DOUBLE / lag(spot) OVER w, 6), 0) AS b1, coalesce(spot - lag(spot, 3) OVER w, 0) AS b4 FROM data WINDOW w AS (PARTITION BY symbol ORDER BY d)),
based AS (SELECT *, round(coalesce(stddev_samp(b1) OVER w, 0), 6) AS b2, round((max(spot) OVER w - min(spot) OVER w) * 100.0::DOUBLE / spot, 6) AS b3, round((spot - max(spot) OVER w) * 100.0::DOUBLE / max(spot) OVER w, 6) AS b5, round((spot - min(spot) OVER w) * 100.0::DOUBLE / min(spot) OVER w, 6) AS b6 FROM b0 WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 4 PRECEDING)),
long AS (""" + LONG + """), g AS (SELECT symbol, feature, count(*) AS n, greatest(""" + ", ".join(f"pow(corr(b{i}, y), 2)" for i in range(1, 7)) + """) AS base, pow(corr(x, y), 2) AS own FROM long GROUP BY ALL HAVING count(*) >= 50)
SELECT symbol, feature, n, round(base, 8) AS baseline_r2, round(greatest(base, own), 8) AS combined_r2, round(greatest(base, own) - base, 8) AS incremental_r2, greatest(base, own) - base > 0.001 AS adds_information FROM g""")
def added_information(s, d):
    return C.adds_information(C.baseline(R.with_returns(R.features(S.chain(s, d)))), GEX_FEATURES, "ret_15m")
