"""Registered queries: bar features and outcomes, anomalies, local walls, grids and sweeps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..sources import adapters as S
from .queries import BARS, CHAIN, DAILY, STRIKES, _bars, _daily, _strikes, query


@query(BARS + """, r AS (SELECT *, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS r, lag(close) OVER w AS last FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
f AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY open_time) AS r1, count(close) OVER w AS n, stddev_pop(r) OVER w AS sd, max(high) OVER w AS hi, min(low) OVER w AS lo, first(close) OVER w AS c0 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, open_time, round(r1 * 100, 6) AS previous_return, CASE WHEN n = 20 THEN round(sd * 100, 6) END AS realised_vol, CASE WHEN n = 20 THEN round((hi - lo) * 100 / nullif(lo, 0), 6) END AS range_pct, CASE WHEN n = 20 THEN round((last - c0) * 100 / nullif(c0, 0), 6) END AS momentum_pct,
  CASE WHEN n = 20 THEN round((hi - close) * 100 / nullif(close, 0), 6) END AS to_high_pct, CASE WHEN n = 20 THEN round((lo - close) * 100 / nullif(close, 0), 6) END AS to_low_pct FROM f""")
def baseline_features(s, d):
    return X.baseline(_bars(s, d))


@query(BARS + ", h AS (" + " UNION ALL ".join(f"SELECT symbol, open_time, close, {k} AS horizon, count(close) OVER w AS bars, last(close) OVER w AS e, max(high) OVER w AS hi, min(low) OVER w AS lo FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)" for k in (1, 3, 5, 10, 15, 30)) + """)
SELECT symbol, open_time, CAST(horizon AS INTEGER) AS horizon, bars, round((e - close) * 100 / nullif(close, 0), 4) AS ret, CASE WHEN e >= close THEN round((hi - close) * 100 / nullif(close, 0), 4) ELSE -round((lo - close) * 100 / nullif(close, 0), 4) END AS mfe,
  CASE WHEN e >= close THEN round((lo - close) * 100 / nullif(close, 0), 4) ELSE -round((hi - close) * 100 / nullif(close, 0), 4) END AS mae FROM h WHERE bars > 0""")
def forward_outcomes(s, d):
    return X.outcomes(_bars(s, d))


@query(BARS + """, b AS (SELECT symbol, open_time, close FROM bars WHERE close > 0 AND hour(open_time) * 60 + minute(open_time) BETWEEN 555 AND 930)
SELECT e.event_type AS symbol, e.event_id, CASE WHEN CAST(b.open_time AS DATE) = CAST(e.ts AS DATE) THEN b.close END AS spot FROM events e ASOF LEFT JOIN b ON e.event_type = b.symbol AND e.ts >= b.open_time""")
def session_spot(s, d):
    return X.session_as_of(S.table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id"), _bars(s, d), ["symbol"])


@query(DAILY + """, w AS (SELECT symbol, d, net_c, count(net_c) OVER w AS n, avg(net_c) OVER w AS m, stddev_pop(net_c) OVER w AS sd, median(net_c) OVER w AS md, min(net_c) OVER w AS lo, max(net_c) OVER w AS hi FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)),
z AS (SELECT *, CASE WHEN n >= 5 AND sd > 0 THEN (net_c - m) / sd END AS z FROM w) SELECT symbol, d, n, round(m, 6) AS mean, round(md, 6) AS median, lo, hi, round(z, 4) AS z, round(least(abs(z) / 3 * 100, 100), 2) AS magnitude,
  CASE WHEN z IS NULL THEN 'insufficient' WHEN abs(z) >= 3 THEN 'extreme' WHEN abs(z) >= 2 THEN 'unusual' ELSE 'normal' END AS status FROM z""")
def exposure_anomalies(s, d):
    return X.anomalies(_daily(s, d), "net_c")


@query(STRIKES + """, n AS (SELECT *, abs(net_c) AS size FROM strikes WHERE net_c <> 0), m AS (SELECT *, coalesce(lag(size) OVER w, -1) AS l, coalesce(lead(size) OVER w, -1) AS r FROM n WINDOW w AS (PARTITION BY symbol, d ORDER BY strike)),
p AS (SELECT *, CASE WHEN net_c > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS side, CASE WHEN net_c > 0 THEN strike >= spot ELSE strike <= spot END AS own_side FROM m WHERE size >= l AND size >= r AND (size > l OR size > r)),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, d, side ORDER BY own_side DESC, size DESC, strike) AS INTEGER) AS rank FROM p) SELECT symbol, d, side, rank, strike, own_side, net_c FROM q WHERE rank <= 3""")
def local_walls(s, d):
    return X.local_walls(_strikes(s, d))


@query(CHAIN + " SELECT symbol, strftime(expiry, '%Y-%m') AS month, max(expiry) AS expiry FROM chain GROUP BY ALL")
def monthly_expiries(s, d):
    return X.monthly_expiries(S.chain(s, d))


@query(CHAIN + """, x AS (SELECT DISTINCT symbol, d, spot FROM chain) SELECT symbol, d, CAST(step AS INTEGER) AS step, CAST((CASE WHEN spot % 25 < 12.5 THEN spot // 25 WHEN spot % 25 > 12.5 THEN spot // 25 + 1 END) * 25 + step * 25 AS BIGINT) AS strike FROM x, generate_series(-3, 3) g(step)""")
def strike_universe(s, d):
    return X.strike_universe(S.chain(s, d).select("symbol", "d", "spot").distinct())


@query("""r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age FROM events) SELECT user_id, event_id, value, CAST(age AS INTEGER) AS age FROM r WHERE age < 10""")
def ring_buffer(s, d):
    return X.ring(S.table(s, d, "events").select("user_id", "event_id", "value"), 10, "event_id", "user_id")


SWEEP = CHAIN + """, lg AS (SELECT symbol, d, spot, expiry, strike, iv_bp, CAST(sum(CASE option_type WHEN 'CE' THEN oi ELSE -oi END) AS BIGINT) AS oi FROM chain WHERE option_type <> 'XX' AND oi > 0 AND iv_bp > 0 AND expiry > d GROUP BY ALL),
px AS (SELECT *, spot * (0.7::DOUBLE + 0.6::DOUBLE * i / 50) AS at_, CAST(expiry - d AS DOUBLE) / 365 AS t, iv_bp / 10000.0::DOUBLE AS sg FROM lg, generate_series(0, 50) g(i)), pd AS (SELECT *, (ln(at_ / strike) + (0.065::DOUBLE + sg * sg / 2) * t) / (sg * sqrt(t)) AS d1 FROM px),
sweep AS (SELECT symbol, d, spot, i, at_, sum(exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (at_ * sg * sqrt(t)) * oi * at_ * at_ * 0.01::DOUBLE) AS net FROM pd GROUP BY ALL)"""


@query(SWEEP + """, n AS (SELECT *, lead(at_) OVER w AS a2, lead(net) OVER w AS n2, max(abs(net)) OVER (PARTITION BY symbol, d) AS most FROM sweep WINDOW w AS (PARTITION BY symbol, d ORDER BY i)), c AS (SELECT *, at_ + (a2 - at_) * net / (net - n2) AS level FROM n WHERE net * n2 < 0),
k AS (SELECT *, round(0.5 * greatest(1 - abs(level - spot) / (spot * 0.3::DOUBLE), 0) + 0.3 * least(abs(net - n2) / most, 1) + 0.2 * (1 - abs(abs(net) - abs(n2)) / (abs(net) + abs(n2))), 6) AS score FROM c)
SELECT symbol, d, count(*) AS crossings, round(arg_min(level, (-score, level)), 4) AS flip, max(score) AS score FROM k GROUP BY symbol, d""")
def sweep_flips(s, d):
    return X.primary_flip(X.sweep(S.chain(s, d)))
