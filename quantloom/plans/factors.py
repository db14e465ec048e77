"""Registered queries: factor research, each with its SQL."""

from __future__ import annotations

from ..operators import factors as R
from ..sources import adapters as S
from .queries import CHAIN, query

HORIZONS = {"15m": 5, "30m": 10, "60m": 20}
NUMERIC = R.NUMERIC

# strikes by windows where the operator takes arrays
FEATURES = CHAIN + """, rows AS (SELECT *, (CASE WHEN option_type = 'CE' THEN 1 ELSE -1 END) * CASE WHEN spot > 0 AND strike > 0 AND gamma_c >= 0 AND oi > 0 THEN gamma_c * oi * spot * spot END AS g,
  CASE WHEN abs(strike - spot) <= 100 AND iv_bp > 0 THEN iv_bp END AS near_iv FROM chain WHERE option_type IN ('CE', 'PE')),
k AS (SELECT symbol, d, strike, min(spot) AS spot, CAST(sum(g) AS BIGINT) AS net FROM rows GROUP BY ALL HAVING sum(g) IS NOT NULL),
kn AS (SELECT *, lead(strike) OVER w AS k2, CAST(lead(net) OVER w AS DOUBLE) AS g2, CAST(net AS DOUBLE) AS g1 FROM k WINDOW w AS (PARTITION BY symbol, d ORDER BY strike)),
kf AS (SELECT *, CASE WHEN g1 * g2 < 0 THEN strike - g1 * (k2 - strike) / (g2 - g1) END AS level FROM kn),
kt AS (SELECT symbol, d, round(arg_min(level, (abs(level - spot), level)) FILTER (level IS NOT NULL), 6) AS gamma_flip, arg_min(strike, (-net, strike)) FILTER (net > 0) AS pos_wall, arg_min(strike, (net, strike)) FILTER (net < 0) AS neg_wall FROM kf GROUP BY ALL),
t AS (SELECT symbol, d, min(spot) AS spot, CAST(sum(abs(g)) AS BIGINT) AS abs_gex, CAST(coalesce(sum(g) FILTER (option_type = 'CE'), 0) AS BIGINT) AS ce_gex, CAST(coalesce(sum(g) FILTER (option_type = 'PE'), 0) AS BIGINT) AS pe_gex,
  CAST(coalesce(sum(oi) FILTER (option_type = 'CE'), 0) AS BIGINT) AS call_oi, CAST(coalesce(sum(oi) FILTER (option_type = 'PE'), 0) AS BIGINT) AS put_oi, CAST(coalesce(sum(ltp) FILTER (option_type = 'CE'), 0) AS BIGINT) AS call_vol, CAST(coalesce(sum(ltp) FILTER (option_type = 'PE'), 0) AS BIGINT) AS put_vol,
  avg(near_iv) FILTER (option_type = 'CE') AS ce_iv, avg(near_iv) FILTER (option_type = 'PE') AS pe_iv FROM rows GROUP BY ALL HAVING sum(g) IS NOT NULL),
u AS (SELECT *, ce_gex + pe_gex AS net_gex, call_oi + put_oi AS total_oi, call_vol + put_vol AS total_vol, (ce_iv + pe_iv) / 2 AS atm_iv FROM t JOIN kt USING (symbol, d)),
v AS (SELECT *, row_number() OVER w - 1 AS idx, coalesce(net_gex - lag(net_gex) OVER w, 0) AS gex_change, coalesce(CASE WHEN lag(net_gex) OVER w <> 0 THEN CAST(net_gex - lag(net_gex) OVER w AS DOUBLE) * 100.0::DOUBLE / CAST(abs(lag(net_gex) OVER w) AS DOUBLE) END, 0) AS gex_change_pct,
  coalesce(net_gex - 2 * lag(net_gex) OVER w + lag(net_gex, 2) OVER w, 0) AS gex_acceleration, coalesce(spot - lag(spot) OVER w, 0) AS price_momentum, coalesce(CAST(spot - lag(spot) OVER w AS DOUBLE) * 100.0::DOUBLE / lag(spot) OVER w, 0) AS price_momentum_pct,
  coalesce(spot - 2 * lag(spot) OVER w + lag(spot, 2) OVER w, 0) AS price_acceleration, coalesce(total_oi - lag(total_oi) OVER w, 0) AS oi_change, coalesce(call_oi - lag(call_oi) OVER w, 0) AS call_oi_change, coalesce(put_oi - lag(put_oi) OVER w, 0) AS put_oi_change,
  atm_iv - lag(atm_iv) OVER w AS iv_change, CASE WHEN net_gex > 0 THEN 'POS_GAMMA' WHEN net_gex < 0 THEN 'NEG_GAMMA' ELSE 'NEUTRAL' END AS regime FROM u WINDOW w AS (PARTITION BY symbol ORDER BY d)),
features AS (SELECT symbol, d, CAST(idx AS INTEGER) AS idx, spot, net_gex, abs_gex, ce_gex, pe_gex, CASE WHEN pe_gex <> 0 THEN abs(CAST(ce_gex AS DOUBLE) / CAST(pe_gex AS DOUBLE)) END AS ce_pe_ratio, CASE WHEN abs_gex > 0 THEN CAST(net_gex AS DOUBLE) / CAST(abs_gex AS DOUBLE) ELSE 0 END AS gex_imbalance,
  CASE WHEN abs_gex > 0 THEN CAST(greatest(ce_gex, 0) AS DOUBLE) / CAST(abs_gex AS DOUBLE) ELSE 0 END AS pos_conc, CASE WHEN abs_gex > 0 THEN CAST(abs(least(pe_gex, 0)) AS DOUBLE) / CAST(abs_gex AS DOUBLE) ELSE 0 END AS neg_conc, regime, gex_change, gex_change_pct, gex_acceleration,
  price_momentum, price_momentum_pct, price_acceleration, total_oi, call_oi, put_oi, CASE WHEN put_oi > 0 THEN CAST(call_oi AS DOUBLE) / CAST(put_oi AS DOUBLE) END AS oi_ratio, total_vol, call_vol, put_vol, CASE WHEN total_oi > 0 THEN CAST(total_vol AS DOUBLE) / CAST(total_oi AS DOUBLE) END AS vol_oi_ratio,
  oi_change, call_oi_change, put_oi_change, CASE WHEN oi_change > 0 AND price_momentum > 0 THEN 'LONG_BUILDUP' WHEN oi_change > 0 AND price_momentum < 0 THEN 'SHORT_BUILDUP' WHEN oi_change < 0 AND price_momentum > 0 THEN 'SHORT_COVERING' WHEN oi_change < 0 AND price_momentum < 0 THEN 'LONG_UNWINDING' ELSE 'NEUTRAL' END AS oi_class,
  ce_iv, pe_iv, atm_iv, pe_iv - ce_iv AS iv_skew, iv_change, gamma_flip, round(gamma_flip - spot, 6) AS flip_distance, pos_wall, neg_wall, pos_wall - spot AS pos_wall_dist, CAST(pos_wall - spot AS DOUBLE) * 100.0::DOUBLE / spot AS pos_wall_dist_pct, neg_wall - spot AS neg_wall_dist, CAST(neg_wall - spot AS DOUBLE) * 100.0::DOUBLE / spot AS neg_wall_dist_pct,
  CASE WHEN price_momentum = 0 THEN 0 WHEN (gex_change > 0 AND price_momentum > 0) OR (gex_change < 0 AND price_momentum < 0) THEN 1 ELSE -1 END AS gex_momentum_align,
  CASE WHEN regime = 'NEG_GAMMA' AND price_momentum < 0 THEN 'NEG_GAMMA_DOWN' WHEN regime = 'POS_GAMMA' AND price_momentum > 0 THEN 'POS_GAMMA_UP' WHEN regime = 'NEG_GAMMA' AND price_momentum > 0 THEN 'NEG_GAMMA_UP' WHEN regime = 'POS_GAMMA' AND price_momentum < 0 THEN 'POS_GAMMA_DOWN' ELSE 'NEUTRAL' END AS regime_momentum FROM v)"""
RETURNS = FEATURES + ", data AS (SELECT *, " + ", ".join(f"round((lead(spot, {k}) OVER w - spot) * 100.0::DOUBLE / spot, 4) AS ret_{h}" for h, k in HORIZONS.items()) + " FROM features WINDOW w AS (PARTITION BY symbol ORDER BY d))"
TEST = """, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) ELSE 0 END AS t, CASE WHEN sd > 0 THEN round(m / sd, 6) ELSE 0 END AS effect"""
P = """round(CASE WHEN n < 2 THEN 1.0::DOUBLE WHEN n > 31 THEN least(2 * CASE WHEN abs(t) > 0 THEN exp(-0.5::DOUBLE * abs(t) * abs(t)) / (abs(t) * sqrt(2 * pi())) ELSE 0.5::DOUBLE END, 1.0::DOUBLE)
  WHEN abs(t) > 4 THEN 0.001 WHEN abs(t) > 3 THEN 0.005 WHEN abs(t) > 2.5 THEN 0.02 WHEN abs(t) > 2.0 THEN 0.05 WHEN abs(t) > 1.5 THEN 0.15 ELSE 0.3 END, 8) AS p_value"""
MOMENTS = "count(*) AS n, CAST(sum(CAST(round(ret * 10000) AS BIGINT)) AS DOUBLE) / count(ret) / 10000 AS m, stddev_samp(ret) AS sd, round(avg(CASE WHEN ret > 0 THEN 100.0::DOUBLE ELSE 0 END), 8) AS win_pct"


def _rows(s, d):
    return R.with_returns(R.features(S.chain(s, d)))


@query(FEATURES + " SELECT * FROM features")
def factor_features(s, d):
    return R.features(S.chain(s, d))


def _screen_sql() -> str:
    numeric = " UNION ALL ".join(f"SELECT symbol, d, '{h}' AS horizon, '{c}' AS feature, NULL AS cls, CAST({c} AS DOUBLE) AS value, ret_{h} AS ret FROM data WHERE {c} IS NOT NULL AND ret_{h} IS NOT NULL" for h in HORIZONS for c in R.NUMERIC)
    grouped = " UNION ALL ".join(f"SELECT symbol, d, '{h}', '{c}', {c}, NULL, ret_{h} FROM data WHERE ret_{h} IS NOT NULL" for h in HORIZONS for c in R.GROUPED)
    return f""", long AS ({numeric} UNION ALL {grouped}), ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon, feature, cls ORDER BY value, d) - 1 AS i, count(*) OVER (PARTITION BY symbol, horizon, feature, cls) AS total FROM long),
kept AS (SELECT *, i >= 3 * total // 4 AS top FROM ranked WHERE CASE WHEN cls IS NULL THEN total >= 20 AND (i < total // 4 OR i >= 3 * total // 4) ELSE total >= 10 END),
g AS (SELECT symbol, horizon, feature, cls, {MOMENTS}, CAST(sum(CAST(round(ret * 10000) AS BIGINT)) FILTER (cls IS NULL AND NOT top) AS DOUBLE) / count(ret) FILTER (cls IS NULL AND NOT top) / 10000 AS a1, CAST(sum(CAST(round(ret * 10000) AS BIGINT)) FILTER (cls IS NULL AND top) AS DOUBLE) / count(ret) FILTER (cls IS NULL AND top) / 10000 AS a4 FROM kept GROUP BY ALL), t1 AS (SELECT *{TEST} FROM g), t2 AS (SELECT *, {P} FROM t1),
t3 AS (SELECT *, least(p_value * count(*) OVER (PARTITION BY symbol) / row_number() OVER w, 1.0::DOUBLE) AS raw, row_number() OVER w AS place FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY p_value, horizon, feature, coalesce(cls, '')))
SELECT symbol, horizon, feature, cls, n, a1 AS q1_mean, a4 AS q4_mean, coalesce(a4 - a1, m) AS spread, m AS mean, win_pct, round(t, 6) AS t_stat, p_value,
  round(min(raw) OVER (PARTITION BY symbol ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS adj_p_value, effect FROM t3"""


@query(RETURNS + _screen_sql())
def factor_screen(s, d):
    return R.screen(_rows(s, d))


MOVE = "CASE WHEN price_momentum > 0 THEN 'UP' WHEN price_momentum < 0 THEN 'DOWN' ELSE 'FLAT' END"
FAMILIES = {
    "regime_momentum": (f"regime || '_' || {MOVE}", "true"),
    "align_oi": ("'gma=' || gex_momentum_align || '_oi=' || oi_class", "true"),
    "regime_iv": ("regime || '_' || CASE WHEN iv_change > 0.001 THEN 'IV_UP' WHEN iv_change < -0.001 THEN 'IV_DOWN' ELSE 'IV_FLAT' END", "iv_change IS NOT NULL"),
    "positive_wall": (f"'NEAR_POS_WALL_' || {MOVE}", "abs(pos_wall_dist_pct) < 0.5"),
    "negative_wall": (f"'NEAR_NEG_WALL_' || {MOVE}", "abs(neg_wall_dist_pct) < 0.5"),
    "regime_flip": ("regime || '_' || CASE WHEN abs(flip_distance) < 30 THEN 'NEAR_FLIP' WHEN flip_distance > 0 THEN 'ABOVE_FLIP' ELSE 'BELOW_FLIP' END", "flip_distance IS NOT NULL"),
}


@query(RETURNS + ", long AS (" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS family, {g} AS grp, ret_15m AS ret FROM data WHERE ret_15m IS NOT NULL AND {when}" for n, (g, when) in FAMILIES.items()) + f"""), g AS (SELECT symbol, family, grp, {MOMENTS} FROM long GROUP BY ALL), t1 AS (SELECT *{TEST} FROM g)
SELECT symbol, family, grp, n, m AS mean, win_pct, round(t, 6) AS t_stat, {P} FROM t1 WHERE n >= CASE WHEN family LIKE '%wall' THEN 5 ELSE 10 END""")
def factor_combinations(s, d):
    return R.combinations(_rows(s, d))


def _interaction_sql(a: str, b: str, ret: str) -> str:
    level = "CASE WHEN {0} <= t1{0} THEN 'L' WHEN {0} >= t2{0} THEN 'H' ELSE 'M' END".format
    counts = ", ".join(f"count(*) FILTER (cell = '{p}{q}') AS n_{p.lower()}{q.lower()}" for p in "LMH" for q in "LMH")
    mean = "coalesce(CAST(sum(CAST(round(ret * 10000) AS BIGINT)) FILTER (cell = '{0}') AS DOUBLE) / count(ret) FILTER (cell = '{0}') / 10000, 0)".format
    return f""", p AS (SELECT symbol, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, {ret} AS ret FROM data WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {ret} IS NOT NULL),
l AS (SELECT symbol, count(*) AS n, list_sort(list(a)) AS sa, list_sort(list(b)) AS sb FROM p GROUP BY symbol HAVING count(*) >= 50), c AS (SELECT symbol, n, sa[n // 3 + 1] AS t1a, sa[2 * n // 3 + 1] AS t2a, sb[n // 3 + 1] AS t1b, sb[2 * n // 3 + 1] AS t2b FROM l),
x AS (SELECT *, {level("a")} || {level("b")} AS cell FROM p JOIN c USING (symbol)), g AS (SELECT symbol, n, t1a, t2a, t1b, t2b, {mean("ML")} - {mean("LL")} AS low, {mean("MH")} - {mean("LH")} AS high, {counts} FROM x GROUP BY ALL)
SELECT * EXCLUDE (low, high), low AS effect_at_low_b, high AS effect_at_high_b, abs(high - low) AS magnitude FROM g"""


@query(RETURNS + _interaction_sql("net_gex", "oi_change", "ret_15m"))
def factor_interaction(s, d):
    return R.interaction(_rows(s, d), "net_gex", "oi_change", "ret_15m")


CANDIDATES = {
    "NEG_GAMMA_UP": "regime = 'NEG_GAMMA' AND price_momentum > 0", "NEG_GAMMA_DOWN": "regime = 'NEG_GAMMA' AND price_momentum < 0", "POS_GAMMA_UP": "regime = 'POS_GAMMA' AND price_momentum > 0", "POS_GAMMA_DOWN": "regime = 'POS_GAMMA' AND price_momentum < 0",
    "LOW_VOL_RANGING": "price_momentum = 0", "IV_EXPANDING": "iv_change > 0.001", "IV_CONTRACTING": "iv_change < -0.001", "HIGH_OI_BUILDUP": "oi_change > 0 AND price_momentum > 0", "SHORT_COVERING": "oi_change < 0 AND price_momentum > 0",
    "GEX_POS_MOM_ALIGN": "gex_momentum_align = 1", "GEX_NEG_MOM_ALIGN": "gex_momentum_align = -1",
}


@query(RETURNS + ", parted AS (SELECT *, CASE WHEN idx < floor(n * 0.6) THEN 'Train' WHEN idx < floor(n * 0.8) THEN 'Val' ELSE 'Test' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM data)), long AS (" + " UNION ALL ".join(f"SELECT symbol, part, '{n}' AS candidate, ret_15m AS ret FROM parted WHERE ret_15m IS NOT NULL AND {when}" for n, when in CANDIDATES.items()) + f"""),
g AS (SELECT symbol, candidate, part, {MOMENTS} FROM long GROUP BY ALL), t1 AS (SELECT *{TEST} FROM g), t2 AS (SELECT *, {P} FROM t1)
SELECT symbol, candidate, part, n, n >= 5 AS sufficient, CASE WHEN n >= 5 THEN m END AS mean, CASE WHEN n >= 5 THEN win_pct END AS win_pct, CASE WHEN n >= 5 THEN round(t, 6) END AS t_stat, CASE WHEN n >= 5 THEN p_value END AS p_value FROM t2""")
def factor_walk_forward(s, d):
    return R.walk_forward(_rows(s, d))


def _bootstrap_sql(by: str, block: int, replicates: int, least: int) -> str:
    """Row by row: every drawn row is looked up, none by sums."""
    low, high = int(0.025 * replicates), int(0.975 * replicates) - 1
    return f""", x AS (SELECT {by}, CAST(round(v * 10000) AS BIGINT) AS v, row_number() OVER (PARTITION BY {by} ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM series WHERE v IS NOT NULL),
s AS (SELECT {by}, n, sum(v) AS total FROM x GROUP BY ALL), r AS (SELECT {by}, n, rep, b FROM s, generate_series(0, {replicates - 1}) g(rep), LATERAL (SELECT unnest(range(CAST(ceil(n / {block}::DOUBLE) AS BIGINT))) AS b) WHERE n >= {least}),
w AS (SELECT {by}, n, rep, b * {block} + o AS place, ('0x' || substr(md5(rep || ':' || b), 1, 8))::BIGINT % (n - {block - 1}) + o AS i FROM r, range({block}) k(o)),
m AS (SELECT {", ".join("w." + c for c in by.split(", "))}, rep, CAST(sum(x.v) AS DOUBLE) / any_value(w.n) / 10000 AS m FROM w JOIN x ON {" AND ".join(f"w.{c} = x.{c}" for c in by.split(", "))} AND w.i = x.i WHERE place < w.n GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY m, rep) - 1 AS place FROM m), told AS (SELECT {by}, max(m) FILTER (place = {low}) AS ci_low, max(m) FILTER (place = {high}) AS ci_high, round(stddev_samp(m), 6) AS se FROM o GROUP BY {by})
SELECT {by}, n, CAST(total AS DOUBLE) / n / 10000 AS mean, ci_low, ci_high, se FROM s LEFT JOIN told USING ({by})"""


@query(RETURNS + ", series AS (SELECT symbol, d, ret_15m AS v FROM data)" + _bootstrap_sql("symbol", 2, 2000, 4))
def block_bootstrap_mean(s, d):
    return R.block_bootstrap(_rows(s, d), "ret_15m", ["symbol"], "d")


@query(RETURNS + ", series AS (SELECT symbol, regime_momentum, d, ret_30m AS v FROM data)" + _bootstrap_sql("symbol, regime_momentum", 5, 500, 10))
def block_bootstrap_by_regime(s, d):
    return R.block_bootstrap(_rows(s, d), "ret_30m", ["symbol", "regime_momentum"], "d", block=5, replicates=500)


@query(RETURNS + ", series AS (SELECT symbol, oi_class, d, ret_60m AS v FROM data)" + _bootstrap_sql("symbol, oi_class", 1, 1000, 10))
def row_bootstrap_interval(s, d):
    return R.block_bootstrap(_rows(s, d), "ret_60m", ["symbol", "oi_class"], "d", block=1, replicates=1000, least=10)
