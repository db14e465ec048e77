"""Registered queries: strike and expiry resolution, leg prices, payoff metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strategy
from ..sources import adapters as S
from .queries import CHAIN, _cdf, query

#: leg, strike mode, value, expiry mode, side
FORMULAS = [
    (0, "fixed", 1500, "fixed", "CE"), (1, "fixed", 1510, "current_week", "CE"), (2, "atm", 0, "next_week", "PE"), (3, "atm_offset_steps", 3, "monthly", "CE"), (4, "atm_offset_steps", -30, "dte_range", "PE"),
    (5, "atm_offset", 120, "current_week", "CE"), (6, "spot_offset", -80, "fixed", "PE"), (7, "delta", 300, "current_week", "CE"), (8, "delta", 5000, "monthly", "CE"), (9, "delta", -60, "next_week", "PE"),
]
NEAR = "list_sort(list_transform(strikes, lambda k: {{'far': abs(k - ({0})), 'k': k}}))[1].k"
LEGS = CHAIN + f""", days AS (SELECT symbol, d, spot, list_sort(list(DISTINCT strike)) AS strikes, list_sort(list(DISTINCT expiry)) AS expiries FROM chain WHERE option_type <> 'XX' GROUP BY ALL),
f(leg, mode, value, expiry_mode, side) AS (VALUES {", ".join(f"({a}, '{m}', {v}, '{e}', '{s}')" for a, m, v, e, s in FORMULAS)}),
x AS (SELECT *, {NEAR.format("spot")} AS atm, CAST(d + CAST(10 * (day(d) % 4) AS INTEGER) AS DATE) AS today, list_sort(list_transform(strikes, lambda k: {{'o': abs(500 + spot - k - value), 'far': abs(k - spot), 'k': k}}))[1] AS best FROM days, f),
y AS (SELECT *, list_position(strikes, atm) + value AS pos, list_filter(expiries, lambda e: e >= today) AS ahead, list_filter(expiries, lambda e: date_trunc('month', e) > date_trunc('month', today)) AS later FROM x),
z AS (SELECT *, CASE mode WHEN 'fixed' THEN CASE WHEN list_contains(strikes, value) THEN value END WHEN 'atm' THEN atm WHEN 'atm_offset_steps' THEN strikes[greatest(least(pos, len(strikes)), 1)] WHEN 'atm_offset' THEN {NEAR.format("atm + value")}
  WHEN 'spot_offset' THEN {NEAR.format("spot + value")} ELSE CASE WHEN best.o <= 200 THEN best.k END END AS strike,
  CASE mode WHEN 'atm_offset_steps' THEN CASE WHEN pos < 1 OR pos > len(strikes) THEN 'CLAMPED' END WHEN 'atm_offset' THEN CASE WHEN NOT list_contains(strikes, atm + value) THEN 'NORMALISED' END WHEN 'spot_offset' THEN CASE WHEN NOT list_contains(strikes, spot + value) THEN 'NORMALISED' END
  WHEN 'delta' THEN CASE WHEN best.o > 100 AND best.o <= 200 THEN 'DELTA_OFF' END END AS warning,
  CASE expiry_mode WHEN 'fixed' THEN CASE WHEN list_contains(expiries, CAST(d + 14 AS DATE)) THEN CAST(d + 14 AS DATE) END WHEN 'current_week' THEN coalesce(ahead[1], list_sort(list_transform(expiries, lambda e: {{'far': abs(e - today), 'e': e}}))[1].e) WHEN 'next_week' THEN ahead[2]
  WHEN 'monthly' THEN coalesce(list_max(list_filter(expiries, lambda e: date_trunc('month', e) = date_trunc('month', today))), list_max(list_filter(later, lambda e: date_trunc('month', e) = date_trunc('month', list_min(later)))))
  ELSE list_max(list_filter(expiries, lambda e: e - today BETWEEN 5 AND 15)) END AS expiry FROM y),
legs AS (SELECT symbol, d, CAST(leg AS INTEGER) AS leg, side, CAST(strike AS BIGINT) AS strike, expiry, warning, CASE WHEN strike IS NULL THEN CASE mode WHEN 'fixed' THEN 'STRIKE_UNAVAILABLE' ELSE 'DELTA_TOO_FAR' END WHEN expiry IS NULL THEN 'EXPIRY_UNAVAILABLE' ELSE 'RESOLVED' END AS status FROM z)"""


def _legs(s, d):
    return strategy.resolve_legs(strategy.listed(S.chain(s, d)), FORMULAS)


@query(LEGS + " SELECT * FROM legs")
def resolve_legs(s, d):
    return _legs(s, d)


@query(LEGS + """, p AS (SELECT *, lag(strike) OVER w AS k0, lag(expiry) OVER w AS e0 FROM legs WINDOW w AS (PARTITION BY symbol, leg ORDER BY d))
SELECT symbol, d, leg, CASE WHEN strike IS DISTINCT FROM k0 AND expiry IS DISTINCT FROM e0 THEN 'CHANGED_BOTH' WHEN strike IS DISTINCT FROM k0 THEN 'CHANGED_STRIKE' WHEN expiry IS DISTINCT FROM e0 THEN 'CHANGED_EXPIRY' ELSE 'UNCHANGED' END AS change,
  strike - k0 AS strike_move, coalesce(abs(strike - k0) >= 50, false) AS material FROM p""")
def compare_resolutions(s, d):
    return strategy.compare_resolutions(_legs(s, d))


@query(LEGS + """, p AS (SELECT symbol, d, expiry, strike, option_type AS side, min(ltp) AS price FROM chain WHERE ltp > 0 GROUP BY ALL)
SELECT l.symbol, l.d, leg, price, CASE WHEN price IS NULL THEN 'NO_PRICE' ELSE 'PRICED' END AS status FROM legs l LEFT JOIN p ON l.symbol = p.symbol AND l.d = p.d AND l.expiry = p.expiry AND l.strike = p.strike AND l.side = p.side WHERE l.status = 'RESOLVED'""")
def leg_chain_prices(s, d):
    return strategy.chain_prices(_legs(s, d), S.chain(s, d))


@query(CHAIN + """, x AS (SELECT symbol, d, spot, expiry, strike, min(ltp) FILTER (option_type = 'CE' AND ltp > 0) AS ce, min(ltp) FILTER (option_type = 'PE' AND ltp > 0) AS pe FROM chain WHERE option_type <> 'XX' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY abs(strike - spot), strike, expiry) AS n FROM x) SELECT symbol, d, expiry, strike, ce + pe AS straddle FROM r WHERE n = 1 AND ce IS NOT NULL AND pe IS NOT NULL""")
def atm_straddle(s, d):
    return strategy.atm_straddle(S.chain(s, d))


@query(CHAIN + """, k AS (SELECT DISTINCT symbol, d, expiry, spot, strike FROM chain WHERE option_type <> 'XX'), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, d, expiry ORDER BY strike) AS i FROM k),
a AS (SELECT symbol, d, expiry, arg_min(i, (abs(strike - spot), strike)) AS pos FROM r GROUP BY ALL) SELECT r.symbol, r.d, r.expiry, strike, i - pos AS step FROM r JOIN a USING (symbol, d, expiry) WHERE abs(i - pos) <= 2""")
def around_the_money(s, d):
    return strategy.around_the_money(S.chain(s, d))


LEG_ROWS = """l AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS leg, CASE l_returnflag WHEN 'A' THEN 'CE' ELSE 'PE' END AS type, CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END AS sign, CAST(1000 + 50 * (l_suppkey % 20) AS BIGINT) AS strike,
  CAST(1 + l_linenumber % 3 AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) * 700 + 500 AS premium_c, l_partkey % 4 = 0 AS far FROM lineitem)"""


@query(LEG_ROWS + """ SELECT id AS strategy_id, leg, price, sign * (greatest(CASE type WHEN 'CE' THEN price - strike ELSE strike - price END, 0) * 100 - premium_c) * qty AS pnl_c FROM l, generate_series(900, 2100, 300) g(price)""")
def leg_payoffs(s, d):
    return strategy.leg_payoffs(S.strategies(s, d), 900, 2100, 300)


@query(LEG_ROWS + """, p AS (SELECT DISTINCT id, strike AS p FROM l UNION SELECT DISTINCT id, 0 FROM l),
v AS (SELECT p.id, p.p, CAST(sum(sign * (greatest(CASE type WHEN 'CE' THEN p.p - strike ELSE strike - p.p END, 0) * 100 - premium_c) * qty) AS BIGINT) AS v FROM p JOIN l USING (id) GROUP BY p.id, p.p),
t AS (SELECT id, count(*) AS legs, count(DISTINCT far) > 1 AS mixed_expiry, CAST(sum(sign * premium_c * qty) AS BIGINT) AS net_c, CAST(coalesce(sum(premium_c * qty) FILTER (sign = 1), 0) AS BIGINT) AS outlay_c, CAST(coalesce(sum(sign * qty) FILTER (type = 'CE'), 0) AS BIGINT) AS slope FROM l GROUP BY id),
n AS (SELECT *, lag(v) OVER w AS before, lead(p) OVER w AS p2, lead(v) OVER w AS v2 FROM v WINDOW w AS (PARTITION BY id ORDER BY p)),
b AS (SELECT id, round(p + (p2 - p) * (-v::DOUBLE / (v2 - v)), 4) AS x FROM n WHERE v * v2 < 0 UNION ALL SELECT id, p::DOUBLE FROM n JOIN t USING (id) WHERE v = 0 AND (coalesce(before, 0) <> 0 OR coalesce(v2, v + slope * 100) <> 0)
  UNION ALL SELECT id, round(p - v / (slope * 100.0::DOUBLE), 4) FROM n JOIN t USING (id) WHERE p2 IS NULL AND v * slope < 0),
e AS (SELECT id, list_sort(list(x)) AS breakevens FROM b GROUP BY id), m AS (SELECT id, max(v) AS max_c, min(v) AS min_c FROM v GROUP BY id)
SELECT id AS strategy_id, legs, mixed_expiry, net_c, outlay_c, max_c, min_c, slope > 0 AS unlimited_profit, slope < 0 AS unlimited_loss, coalesce(breakevens, []) AS breakevens, round(CASE WHEN slope = 0 AND min_c < 0 THEN max_c::DOUBLE / -min_c END, 4) AS reward_risk,
  round(CASE WHEN slope <= 0 AND net_c > 0 THEN max_c * 100.0::DOUBLE / net_c END, 4) AS roi_pct, CASE WHEN slope < 0 THEN NULL WHEN legs = 1 AND outlay_c > 0 THEN outlay_c ELSE greatest(-min_c, 0) END AS capital_c
FROM t JOIN m USING (id) LEFT JOIN e USING (id)""")
def strategy_metrics(s, d):
    return strategy.metrics(S.strategies(s, d))


@query(LEG_ROWS + " SELECT id AS strategy_id, leg, 'STRIKE' AS problem FROM l WHERE strike - 1000 <= 0")
def invalid_legs(s, d):
    """Strikes are moved down, so that some are out of range."""
    moved = S.strategies(s, d).withColumn("legs", F.transform("legs", lambda x: x.withField("strike", x["strike"] - 1000)))
    return strategy.validate_legs(moved)


DELTAS = [("CE", 500), ("CE", 250), ("PE", -300), ("PE", -950)]


@query(CHAIN + f""", q AS (SELECT symbol, d, expiry, strike, option_type, spot, avg(iv_bp) / 10000 AS sigma, CAST(date_diff('day', d, expiry) AS DOUBLE) / 365 AS t FROM chain WHERE option_type <> 'XX' AND iv_bp > 0 AND expiry > d GROUP BY ALL),
v AS (SELECT *, (ln(spot / strike) + (0.065::DOUBLE + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1 FROM q), w AS (SELECT *, CAST(round(({_cdf("d1")} - CASE option_type WHEN 'PE' THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS delta FROM v),
b AS (SELECT symbol, d, expiry, side, target, arg_min({{'off': abs(delta - target), 'strike': strike, 'delta': delta}}, (abs(delta - target), abs(strike - spot), strike)) AS b FROM w JOIN (VALUES {", ".join(f"('{s}', {v})" for s, v in DELTAS)}) a(side, target) ON side = option_type GROUP BY ALL)
SELECT symbol, d, expiry, side, CAST(target AS INTEGER) AS target, CASE WHEN b.off <= 200 THEN b.strike END AS strike, CASE WHEN b.off <= 200 THEN b.delta END AS delta, CASE WHEN b.off > 200 THEN 'DELTA_TOO_FAR' WHEN b.off > 100 THEN 'DELTA_OFF' ELSE 'RESOLVED' END AS status FROM b""")
def strikes_by_delta(s, d):
    return strategy.strikes_by_delta(S.chain(s, d), DELTAS)
