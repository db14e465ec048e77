"""Registered queries: scenarios over strategies and their chain, each with its SQL."""

from __future__ import annotations

from ..operators import scenarios as X
from ..sources import scenarios as S
from .queries import CHAIN, _model, query

#: name -> fields, every rule of precedence among them.
NAMED = {
    "as_is": {}, "spot_first": {"spot": 1500, "spot_pct": 0.5, "spot_points": 9}, "share_next": {"spot_pct": -0.02, "spot_points": 90}, "points": {"spot_points": 25, "days": 3},
    "one_iv": {"iv": 0.3, "iv_shift": 0.5}, "iv_down": {"iv_shift": -0.2}, "no_spot": {"spot_points": -2000}, "week": {"days": 7, "iv_shift": 0.02},
}

LEGS = CHAIN + """, quotes AS (SELECT symbol, strike, option_type AS type, arg_max({'ltp': ltp, 'iv_bp': iv_bp}, (d, ltp, iv_bp)) AS q FROM chain WHERE option_type <> 'XX' AND strike % 350 <> 0 GROUP BY ALL),
marks AS (SELECT symbol, strike, type, CASE WHEN q.ltp % 11 <> 0 THEN q.iv_bp / 10000.0::DOUBLE END AS own, CASE WHEN q.ltp % 13 <> 0 THEN q.ltp::DOUBLE END AS ltp FROM quotes),
legs AS (SELECT o_orderkey AS strategy_id, CASE WHEN o_orderkey % 97 <> 0 THEN 1475.0::DOUBLE END AS base, CASE l_returnflag WHEN 'A' THEN 'CE' ELSE 'PE' END AS type, (CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END) * (1 + l_linenumber % 3) AS scale,
  1000 + 50 * (l_suppkey % 20) AS strike, 5 + l_partkey % 200 AS paid, 7 * (l_partkey % 5) AS days, 'S' || o_custkey % 3 AS symbol FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
listed AS (SELECT l.*, own, ltp, m.symbol IS NULL AS unlisted FROM legs l LEFT JOIN marks m ON l.symbol = m.symbol AND l.strike = m.strike AND l.type = m.type)"""


def _sql(cells: list[tuple[str, dict]]) -> str:
    field = lambda f, k: f"{float(f[k])!r}::DOUBLE" if k in f else "NULL::DOUBLE"
    rows = ", ".join(f"('{n}', {', '.join(field(f, k) for k in X.SCENARIO)})" for n, f in cells)
    return LEGS + f""", cells(scenario, spot_to, pct, points, iv_to, shift, ahead) AS (VALUES {rows}),
x AS (SELECT *, CASE WHEN spot_to IS NOT NULL THEN spot_to WHEN pct IS NOT NULL THEN base * (1 + pct) WHEN points IS NOT NULL THEN base + points ELSE base END AS moved, greatest(days - coalesce(ahead, 0), 0) / 365.0::DOUBLE AS t,
  CASE WHEN iv_to IS NOT NULL THEN greatest(iv_to, 1e-4) WHEN own IS NOT NULL THEN greatest(own + coalesce(shift, 0), 1e-4) END AS vol, CASE type WHEN 'CE' THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM listed, cells),
y AS (SELECT * EXCLUDE (moved), CASE WHEN moved > 0 THEN moved END AS spot FROM x), z AS (SELECT *, CASE WHEN spot IS NULL OR vol IS NULL THEN NULL WHEN t <= 0 THEN greatest(s * (spot - strike), 0) ELSE {_model("vol")} END AS unit FROM y),
told AS (SELECT strategy_id, scenario, count(*) AS legs, count(*) FILTER (unit IS NULL) AS unpriced, count(*) FILTER (unlisted) AS unlisted, min(days) <> max(days) AS mixed_expiry, count(*) FILTER (unit IS NULL) > 0 AS partial, round(any_value(spot), 4) + 0.0 AS spot,
  CASE WHEN any_value(spot) IS NOT NULL THEN round(coalesce(sum(scale * unit), 0), 4) + 0.0 END AS value, CASE WHEN count(*) FILTER (ltp IS NULL) = 0 THEN round(coalesce(sum(scale * ltp), 0), 4) + 0.0 END AS now,
  CASE WHEN any_value(spot) IS NOT NULL THEN round(coalesce(sum(scale * (unit - paid)), 0), 4) + 0.0 END AS pnl, CASE WHEN count(*) FILTER (ltp IS NULL) = 0 THEN round(coalesce(sum(scale * (unit - ltp)), 0), 4) + 0.0 END AS change FROM z GROUP BY ALL)"""


def _cells() -> list[tuple[str, dict]]:
    return [(f"{i}:{j}", {"spot_pct": r, "iv_shift": c}) for i, r in enumerate(X.SPOT_STEPS) for j, c in enumerate(X.IV_STEPS)]


@query(_sql(list(NAMED.items())) + " SELECT * FROM told")
def named_scenarios(s, d):
    return X.evaluate(S.scenario_legs(s, d), S.marks(s, d), [X.scenario(n, **f) for n, f in NAMED.items()])


@query(_sql(_cells()) + """ SELECT strategy_id, count(*) AS cells, count(*) FILTER (partial OR pnl IS NULL) AS empty, min(pnl) FILTER (NOT partial) AS worst_pnl, arg_min(scenario, (pnl, scenario)) FILTER (NOT partial AND pnl IS NOT NULL) AS worst_cell,
  max(pnl) FILTER (NOT partial) AS best_pnl, arg_min(scenario, (-pnl, scenario)) FILTER (NOT partial AND pnl IS NOT NULL) AS best_cell FROM told GROUP BY strategy_id""")
def scenario_extremes(s, d):
    return X.extremes(S.scenario_legs(s, d), S.marks(s, d), X.grid())
