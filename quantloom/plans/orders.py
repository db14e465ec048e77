"""Registered queries: order life cycles, execution requests and bulk exits, each with its SQL."""

from __future__ import annotations

from ..operators import orders as O
from ..sources import requests as S
from .queries import query

LINE = "l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"
PRICE = "CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)"
# the state machine as a recursion over the steps of each order
CYCLES = f"""RECURSIVE events AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) AS step, l_suppkey % 6 AS request,
  CASE WHEN l_linenumber <= 2 AND l_partkey % 3 < 2 THEN 'PARTIALLY_FILLED' ELSE ['FILLED', 'CANCELLED', 'REJECTED', 'PENDING', 'PARTIALLY_FILLED'][l_partkey % 5 + 1] END AS target FROM lineitem),
known AS (SELECT *, row_number() OVER (PARTITION BY order_id, request ORDER BY step) > 1 AS again FROM events),
walk AS (SELECT order_id, 0::BIGINT AS step, NULL::BIGINT AS request, NULL::VARCHAR AS target, NULL::VARCHAR AS before, 'PENDING' AS after, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT order_id FROM events)
UNION ALL SELECT k.order_id, k.step, k.request, k.target, w.after, CASE WHEN ok THEN k.target ELSE w.after END, CASE WHEN again THEN 'DUPLICATE_REQUEST' WHEN ok THEN 'APPLIED' ELSE 'INVALID_STATE_TRANSITION' END
  FROM walk w JOIN known k ON k.order_id = w.order_id AND k.step = w.step + 1, LATERAL (SELECT NOT again AND ((w.after = 'PENDING' AND k.target <> 'PENDING') OR (w.after = 'PARTIALLY_FILLED' AND k.target IN ('FILLED', 'CANCELLED', 'REJECTED'))) AS ok)),
answers AS (SELECT * FROM walk WHERE step > 0)"""


def _answers(s, d):
    return O.life_cycles(S.order_events(s, d))


@query(CYCLES + " SELECT * FROM answers")
def order_transitions(s, d):
    return _answers(s, d)


@query(CYCLES + """, last AS (SELECT order_id, arg_max(after, step) AS status, count(*) FILTER (outcome = 'APPLIED') AS applied, count(*) FILTER (outcome = 'DUPLICATE_REQUEST') AS duplicate_request,
  count(*) FILTER (outcome = 'INVALID_STATE_TRANSITION') AS invalid_state_transition FROM answers GROUP BY order_id)
SELECT status, count(*) AS orders, CAST(sum(applied) AS BIGINT) AS applied, CAST(sum(duplicate_request) AS BIGINT) AS duplicate_request, CAST(sum(invalid_state_transition) AS BIGINT) AS invalid_state_transition FROM last GROUP BY status""")
def order_status_counts(s, d):
    return O.life_cycle_counts(_answers(s, d))


EXECUTED = f"""legs AS (SELECT o_custkey AS user_id, o_orderkey % 3 AS client_order_id, o_orderkey AS request_id, o_orderdate AS placed, l_partkey AS instrument, CASE l_linestatus WHEN 'F' THEN 'buy' ELSE 'sell' END AS action, CAST(l_quantity AS BIGINT) AS quantity,
  CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 29 = 0 THEN 0 ELSE {PRICE} END AS price_c FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
asked AS (SELECT user_id, client_order_id, request_id, placed, count(*) AS legs, count(*) FILTER (price_c IS NULL OR price_c <= 0) AS missing,
  CAST(sum((CASE action WHEN 'buy' THEN 1 ELSE -1 END) * CAST(floor((price_c + 2.5) / 5) * 5 AS BIGINT) * quantity) AS BIGINT) AS net_c FROM legs GROUP BY ALL),
done AS (SELECT user_id, client_order_id, arg_min(request_id, (placed, request_id)) AS execution_id, min((placed, request_id)) AS placed, arg_min(legs, (placed, request_id)) AS legs, arg_min(net_c, (placed, request_id)) AS net_c FROM asked WHERE missing = 0 GROUP BY ALL),
answers AS (SELECT a.request_id, a.user_id, a.client_order_id, CASE WHEN a.request_id = d.execution_id THEN 'FILLED' WHEN (a.placed, a.request_id) > d.placed THEN 'DUPLICATE' ELSE 'CHAIN_DATA_MISSING' END AS outcome, a.missing, d.execution_id, d.legs, d.net_c
  FROM asked a LEFT JOIN done d USING (user_id, client_order_id))"""


@query(EXECUTED + """ SELECT request_id, user_id, client_order_id, outcome, missing, CASE WHEN outcome <> 'CHAIN_DATA_MISSING' THEN execution_id END AS execution_id,
  CASE WHEN outcome <> 'CHAIN_DATA_MISSING' THEN legs ELSE 0 END AS legs, CASE WHEN outcome <> 'CHAIN_DATA_MISSING' THEN net_c END AS net_c FROM answers""")
def strategy_executions(s, d):
    return O.executions(S.execution_legs(s, d))


@query(EXECUTED + """ SELECT l.request_id, l.user_id, instrument, action, quantity, CAST(floor((price_c + 2.5) / 5) * 5 AS BIGINT) AS fill_c,
  (CASE action WHEN 'buy' THEN -1 ELSE 1 END) * CAST(floor((price_c + 2.5) / 5) * 5 AS BIGINT) * quantity AS cash_c FROM legs l SEMI JOIN (SELECT * FROM answers WHERE outcome = 'FILLED') USING (request_id)""")
def execution_orders(s, d):
    legs = S.execution_legs(s, d)
    return O.entry_orders(legs, O.executions(legs))


# an account's positions as a list that a recursion over its events carries on
EXITS = f"""RECURSIVE events AS (SELECT o_custkey AS account, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, {LINE}) AS n, CASE l_partkey % 9 WHEN 0 THEN 'exit' WHEN 1 THEN 'mark' ELSE 'fill' END AS kind, l_suppkey % 5 AS key,
  l_partkey % 7 AS instrument, CAST(l_quantity AS BIGINT) * (CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END) AS quantity, CASE WHEN l_partkey % 9 = 1 AND l_suppkey % 3 = 0 THEN NULL ELSE {PRICE} END AS price_c FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
walk AS (SELECT account, 0::BIGINT AS n, list_transform(range(7), lambda i: {{'net': 0::BIGINT, 'average': 0::DOUBLE, 'price': NULL::BIGINT}}) AS held, list_transform(range(5), lambda i: NULL::STRUCT(exited BIGINT, cash BIGINT, realised DOUBLE, n BIGINT)) AS answered,
  NULL::BIGINT AS key, NULL::VARCHAR AS outcome, 0::BIGINT AS missing, NULL::STRUCT(exited BIGINT, cash BIGINT, realised DOUBLE, n BIGINT) AS told FROM (SELECT DISTINCT account FROM events)
UNION ALL
SELECT account, n, CASE WHEN kind = 'exit' AND outcome IN ('SUCCESS', 'NO_POSITIONS') THEN list_transform(held, lambda h: {{'net': 0::BIGINT, 'average': 0::DOUBLE, 'price': h.price}})
    WHEN kind = 'exit' THEN held ELSE list_concat(list_concat(held[:instrument], [CASE WHEN kind = 'mark' THEN {{'net': mine.net, 'average': mine.average, 'price': price_c}} ELSE
      {{'net': mine.net + quantity, 'average': CASE WHEN mine.net + quantity = 0 THEN 0 WHEN mine.net = 0 OR (mine.net > 0) = (quantity > 0) THEN (mine.average * abs(mine.net) + price_c * abs(quantity)) / abs(mine.net + quantity) WHEN abs(quantity) > abs(mine.net) THEN price_c::DOUBLE ELSE mine.average END, 'price': price_c}} END]), held[instrument + 2:]) END,
  CASE WHEN kind = 'exit' AND outcome IN ('SUCCESS', 'NO_POSITIONS') THEN list_concat(list_concat(answered[:key], [told]), answered[key + 2:]) ELSE answered END,
  key, outcome, CASE WHEN outcome = 'BULK_EXIT_CHAIN_DATA_MISSING' THEN missing ELSE 0 END, told
FROM (SELECT *, CASE WHEN outcome = 'DUPLICATE' THEN answered[key + 1] WHEN outcome IN ('SUCCESS', 'NO_POSITIONS') THEN {{'exited': len(open), 'cash': coalesce(list_sum(list_transform(open, lambda h: h.net * h.price)), 0)::BIGINT,
    'realised': round(list_reduce(list_transform(open, lambda h: (h.price - h.average) * h.net), lambda a, b: a + b, 0::DOUBLE) / 100, 4), 'n': n}} END AS told
  FROM (SELECT *, CASE WHEN kind <> 'exit' THEN NULL WHEN answered[key + 1] IS NOT NULL THEN 'DUPLICATE' WHEN missing > 0 THEN 'BULK_EXIT_CHAIN_DATA_MISSING' WHEN len(open) > 0 THEN 'SUCCESS' ELSE 'NO_POSITIONS' END AS outcome
    FROM (SELECT e.account, e.n, e.kind, e.key, e.instrument, e.quantity, e.price_c, w.held, w.answered, w.held[e.instrument + 1] AS mine, list_filter(w.held, lambda h: h.net <> 0) AS open, len(list_filter(w.held, lambda h: h.net <> 0 AND h.price IS NULL)) AS missing
      FROM walk w JOIN events e ON e.account = w.account AND e.n = w.n + 1)))),
exits AS (SELECT account, n, key, outcome, coalesce(told.exited, 0)::BIGINT AS exited, missing, coalesce(told.cash, 0)::BIGINT AS cash_c, coalesce(told.realised, 0) AS realized, told.n AS answered_by FROM walk WHERE outcome IS NOT NULL)"""


@query(EXITS + " SELECT * FROM exits")
def bulk_exits(s, d):
    return O.bulk_exits(S.account_events(s, d))


@query(EXITS + " SELECT outcome, count(*) AS requests, CAST(sum(exited) AS BIGINT) AS exited, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(cash_c) AS BIGINT) AS cash_c FROM exits GROUP BY outcome")
def bulk_exit_counts(s, d):
    return O.exit_counts(O.bulk_exits(S.account_events(s, d)))
