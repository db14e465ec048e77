"""Registered queries: exposures, life cycles, valuation, concentration and limits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources import adapters as S
from .queries import query

EXPOSURES = """exposures AS (SELECT l_suppkey AS position, l_orderkey * 10 + l_linenumber AS id, CASE l_linestatus WHEN 'F' THEN 'buy' ELSE 'sell' END AS side, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS remaining FROM lineitem GROUP BY ALL)"""


def _exits(s, d):
    known = S.table(s, d, "supplier").select(F.col("s_suppkey").alias("position"))
    more = known.filter("position % 10 = 0").select((F.col("position") + 1_000_000).alias("position"))
    return known.union(more).select("position", (100 + F.col("position") * 7919 % 12000).alias("quantity"))


@query(EXPOSURES + """, exits AS (SELECT s_suppkey AS position FROM supplier UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 10 = 0), q AS (SELECT position, 100 + position * 7919 % 12000 AS quantity FROM exits),
t AS (SELECT position, sum(CASE side WHEN 'buy' THEN remaining ELSE -remaining END) AS net, sum(remaining) AS gross FROM exposures WHERE remaining > 0 GROUP BY position),
x AS (SELECT q.position, quantity, CASE WHEN net > 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN net IS NULL THEN 'NO_EXPOSURE' WHEN net = 0 THEN 'MIXED_SIDES' WHEN quantity > (gross + abs(net)) / 2.0 THEN 'INSUFFICIENT' END AS error FROM q LEFT JOIN t USING (position)),
o AS (SELECT e.position, e.id, e.remaining, x.quantity, coalesce(sum(e.remaining) OVER (PARTITION BY e.position ORDER BY e.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM exposures e JOIN x ON e.position = x.position AND e.side = x.side WHERE x.error IS NULL AND e.remaining > 0),
k AS (SELECT position, id, CAST(least(remaining, greatest(quantity - before, 0)) AS BIGINT) AS taken, remaining FROM o)
SELECT position, id, taken, CAST(remaining - taken AS BIGINT) AS "left", NULL AS error FROM k WHERE taken > 0 UNION ALL SELECT position, NULL, NULL, NULL, error FROM x WHERE error IS NOT NULL""")
def fifo_exposure_exits(s, d):
    return L.allocate_exits(S.exposures(s, d), _exits(s, d))


@query(EXPOSURES + """, a AS (SELECT position, id, sum(CASE side WHEN 'buy' THEN remaining ELSE -remaining END) AS q, count(*) AS n FROM exposures GROUP BY ALL), e AS (SELECT position, CAST(sum(q) AS BIGINT) AS exposed, count(*) FILTER (n > 1) AS repeated FROM a GROUP BY position),
b AS (SELECT l_suppkey AS position, CAST(sum(CASE l_linestatus WHEN 'F' THEN CAST(l_quantity AS BIGINT) ELSE -CAST(l_quantity AS BIGINT) END) AS BIGINT) AS net FROM lineitem GROUP BY 1)
SELECT position, exposed, net, repeated, CASE WHEN exposed IS NOT DISTINCT FROM net THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM e FULL JOIN b USING (position)""")
def exposure_reconciliation(s, d):
    return L.reconcile_exposures(S.exposures(s, d), S.fills(s, d))


LEGS = """legs AS (SELECT o_orderkey AS strategy_id, o_custkey AS user_id, o_orderpriority AS tag, o_orderdate AS entry, l_shipdate AS exit, l_linestatus = 'F' AS closed, CAST(round(l_extendedprice * 100) AS BIGINT) - 3500000 AS pnl_c FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
c AS (SELECT strategy_id, user_id, tag, count(*) AS legs, count(*) FILTER (closed) AS closed_legs, min(entry) AS entry, CASE WHEN bool_and(closed) THEN max(exit) END AS exit, CAST(sum(CASE WHEN closed THEN pnl_c ELSE 0 END) AS BIGINT) AS realised_c FROM legs GROUP BY ALL),
cycles AS (SELECT *, CASE WHEN exit IS NOT NULL THEN 'CLOSED' WHEN closed_legs > 0 THEN 'PARTIAL' ELSE 'OPEN' END AS status, CASE WHEN date_diff('second', entry, exit) >= 0 THEN date_diff('second', entry, exit) END AS held_seconds FROM c)"""


def _cycles(s, d):
    return L.life_cycles(S.strategy_legs(s, d))


@query(LEGS + " SELECT * FROM cycles")
def strategy_life_cycles(s, d):
    return _cycles(s, d)


@query(LEGS + " SELECT tag, count(*) AS n, round(avg(held_seconds), 4) AS mean, round(median(held_seconds), 4) AS median, min(held_seconds) AS shortest, max(held_seconds) AS longest FROM cycles WHERE held_seconds IS NOT NULL GROUP BY tag")
def holding_durations(s, d):
    return L.durations(_cycles(s, d), "tag")


@query(LEGS + """ SELECT user_id, count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'OPEN') AS open, CAST(sum(realised_c) AS BIGINT) AS realised_c, CAST(sum(realised_c) + 10000000 AS BIGINT) AS balance_c,
  round(count(*) FILTER (status = 'CLOSED' AND realised_c > 0)::DOUBLE / nullif(count(*) FILTER (status = 'CLOSED'), 0), 4) AS win_rate, round(CAST(sum(realised_c) FILTER (status = 'CLOSED' AND realised_c > 0) AS DOUBLE) / -CAST(sum(realised_c) FILTER (status = 'CLOSED' AND realised_c < 0) AS DOUBLE), 4) AS profit_factor FROM cycles GROUP BY user_id""")
def account_summary(s, d):
    return L.account_summary(_cycles(s, d))


@query(LEGS + """ SELECT tag, count(*) AS trades, CAST(sum(greatest(realised_c, 0)) AS BIGINT) AS gross_profit_c, CAST(sum(least(realised_c, 0)) AS BIGINT) AS gross_loss_c, CAST(sum(realised_c) AS BIGINT) AS total_c, min(realised_c) AS worst_c, max(realised_c) AS best_c FROM cycles WHERE status = 'CLOSED' GROUP BY tag""")
def tag_details(s, d):
    return L.tag_details(_cycles(s, d))


POSITIONS = """p0 AS (SELECT l_suppkey AS account, 'S' || l_partkey % 3 AS symbol, l_partkey AS instrument, CASE l_linestatus WHEN 'F' THEN 'buy' ELSE 'sell' END AS side, CASE l_returnflag WHEN 'A' THEN 'CE' ELSE 'PE' END AS type, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS average_c, l_partkey, l_suppkey FROM lineitem),
p1 AS (SELECT *, CASE WHEN l_partkey % 997 <> 0 THEN average_c + (l_suppkey % 41 - 20) * 100 END AS mark_c, CASE side WHEN 'buy' THEN quantity ELSE -quantity END AS signed FROM p0), positions AS (SELECT *, abs(signed) * mark_c AS value_c, (mark_c - average_c) * signed AS unrealised_c FROM p1)"""
VALUED = POSITIONS + """, v AS (SELECT account, count(*) AS n, count(mark_c) AS marked, CAST(sum(value_c) AS BIGINT) AS v, CAST(sum(unrealised_c) AS BIGINT) AS u, CAST(sum(CASE side WHEN 'buy' THEN average_c * quantity ELSE 0 END) AS BIGINT) AS outlay_c FROM positions GROUP BY account),
valued AS (SELECT account, n, marked, CASE WHEN n = marked THEN v END AS value_c, CASE WHEN n = marked THEN u END AS unrealised_c, outlay_c, CASE WHEN n = marked THEN 'available' WHEN marked > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM v)"""


@query(VALUED + " SELECT * FROM valued")
def live_valuation(s, d):
    return L.live_valuation(S.positions(s, d), "account")


@query(VALUED + """, r AS (SELECT account, 'open_value' AS rule, value_c AS value, 2000000000 AS lim FROM valued UNION ALL SELECT account, 'outlay', outlay_c, 500000000 FROM valued UNION ALL SELECT account, 'positions', n, 40 FROM valued)
SELECT account, rule, value, round(value::DOUBLE / lim, 6) AS used, CASE WHEN value IS NULL THEN 'UNAVAILABLE' WHEN value::DOUBLE / lim > 1 THEN 'BREACHED' WHEN value::DOUBLE / lim >= 0.9 THEN 'WARNING' ELSE 'OK' END AS status FROM r""")
def risk_limits(s, d):
    return L.evaluate_limits(L.live_valuation(S.positions(s, d), "account"), "account")


@query(POSITIONS + ", n AS (SELECT account, instrument, type, CAST(sum(signed) AS BIGINT) AS net FROM positions GROUP BY ALL) SELECT account, instrument, type, CASE WHEN net > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, abs(net) AS quantity FROM n WHERE net <> 0")
def net_instruments(s, d):
    return L.net_instruments(S.positions(s, d), "account", "instrument", "type")


@query(POSITIONS + ", g AS (SELECT symbol, CAST(sum(abs(value_c)) AS BIGINT) AS amount FROM positions WHERE value_c IS NOT NULL GROUP BY symbol) SELECT symbol, amount, round(amount * 100.0::DOUBLE / CAST(sum(amount) OVER () AS DOUBLE), 2) AS pct, CAST(row_number() OVER (ORDER BY amount DESC, symbol) AS INTEGER) AS rank FROM g")
def symbol_concentration(s, d):
    return L.concentration(S.positions(s, d), "symbol")


@query(POSITIONS + ", g AS (SELECT side, type, CAST(sum(quantity) AS BIGINT) AS contracts FROM positions GROUP BY ALL) SELECT *, round(contracts * 100.0::DOUBLE / CAST(sum(contracts) OVER () AS DOUBLE), 2) AS pct FROM g")
def risk_buckets(s, d):
    return L.risk_buckets(S.positions(s, d))
