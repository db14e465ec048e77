"""Registered queries: price alerts, with their SQL over every quote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..sources import adapters as S
from .queries import query

ALERTS = """alerts AS (SELECT o_orderkey AS alert_id, ['click', 'view', 'error', 'purchase', 'none'][o_orderkey % 5 + 1] AS symbol, CASE o_orderkey % 3 WHEN 0 THEN 'above' WHEN 1 THEN 'below' ELSE 'above' END AS condition,
  CAST(o_totalprice / 2000 AS BIGINT) AS level, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate END AS triggered_at FROM orders),
hits AS (SELECT alert_id, min({'ts': ts, 'event_id': event_id, 'price': value}) AS f FROM alerts JOIN events ON event_type = symbol AND CASE condition WHEN 'above' THEN value >= level ELSE value <= level END WHERE triggered_at IS NULL GROUP BY alert_id)"""


@query(ALERTS + " SELECT a.alert_id, symbol, condition, level, triggered_at, f.ts AS fired_at, f.price AS fired_price FROM alerts a LEFT JOIN hits h ON a.alert_id = h.alert_id")
def price_alerts(s, d):
    k = F.col("o_orderkey")
    symbol = F.element_at(F.array(*(F.lit(x) for x in ("click", "view", "error", "purchase", "none"))), (k % 5 + 1).cast("int"))
    alerts = S.table(s, d, "orders").select(
        k.alias("alert_id"), symbol.alias("symbol"), F.when(k % 3 == 1, "below").otherwise("above").alias("condition"), F.round(F.col("o_totalprice") / 2000).cast("long").alias("level"), F.when(k % 9 == 0, F.col("o_orderdate")).alias("triggered_at")
    )
    return A.fired(alerts, S.ticks(s, d), "symbol", "ts", "price", "event_id")
