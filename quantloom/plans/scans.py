"""Registered queries: scans by time, status and page, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..sources import adapters as S
from ..sources import scans as X
from .queries import query


@query("x AS (SELECT event_id, ts, event_type, value FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') SELECT * FROM x ORDER BY ts, event_id LIMIT 400")
def bar_scan(s, d):
    """Oldest first within a range, a page of 400."""
    return X.scan(S.table(s, d, "events"), {"event_type": "view"}, "ts", datetime(2024, 1, 3), datetime(2024, 1, 20, 12), ["event_id", "ts", "event_type", "value"], ["event_id"], limit=400)


@query("x AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type IN ('click', 'error') AND user_id = 7) SELECT * FROM x ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_observations(s, d):
    return X.scan(S.table(s, d, "events"), {"event_type": ["click", "error"], "user_id": 7}, "ts", columns=["event_id", "ts", "user_id", "value"], order=["event_id"], newest_first=True, limit=100)


@query("x AS (SELECT DISTINCT CAST(l_shipdate AS TIMESTAMP) AS open_time FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1998-06-30') SELECT * FROM x")
def success_times(s, d):
    x = X.scan(S.table(s, d, "lineitem"), {"l_linestatus": "F", "l_returnflag": ["A", "R"]}, "l_shipdate", datetime(1996, 1, 1), datetime(1998, 6, 30), ["l_shipdate"])
    return x.select(F.col("l_shipdate").alias("open_time")).distinct()


@query("x AS (SELECT DISTINCT l_suppkey AS instrument FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey IS NOT NULL) SELECT * FROM x")
def distinct_instruments(s, d):
    return X.distinct_values(S.table(s, d, "lineitem"), "l_suppkey", l_linestatus="O").withColumnRenamed("l_suppkey", "instrument")


@query("""p AS (SELECT o_orderkey AS order_id, o_custkey, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 250 OFFSET 50)
SELECT order_id, status, created_at, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, 'Custom') AS tag FROM p LEFT JOIN customer ON o_custkey = c_custkey""")
def order_history(s, d):
    """The newest orders of a status, a page further on, with their tag or Custom."""
    page = X.scan(S.table(s, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": None}, "o_orderdate", columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"], order=["o_orderkey"], newest_first=True, limit=250, offset=50)
    tags = S.table(s, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tag"))
    x = page.join(tags, "o_custkey", "left")
    return x.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.coalesce("tag", F.lit("Custom")).alias("tag"))


@query("""p AS (SELECT o_orderkey AS position_id, o_orderdate AS opened_at FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 0 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 300)
SELECT position_id, opened_at, count(l_orderkey) AS legs, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS exposures FROM p LEFT JOIN lineitem ON l_orderkey = position_id GROUP BY ALL""")
def positions_listing(s, d):
    """The newest open positions with the legs attached to each."""
    page = X.scan(S.table(s, d, "orders").filter("o_totalprice > 0"), {"o_orderstatus": "O"}, "o_orderdate", columns=["o_orderkey", "o_orderdate"], order=["o_orderkey"], newest_first=True, limit=300)
    legs = S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    x = X.attach(page, legs, "o_orderkey", "legs", "l_linenumber", "l_partkey")
    shown = F.array_join(F.transform("legs", lambda e: F.concat_ws(":", e["l_linenumber"], e["l_partkey"])), ",")
    return x.select(F.col("o_orderkey").alias("position_id"), F.col("o_orderdate").alias("opened_at"), F.size("legs").cast("long").alias("legs"), shown.alias("exposures"))
