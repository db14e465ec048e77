"""Registered queries: the state of live ticks, over a table of them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as S
from ..streaming import ticks as T
from .queries import query

LATEST = """latest AS (SELECT event_type AS symbol, max(ts) AS ts, arg_max(value, (ts, event_id)) AS price FROM events WHERE value IS NOT NULL GROUP BY 1)"""


@query(LATEST + " SELECT * FROM latest")
def latest_ticks(s, d):
    return T.latest_ticks(S.ticks(s, d))


@query(LATEST + """, n AS (SELECT max(ts) AS now FROM events WHERE value IS NOT NULL) SELECT symbol, (epoch_us(now) - epoch_us(ts)) // 1000000 AS age_seconds, CASE WHEN (epoch_us(now) - epoch_us(ts)) // 1000000 > 10 THEN 'STALE' ELSE 'LIVE' END AS status FROM latest, n""")
def tick_freshness(s, d):
    ticks = S.ticks(s, d)
    return T.freshness(T.latest_ticks(ticks), ticks.agg(F.max("ts").alias("now")))


@query("""t AS (SELECT event_type AS symbol, CAST(DATE '2024-01-04' + CAST(7 * (user_id % 3) AS INTEGER) AS DATE) AS expiry, 1000 + 50 * (user_id % 20) AS strike, CASE event_id % 3 WHEN 0 THEN 'CE' WHEN 1 THEN 'PE' ELSE 'XX' END AS option_type, ts, event_id, value FROM events WHERE value IS NOT NULL),
l AS (SELECT symbol, expiry, strike, option_type, arg_max(value, (ts, event_id)) AS price, max(ts) AS ts FROM t WHERE option_type <> 'XX' GROUP BY ALL)
SELECT symbol, expiry, strike, max(price) FILTER (option_type = 'CE') AS call, max(price) FILTER (option_type = 'PE') AS put, max(ts) AS as_of FROM l GROUP BY ALL""")
def rebuilt_chain(s, d):
    user, k = F.col("user_id"), F.col("event_id") % 3
    x = S.table(s, d, "events").filter("value is not null").select(
        F.col("event_type").alias("symbol"), F.date_add(F.lit("2024-01-04").cast("date"), (7 * (user % 3)).cast("int")).alias("expiry"), (1000 + 50 * (user % 20)).alias("strike"),
        F.when(k == 0, "CE").when(k == 1, "PE").otherwise("XX").alias("option_type"), "ts", "event_id", F.col("value").alias("price"),
    )
    return T.rebuilt_chain(x)


@query("""o AS (SELECT user_id, event_id, ts, event_type, arg_min({'e': event_id, 't': event_type}, (ts, event_id)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS o FROM events)
SELECT user_id, event_id, ts, event_type, o.e <> event_id AND o.t = event_type AS repeat FROM o""")
def snapshot_repeats(s, d):
    return T.repeats(S.table(s, d, "events").select("user_id", "event_id", "ts", "event_type"), "event_type", 21600, "user_id")
