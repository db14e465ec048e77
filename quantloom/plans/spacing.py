"""Registered queries: series with a least distance in time, each with its SQL (a recursion from point to point)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spacing as X
from ..sources import adapters as S
from .queries import query


def _points(s, d):
    return S.table(s, d, "events").filter("value is not null").select("user_id", "ts", "event_id", F.floor(F.col("value") / 10).alias("equity"))


POINTS = "p AS (SELECT user_id, ts, event_id, CAST(floor(value / 10) AS BIGINT) AS equity FROM events WHERE value IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM p)"


def _walk(seconds: int, flat: bool) -> str:
    differs = "AND o.equity <> w.equity" if flat else ""
    return f"""RECURSIVE {POINTS}, w AS (SELECT user_id, ts, event_id, equity, i FROM o WHERE i = 1
UNION ALL SELECT user_id, n.ts, n.event_id, n.equity, n.i FROM (SELECT w.user_id, arg_min({{'ts': o.ts, 'event_id': o.event_id, 'equity': o.equity, 'i': o.i}}, o.i) AS n FROM w JOIN o ON w.user_id = o.user_id AND o.i > w.i AND o.ts >= w.ts + INTERVAL {seconds} SECOND {differs} GROUP BY w.user_id))"""


@query(_walk(300, False) + " SELECT user_id, ts, event_id, equity FROM w")
def snapshot_gate(s, d):
    """At most one snapshot in 300 seconds."""
    return X.spaced(_points(s, d), "user_id", "ts", "equity", 300, tie="event_id")


@query(_walk(86400, True) + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM w) SELECT user_id, ts, event_id, equity FROM r WHERE r <= 20")
def equity_samples(s, d):
    """A point a day at most, none that repeats the one before, the last 20."""
    return X.newest(X.spaced(_points(s, d), "user_id", "ts", "equity", 86400, skip_flat=True, tie="event_id"), "user_id", "ts", 20)


@query(POINTS + """, m AS (SELECT *, lag(equity) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM p WHERE dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 930)
SELECT user_id, ts, event_id, equity FROM m WHERE before IS NULL OR before <> equity""")
def equity_cleaned(s, d):
    return X.cleaned(_points(s, d), "user_id", "ts", "equity", "event_id")
