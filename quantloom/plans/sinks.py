"""Registered queries: tables written by the sinks and read back, and their logs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import keyed as K
from ..sources import adapters as S
from ..sources.shared import new_folder
from .queries import CHAIN, query

KEYS = ("symbol", "d", "expiry", "strike", "option_type", "calc_version")


def _run(s, d, number: int):
    """What run ``number`` computes of a chain: the first of days up to the 20th, the later ones of days from the 15th, a share of them anew."""
    c = S.chain(s, d)
    part = c.filter(F.dayofmonth("d") <= 20) if number == 1 else c.filter(F.dayofmonth("d") >= 15)
    gex = F.col("gamma_c") * F.col("oi") * F.when(F.col("strike") % 100 == 0, number).otherwise(1)
    version = F.when(F.col("ltp") % 50 == 0, None).otherwise("v1")
    return part.select("symbol", "d", "expiry", "strike", "option_type", version.alias("calc_version"), gex.alias("gex"), F.col("oi"), F.col("ltp").alias("arrival"), K.month_of(F.col("d")).alias("month"))


def _write(s, d) -> tuple[str, str]:
    """Three runs into one table, the last a repetition of the second; the folders of the table and of its log."""
    table, log = new_folder(s, "gex-table"), new_folder(s, "gex-log")
    for name, number in (("first", 1), ("second", 2), ("again", 2)):
        K.upsert(table, _run(s, d, number), KEYS, "month", ("gex", "oi"), "arrival", log, "gex", name)
    return table, log


def _run_sql(number: int) -> str:
    return f"""r{number} AS (SELECT symbol, d, expiry, strike, option_type, CASE WHEN ltp % 50 = 0 THEN NULL ELSE 'v1' END AS calc_version, gamma_c * oi * CASE WHEN strike % 100 = 0 THEN {number} ELSE 1 END AS gex, oi, ltp AS arrival FROM chain WHERE day(d) {"<= 20" if number == 1 else ">= 15"}),
n{number} AS (SELECT symbol, d, expiry, strike, option_type, calc_version, max({{'arrival': arrival, 'gex': gex, 'oi': oi}}) AS v FROM r{number} WHERE calc_version IS NOT NULL GROUP BY ALL)"""


RUNS = CHAIN + ", " + _run_sql(1) + ", " + _run_sql(2)
ON = " AND ".join(f"a.{c} = b.{c}" for c in KEYS)


@query(RUNS + f""" SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.d, a.d) AS d, coalesce(b.expiry, a.expiry) AS expiry, coalesce(b.strike, a.strike) AS strike, coalesce(b.option_type, a.option_type) AS option_type, coalesce(b.calc_version, a.calc_version) AS calc_version,
  CASE WHEN b.v IS NOT NULL THEN b.v.gex ELSE a.v.gex END AS gex, CASE WHEN b.v IS NOT NULL THEN b.v.oi ELSE a.v.oi END AS oi, strftime(coalesce(b.d, a.d), '%Y-%m') AS month FROM n1 a FULL JOIN n2 b ON {ON}""")
def gex_upserts(s, d):
    table, _ = _write(s, d)
    kinds = _run(s, d, 1).select(*KEYS, "gex", "oi", "month").schema
    return s.read.schema(kinds).parquet(table)


@query(RUNS + f""", c AS (SELECT count(*) FILTER (a.v IS NULL) AS inserted, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL AND (a.v.gex <> b.v.gex OR a.v.oi <> b.v.oi)) AS updated, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL AND a.v.gex = b.v.gex AND a.v.oi = b.v.oi) AS unchanged FROM n1 a FULL JOIN n2 b ON {ON})
SELECT 'first' AS run_id, 'gex' AS operation, (SELECT count(*) FROM r1) AS fetched, (SELECT count(*) FROM n1) AS inserted, 0 AS updated, 0 AS unchanged, (SELECT count(*) FROM r1 WHERE calc_version IS NULL) AS rejected
UNION ALL SELECT 'second', 'gex', (SELECT count(*) FROM r2), inserted, updated, unchanged, (SELECT count(*) FROM r2 WHERE calc_version IS NULL) FROM c
UNION ALL SELECT 'again', 'gex', (SELECT count(*) FROM r2), 0, 0, (SELECT count(*) FROM n2), (SELECT count(*) FROM r2 WHERE calc_version IS NULL)""")
def gex_upsert_log(s, d):
    _, log = _write(s, d)
    return K.action_counts(s.read.schema(K.LOG).parquet(log), "run_id", "operation").drop("entries")


OBSERVED = """seen AS (SELECT ' s' || user_id % 5 || ' ' AS symbol, CASE WHEN event_id % 17 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS expiry, CASE event_id % 13 WHEN 0 THEN 'ATM' ELSE CAST(1000 + event_id % 500 AS VARCHAR) END AS strike,
  ['Call', 'PUT', 'future'][event_id % 3 + 1] AS option_type, (value - 5) / 100 AS iv, CASE event_id % 7 WHEN 0 THEN 'n/a' ELSE CAST(event_id % 90 AS VARCHAR) END AS spot, repeat(event_type, 6) AS source, ts AS observed_at FROM events)"""


@query(OBSERVED + """ SELECT upper(trim(symbol)) AS symbol, expiry, CAST(strike AS DOUBLE) AS strike, lower(option_type) AS option_type, iv, TRY_CAST(spot AS DOUBLE) AS spot, source[:32] AS source, observed_at FROM seen
WHERE iv > 0 AND expiry <> '' AND TRY_CAST(strike AS DOUBLE) IS NOT NULL AND lower(option_type) IN ('call', 'put')""")
def iv_observations(s, d):
    e = S.table(s, d, "events")
    k = F.col("event_id")
    seen = e.select(
        F.concat(F.lit(" s"), F.col("user_id") % 5, F.lit(" ")).alias("symbol"), F.when(k % 17 != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("").alias("expiry"), F.when(k % 13 == 0, "ATM").otherwise((1000 + k % 500).cast("string")).alias("strike"),
        F.element_at(F.array(F.lit("Call"), F.lit("PUT"), F.lit("future")), (k % 3 + 1).cast("int")).alias("option_type"), ((F.col("value") - 5) / 100).alias("iv"), F.when(k % 7 == 0, "n/a").otherwise((k % 90).cast("string")).alias("spot"),
        F.repeat("event_type", F.lit(6)).alias("source"), F.col("ts").alias("observed_at"),
    )
    table = new_folder(s, "iv-table")
    K.append_observations(table, seen)
    return s.read.schema(K.valid_observations(seen).schema).parquet(table)
