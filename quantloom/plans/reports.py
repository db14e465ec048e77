"""Registered queries: landing data and chain reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import landing, reports
from ..sources import adapters as S
from .queries import CHAIN, query



def _raw(s, d):
    """Vendor arrays as JSON, some too short, some with words for numbers or times."""
    k, v = F.col("event_id") % 8, F.format_string("%.2f", F.round("value", 2))
    time = F.concat(F.lit('"'), F.when(k == 3, "never").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))), F.lit('"'))
    close, volume = F.when(k == 1, F.lit('"x"')).otherwise(v), F.when(k == 2, F.lit('"n/a"')).otherwise(F.lit("7"))
    full = F.concat(F.lit("["), F.concat_ws(",", time, v, v, v, close, volume, F.lit("11")), F.lit("]"))
    return S.table(s, d, "events").filter("value is not null").select(F.concat(F.lit(" "), "event_type").alias("symbol"), F.col("event_id").alias("arrival"), F.when(k == 4, F.concat(F.lit("["), time, F.lit("]"))).otherwise(full).alias("raw"))


@query("""r AS (SELECT event_id, upper(event_type) AS symbol, event_id % 8 AS k, date_trunc('second', ts) AS ts, round(value, 2) AS v FROM events WHERE value IS NOT NULL)
SELECT symbol, event_id AS arrival, ts AS open_time, v AS open, v AS high, v AS low, v AS close, CASE k WHEN 2 THEN 0 ELSE 7 END::DOUBLE AS volume, 11::DOUBLE AS open_interest FROM r WHERE k NOT IN (1, 3, 4)""")
def vendor_option_bars(s, d):
    return landing.vendor_bars(_raw(s, d), option=True)


@query("""i AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey END AS contract, p_brand || CASE WHEN p_partkey % 7 = 0 THEN '!' ELSE '' END AS brand, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS lot, p_partkey, p_brand, p_size FROM part),
j AS (SELECT contract, brand, lot, contract IS NOT NULL AND contract % 3 <> 0 AS known, p_brand AS old_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS old_lot FROM i)
SELECT contract, CASE WHEN known THEN old_brand ELSE brand END AS brand, CASE WHEN known THEN coalesce(old_lot, CASE WHEN brand = old_brand THEN lot END) ELSE lot END AS lot,
  CASE WHEN contract IS NULL THEN 'error' WHEN NOT known THEN 'insert' WHEN brand <> old_brand THEN 'conflict' WHEN old_lot IS NULL AND lot IS NOT NULL THEN 'filled' ELSE 'unchanged' END AS action FROM j""")
def contract_upsert(s, d):
    part = S.table(s, d, "part")
    old = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("contract"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("lot"))
    new = part.select(F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey")).alias("contract"), F.concat("p_brand", F.when(F.col("p_partkey") % 7 == 0, "!").otherwise("")).alias("brand"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size")).alias("lot"))
    return landing.contract_actions(old, new, "contract", ["brand"], "lot")


LOG = """log AS (SELECT user_id AS job, event_type AS pipeline, ts, event_id AS seq, ['RUNNING', 'FAILED', 'COMPLETED'][1 + event_id % 3] AS status FROM events)"""


@query(LOG + " SELECT pipeline, job, min(ts) FILTER (status = 'RUNNING') AS started_at, max(ts) FILTER (status = 'COMPLETED') AS completed_at, arg_max(status, (ts, seq)) AS status, count(*) AS updates FROM log GROUP BY pipeline, job")
def checkpoint_state(s, d):
    status = F.element_at(F.array(F.lit("RUNNING"), F.lit("FAILED"), F.lit("COMPLETED")), (F.col("event_id") % 3 + 1).cast("int"))
    return landing.checkpoints(S.table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("pipeline"), "ts", F.col("event_id").alias("seq"), status.alias("status")), "pipeline", "job")


@query("""m AS (SELECT event_type, max(ts) AS last FROM events GROUP BY 1) SELECT event_id, event_type, ts FROM events JOIN m USING (event_type) WHERE ts >= last - INTERVAL 7 DAY""")
def retained_events(s, d):
    return landing.retained(S.table(s, d, "events").select("event_id", "event_type", "ts"), "ts", 7, "event_type")


@query("""sp AS (SELECT o_orderpriority AS name, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS stop FROM orders GROUP BY 1), c AS (SELECT name, stop, CAST(unnest(generate_series(start, stop, INTERVAL 30 DAY)) AS DATE) AS f FROM sp)
SELECT name, f AS "from", CAST(least(f + 29, stop) AS DATE) AS "to" FROM c""")
def backfill_chunks(s, d):
    spans = S.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return landing.date_chunks(spans, 30)


JOINED = CHAIN + ", g AS (SELECT DISTINCT symbol, d, expiry, strike, option_type FROM chain WHERE gamma_c > 2), k AS (SELECT symbol, d, expiry, strike, option_type, CAST(sum(oi) AS BIGINT) AS oi FROM chain WHERE iv_bp % 7 <> 0 GROUP BY ALL)"


def _greeks(s, d):
    return S.chain(s, d).filter("gamma_c > 2")


def _candles(s, d):
    return S.chain(s, d).filter("iv_bp % 7 <> 0")


@query(JOINED + """ SELECT g.symbol, g.option_type, CASE WHEN oi IS NULL THEN 'MISSING_OI' WHEN oi <= 0 THEN 'ZERO_OI' ELSE 'MATCHED' END AS status, count(*) AS n, CAST(sum(oi) AS BIGINT) AS oi FROM g LEFT JOIN k ON g.symbol = k.symbol AND g.d = k.d AND g.expiry = k.expiry AND g.strike = k.strike AND g.option_type = k.option_type GROUP BY ALL""")
def greeks_oi_lineage(s, d):
    return reports.oi_lineage(_greeks(s, d), _candles(s, d))


@query(JOINED + """ SELECT symbol, expiry, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.symbol = k.symbol AND g.d = k.d AND g.expiry = k.expiry AND g.strike = k.strike AND g.option_type = k.option_type) GROUP BY ALL""")
def missing_greeks(s, d):
    return reports.missing_greeks(_candles(s, d), _greeks(s, d))


@query(JOINED + """ SELECT symbol, expiry, count(DISTINCT strike) AS strikes, count(*) AS n FROM chain c WHERE iv_bp % 7 <> 0 AND EXISTS (SELECT 1 FROM g WHERE g.symbol = c.symbol AND g.expiry = c.expiry) GROUP BY ALL""")
def expiries_with_greeks(s, d):
    return reports.expiries_with_both(_candles(s, d), _greeks(s, d))


@query(CHAIN + """, x AS (SELECT symbol, d, CAST(sum(CASE option_type WHEN 'CE' THEN oi ELSE 0 END) AS BIGINT) AS call_oi, CAST(sum(CASE option_type WHEN 'PE' THEN oi ELSE 0 END) AS BIGINT) AS put_oi, CAST(sum(CASE option_type WHEN 'CE' THEN oi * ltp ELSE 0 END) AS BIGINT) AS call_value, CAST(sum(CASE option_type WHEN 'PE' THEN oi * ltp ELSE 0 END) AS BIGINT) AS put_value FROM chain GROUP BY ALL)
SELECT *, call_oi + put_oi - lag(call_oi + put_oi) OVER (PARTITION BY symbol ORDER BY d) AS oi_change FROM x""")
def side_sums(s, d):
    return reports.side_sums(S.chain(s, d))


@query(CHAIN + """, x AS (SELECT symbol, expiry, strike, option_type, max(oi) AS max_oi, count(*) AS n FROM chain GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY max_oi DESC, n DESC, expiry, strike, option_type) AS INTEGER) AS rank FROM x) SELECT * FROM r WHERE rank <= 20""")
def top_open_interest(s, d):
    return reports.top_instruments(S.chain(s, d))


@query(CHAIN + """, t AS (SELECT DISTINCT symbol, d FROM chain), q AS (SELECT DISTINCT 'S' || o_custkey % 3 AS symbol, CAST(o_orderdate AS DATE) AS target FROM orders),
x AS (SELECT q.symbol, target, max(t.d) FILTER (t.d <= target) AS b, min(t.d) FILTER (t.d >= target) AS a FROM q JOIN t USING (symbol) GROUP BY ALL) SELECT symbol, target, CASE WHEN b IS NULL OR a - target < target - b THEN a ELSE b END AS closest FROM x""")
def closest_snapshots(s, d):
    targets = S.table(s, d, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 3).alias("symbol"), F.to_date("o_orderdate").alias("target")).distinct()
    return reports.closest_time(S.chain(s, d), targets)


@query(CHAIN + """, z AS (SELECT *, abs(strike - spot) * 100.0::DOUBLE / spot AS pct FROM chain) SELECT symbol, CASE WHEN pct <= 2 THEN 'ATM' WHEN pct <= 5 THEN 'NEAR' WHEN pct <= 10 THEN 'MID' ELSE 'FAR' END AS zone, count(*) AS n, CAST(sum(oi) AS BIGINT) AS oi, round(count(*) FILTER (oi % 5 = 0) * 100.0::DOUBLE / count(*), 4) AS whole_lots_pct FROM z GROUP BY ALL""")
def strike_zones(s, d):
    return reports.zones(S.chain(s, d))


@query(CHAIN + ", e AS (SELECT DISTINCT symbol, expiry FROM chain) SELECT symbol, dayname(expiry) AS weekday, count(*) AS expiries FROM e GROUP BY ALL")
def expiry_weekdays(s, d):
    return reports.expiry_weekdays(S.chain(s, d))


@query(CHAIN + """, x AS (SELECT symbol, d, CAST(sum(CASE WHEN expiry - d <= 7 THEN oi ELSE 0 END) AS BIGINT) AS near, CAST(sum(CASE WHEN expiry - d > 7 AND expiry - d <= 14 THEN oi ELSE 0 END) AS BIGINT) AS mid, CAST(sum(CASE WHEN expiry - d > 14 THEN oi ELSE 0 END) AS BIGINT) AS far,
  CAST(sum(CASE option_type WHEN 'CE' THEN gamma_c * oi ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE option_type WHEN 'PE' THEN gamma_c * oi ELSE 0 END) AS DOUBLE) AS p FROM chain WHERE option_type <> 'XX' AND oi > 0 GROUP BY ALL) SELECT symbol, d, near, mid, far, round(c * 100 / nullif(c + p, 0), 4) AS call_share_pct FROM x""")
def expiry_buckets(s, d):
    return reports.expiry_buckets(S.chain(s, d))


@query("""p AS (SELECT 'S' || l_partkey % 3 AS symbol, CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_partkey % 13 <> 0 THEN l_partkey % 1000 - 500 END AS delta_m FROM lineitem),
t AS (SELECT symbol, CAST(sum(q * delta_m) AS BIGINT) AS total_m, count(delta_m) AS known, count(*) AS n FROM p GROUP BY symbol) SELECT symbol, total_m, known, CASE WHEN known = 0 THEN 'unavailable' WHEN known < n THEN 'partial' ELSE 'available' END AS status, round(abs(total_m) * 100.0::DOUBLE / CAST(sum(abs(total_m)) OVER () AS DOUBLE), 4) AS share_pct FROM t""")
def greek_totals(s, d):
    delta = F.when(F.col("instrument") % 13 != 0, F.col("instrument") % 1000 - 500)
    return reports.greek_totals(S.positions(s, d).withColumn("delta_m", delta), "symbol")
