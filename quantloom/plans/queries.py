"""The registered queries over the star-schema tables, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import bars as B
from ..operators import gex as G
from ..operators import options as O
from ..operators import portfolio as P
from ..operators import research as R
from ..sources import adapters as S
from ..sources.scenarios import priced_strategies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The views of sources.adapters, in SQL.
CHAIN = """chain AS (SELECT 'S' || l_partkey % 3 AS symbol, CAST(l_shipdate AS DATE) AS d, CAST(CAST(l_shipdate AS DATE) + CAST(7 * (1 + l_orderkey % 3) AS INTEGER) AS DATE) AS expiry,
  CAST(1000 + 50 * (l_suppkey % 20) AS BIGINT) AS strike, CASE l_returnflag WHEN 'A' THEN 'CE' WHEN 'R' THEN 'PE' ELSE 'XX' END AS option_type,
  CAST(round(l_discount * 100) AS BIGINT) AS gamma_c, CAST(l_quantity AS BIGINT) - 1 AS oi,
  CAST(1475 + 5 * ((7 * year(l_shipdate) + 3 * month(l_shipdate) + day(l_shipdate)) % 41 - 20) AS BIGINT) AS spot,
  CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS ltp, CAST(1000 + 37 * (l_orderkey % 50) + CAST(round(l_tax * 100) AS BIGINT) AS BIGINT) AS iv_bp FROM lineitem)"""
GEX = CHAIN + """, reasoned AS (SELECT *, CASE WHEN option_type NOT IN ('CE', 'PE') THEN 'INVALID_TYPE' WHEN spot <= 0 THEN 'INVALID_SPOT' WHEN strike <= 0 THEN 'INVALID_STRIKE'
  WHEN gamma_c IS NULL OR gamma_c < 0 THEN 'INVALID_GAMMA' WHEN oi IS NULL THEN 'MISSING_OI' WHEN oi <= 0 THEN 'ZERO_OI' END AS reason FROM chain),
gex AS (SELECT *, (CASE WHEN option_type = 'CE' THEN 1 ELSE -1 END) * gamma_c * oi * spot * spot AS g FROM reasoned WHERE reason IS NULL)"""
STRIKES = GEX + """, strikes AS (SELECT symbol, d, strike, spot, CAST(sum(oi) AS BIGINT) AS oi, CAST(sum(g) FILTER (option_type = 'CE') AS BIGINT) AS call_c, CAST(sum(g) FILTER (option_type = 'PE') AS BIGINT) AS put_c,
  CAST(sum(g) AS BIGINT) AS net_c FROM gex GROUP BY symbol, d, strike, spot)"""
DAILY = GEX + """, daily AS (SELECT symbol, d, spot, CAST(sum(g) AS BIGINT) AS net_c, CAST(coalesce(sum(g) FILTER (option_type = 'CE'), 0) AS BIGINT) AS call_c, CAST(coalesce(sum(g) FILTER (option_type = 'PE'), 0) AS BIGINT) AS put_c,
  CAST(sum(abs(g)) AS BIGINT) AS gross_c, count(*) AS n_rows, count(DISTINCT strike) AS strikes FROM gex GROUP BY symbol, d, spot)"""
FORWARD = DAILY + """, fwd AS (SELECT *, round((lead(spot, 5) OVER (PARTITION BY symbol ORDER BY d) - spot) * 100.0 / spot, 4) AS ret FROM daily)"""
BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
  FROM events WHERE value IS NOT NULL GROUP BY ALL)"""
TRADES = """trades AS (SELECT o_orderkey AS execution_id, o_custkey AS user_id, o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS exit_date, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 10 AS INTEGER) AS DATE) AS entry_date, CAST(round(o_totalprice * 100) AS BIGINT) - 25000000 AS pnl_c FROM orders WHERE o_orderstatus = 'F')"""
FILLS = """fills AS (SELECT l_suppkey AS instrument, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq, CASE WHEN l_linestatus = 'F' THEN 'buy' ELSE 'sell' END AS action,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS price_c FROM lineitem)"""
METRICS = """count(*) AS trades, count(*) FILTER (pnl_c > 0) AS wins, count(*) FILTER (pnl_c < 0) AS losses, round(count(*) FILTER (pnl_c > 0) * 100.0::DOUBLE / count(*), 2) AS win_rate, round(CAST(sum(pnl_c) AS DOUBLE) / 100, 2) AS total,
  round(CAST(sum(pnl_c) FILTER (pnl_c > 0) AS DOUBLE) / count(*) FILTER (pnl_c > 0) / 100, 2) AS average_winner, round(-CAST(sum(-pnl_c) FILTER (pnl_c < 0) AS DOUBLE) / count(*) FILTER (pnl_c < 0) / 100, 2) AS average_loser,
  round(CAST(sum(pnl_c) FILTER (pnl_c > 0) AS DOUBLE) / CAST(sum(-pnl_c) FILTER (pnl_c < 0) AS DOUBLE), 4) AS profit_factor, round(CAST(sum(pnl_c) AS DOUBLE) / count(*) / 100, 2) AS expectancy"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {sql}"
        return f

    return add


def _strikes(s: SparkSession, d: str) -> DataFrame:
    return G.strike_totals(S.chain(s, d))


def _daily(s: SparkSession, d: str) -> DataFrame:
    return G.daily_totals(S.chain(s, d))


def _forward(s: SparkSession, d: str) -> DataFrame:
    return G.forward_join(_daily(s, d))


def _bars(s: SparkSession, d: str) -> DataFrame:
    return B.ohlcv(S.ticks(s, d))


# gamma exposure


@query(GEX + " SELECT reason, count(*) AS n, count(DISTINCT d) AS days, count(DISTINCT expiry) AS expiries, round(count(*) * 100.0::DOUBLE / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct_of_excluded FROM reasoned WHERE reason IS NOT NULL GROUP BY reason")
def gex_eligibility_breakdown(s, d):
    return G.exclusions(S.chain(s, d))


@query(STRIKES + """ SELECT symbol, d, strike, spot, oi, CAST(row_number() OVER (PARTITION BY symbol, d ORDER BY abs(net_c) DESC, strike) AS INTEGER) AS rank, call_c * 1e-4::DOUBLE AS call_gex, put_c * 1e-4::DOUBLE AS put_gex, net_c * 1e-4::DOUBLE AS net,
  CASE WHEN call_c IS NOT NULL AND put_c IS NOT NULL THEN net_c ELSE 0 END * 1e-4::DOUBLE AS net_both, CASE WHEN call_c IS NOT NULL AND put_c IS NOT NULL THEN net_c END * 1e-4::DOUBLE AS net_strict, net_c FROM strikes""")
def gex_strike_totals(s, d):
    return _strikes(s, d)


@query(DAILY + """ SELECT symbol, d, spot, n_rows, strikes, net_c, call_c * 1e-4::DOUBLE AS call_gex, put_c * 1e-4::DOUBLE AS put_gex, net_c * 1e-4::DOUBLE AS net_gex, abs(net_c) * 1e-4::DOUBLE AS abs_net_gex, gross_c * 1e-4::DOUBLE AS gross_gex,
  greatest(net_c, 0) * 1e-4::DOUBLE AS positive_gex, least(net_c, 0) * 1e-4::DOUBLE AS negative_gex FROM daily""")
def gex_timestamp_totals(s, d):
    return _daily(s, d)


@query(GEX + """, e AS (SELECT symbol, d, expiry, CAST(sum(g) AS BIGINT) AS net_c, count(DISTINCT strike) AS strikes FROM gex GROUP BY symbol, d, expiry)
SELECT symbol, d, expiry, strikes, net_c * 1e-4::DOUBLE AS net_gex, round(abs(net_c) * 100.0::DOUBLE / nullif(CAST(sum(abs(net_c)) OVER (PARTITION BY symbol, d) AS DOUBLE), 0), 6) AS concentration_pct FROM e""")
def gex_expiry_totals(s, d):
    return G.expiry_totals(S.chain(s, d))


@query(DAILY + """, b AS (SELECT symbol, d, net_c, nullif(lag(net_c) OVER (PARTITION BY symbol ORDER BY d), 0) AS before_c FROM daily), c AS (SELECT *, net_c - before_c AS change_c FROM b)
SELECT symbol, d, net_c * 1e-4::DOUBLE AS net_gex, change_c * 1e-4::DOUBLE AS gex_change, round(change_c * 100.0::DOUBLE / abs(before_c), 6) AS change_pct, (change_c - lag(change_c) OVER (PARTITION BY symbol ORDER BY d)) * 1e-4::DOUBLE AS acceleration FROM c""")
def gex_change_accel(s, d):
    return G.change(_daily(s, d))


@query(DAILY + """, r AS (SELECT symbol, d, CASE WHEN net_c > 0 THEN 'POSITIVE' WHEN net_c < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS regime FROM daily), p AS (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY d) AS previous FROM r),
q AS (SELECT *, sum(CASE WHEN previous IS NOT DISTINCT FROM regime THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT symbol, d, regime, previous, CASE WHEN previous <> regime THEN previous || '->' || regime END AS transition, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY d) AS INTEGER) AS run_length FROM q""")
def gex_regime_runs(s, d):
    return G.regime_runs(_daily(s, d))


@query(DAILY + """, l AS (SELECT symbol, list_sort(list(net_c)) AS a FROM daily GROUP BY symbol), v AS (SELECT symbol, a[1 + CAST(floor(0.25 * (len(a) - 1)) AS INTEGER)] AS p25, a[1 + CAST(floor(0.5 * (len(a) - 1)) AS INTEGER)] AS p50, a[1 + CAST(floor(0.75 * (len(a) - 1)) AS INTEGER)] AS p75 FROM l)
SELECT symbol, d, CASE WHEN net_c > 0 THEN 'POSITIVE' WHEN net_c < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS regime,
  CASE WHEN abs(net_c) <= 0.1 * abs(p50) THEN 'FLIP_ZONE' WHEN net_c > 0 AND net_c >= p75 THEN 'STRONG_POSITIVE' WHEN net_c > 0 THEN 'POSITIVE' WHEN net_c <= p25 THEN 'STRONG_NEGATIVE' ELSE 'NEGATIVE' END AS detail FROM daily JOIN v USING (symbol)""")
def gex_percentile_regimes(s, d):
    return G.percentile_regimes(_daily(s, d))


@query(STRIKES + """, n AS (SELECT symbol, d, spot, strike, CAST(net_c AS DOUBLE) AS a, lead(strike) OVER w AS k2, CAST(lead(net_c) OVER w AS DOUBLE) AS b FROM strikes WINDOW w AS (PARTITION BY symbol, d ORDER BY strike)),
x AS (SELECT *, b IS NOT NULL AND (a * b < 0 OR a = 0) AS ok FROM n),
y AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN a = 0 THEN CAST(strike AS DOUBLE) ELSE strike + (k2 - strike) * (abs(a) / (abs(a) + abs(b))) END AS level, CASE WHEN NOT ok THEN NULL WHEN a = 0 THEN 1.0 ELSE 1 - least(abs(a), abs(b)) / greatest(abs(a), abs(b)) END AS sure FROM x),
z AS (SELECT symbol, d, spot, count(*) AS strikes, count(level) AS crossings, count(*) FILTER (level IS NOT NULL AND a = 0) AS exact, arg_min(level, (abs(level - spot), level)) FILTER (level IS NOT NULL) AS flip, arg_min(sure, (abs(level - spot), level)) FILTER (level IS NOT NULL) AS sure FROM y GROUP BY symbol, d, spot)
SELECT symbol, d, spot, crossings, CASE WHEN strikes < 2 THEN 'INSUFFICIENT_DATA' WHEN crossings = 0 THEN 'NO_CROSSING' WHEN crossings = 1 AND exact = 1 THEN 'EXACT_ZERO' ELSE 'FOUND' END AS status, round(flip, 6) AS flip, round(flip - spot, 6) AS distance, round(sure, 6) AS confidence FROM z""")
def gex_flip(s, d):
    return G.flips(_strikes(s, d))


WALLS = STRIKES + """, w AS (SELECT *, CASE WHEN net_c > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS side FROM strikes WHERE net_c <> 0), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, d, side ORDER BY abs(net_c) DESC, strike) AS INTEGER) AS rank FROM w)"""


@query(WALLS + " SELECT symbol, d, side, rank, strike, net_c * 1e-4::DOUBLE AS net_gex, strike - spot AS distance, round((strike - spot) * 100.0::DOUBLE / spot, 6) AS distance_pct FROM ranked WHERE rank <= 3")
def gex_walls_top3(s, d):
    return G.walls(_strikes(s, d))


@query(WALLS + """, f AS (SELECT symbol, d, max(strike) FILTER (side = 'POSITIVE') AS positive, max(strike) FILTER (side = 'NEGATIVE') AS negative FROM ranked WHERE rank = 1 GROUP BY symbol, d)
SELECT *, positive - lag(positive) OVER (PARTITION BY symbol ORDER BY d) AS positive_move, negative - lag(negative) OVER (PARTITION BY symbol ORDER BY d) AS negative_move FROM f""")
def gex_wall_movement(s, d):
    return G.wall_moves(_strikes(s, d))


@query(STRIKES + """, r AS (SELECT *, abs(net_c) AS size, row_number() OVER (PARTITION BY symbol, d ORDER BY abs(net_c) DESC, strike) AS rn FROM strikes),
t AS (SELECT symbol, d, spot, CAST(sum(size) FILTER (rn <= 3) AS DOUBLE) AS t3, CAST(sum(size) FILTER (rn <= 5) AS DOUBLE) AS t5, CAST(sum(size) FILTER (rn <= 10) AS DOUBLE) AS t10, nullif(CAST(sum(size) AS DOUBLE), 0) AS total, CAST(sum(CAST(size AS HUGEINT) * strike) AS DOUBLE) AS moment FROM r GROUP BY symbol, d, spot),
c AS (SELECT *, moment / total AS centre FROM t), s AS (SELECT *, centre - lag(centre) OVER (PARTITION BY symbol ORDER BY d) AS shift FROM c)
SELECT symbol, d, round(t3 * 100 / total, 6) AS top3_pct, round(t5 * 100 / total, 6) AS top5_pct, round(t10 * 100 / total, 6) AS top10_pct, round(centre, 6) AS centroid,
  CASE WHEN abs(shift) <= greatest(spot * 0.001::DOUBLE, 1) THEN 'STABLE' WHEN shift > 0 THEN 'UP' WHEN shift < 0 THEN 'DOWN' END AS migration FROM s""")
def gex_concentration_centroid(s, d):
    return G.concentration(_strikes(s, d))


@query(DAILY + """, x AS (SELECT symbol, d, net_c * 1e-4::DOUBLE AS net, abs(net_c * 1e-4::DOUBLE) AS size FROM daily), y AS (SELECT *, net - lag(net) OVER (PARTITION BY symbol ORDER BY d) AS delta, CAST(d - lag(d) OVER (PARTITION BY symbol ORDER BY d) AS DOUBLE) AS dt FROM x),
z AS (SELECT *, avg(net) OVER w AS sma, count(delta) OVER w AS nd, stddev_pop(delta) OVER w AS dv, list(size) OVER w AS seen, avg(size) OVER w AS m, stddev_pop(size) OVER w AS sd FROM y WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 9 PRECEDING))
SELECT symbol, d, round(sma, 6) AS sma, round(delta / dt, 8) AS velocity, round(CASE WHEN nd >= 2 THEN dv END, 2) AS delta_volatility,
  CASE WHEN len(seen) >= 5 THEN round((len(list_filter(seen, lambda v: v < size)) + 0.5::DOUBLE * len(list_filter(seen, lambda v: v = size))) / len(seen) * 100, 6) END AS percentile, CASE WHEN len(seen) >= 5 AND sd > 0 THEN round((size - m) / sd, 4) END AS z FROM z""")
def gex_rolling(s, d):
    return G.rolling(_daily(s, d))


# bars


@query(BARS + " SELECT * FROM bars")
def bars_ohlcv(s, d):
    return _bars(s, d)


@query(BARS + """, e AS (SELECT symbol, open_time, list_filter([CASE WHEN least(open, high, low, close) <= 0 THEN 'NON_POSITIVE' END, CASE WHEN high < greatest(open, close) THEN 'HIGH_TOO_LOW' END, CASE WHEN low > least(open, close) THEN 'LOW_TOO_HIGH' END], lambda x: x IS NOT NULL) AS errors, volume, high, low, close FROM bars)
SELECT symbol, open_time, array_to_string(errors, ',') AS errors, len(errors) = 0 AS valid, CASE WHEN len(errors) = 0 AND close <> 0 AND (high - low) / close > 0.02 THEN 'WIDE_RANGE' ELSE '' END AS warnings FROM e""")
def bars_validate(s, d):
    return B.validate(_bars(s, d)).select("symbol", "open_time", F.array_join("errors", ",").alias("errors"), "valid", F.array_join("warnings", ",").alias("warnings"))


@query(BARS + """, n AS (SELECT symbol, open_time, lead(open_time) OVER (PARTITION BY symbol, CAST(open_time AS DATE) ORDER BY open_time) AS nxt FROM bars)
SELECT symbol, open_time AS gap_start, nxt AS gap_end, CAST(date_diff('hour', open_time, nxt) - 1 AS BIGINT) AS missing FROM n WHERE date_diff('minute', open_time, nxt) > 90""")
def bars_gaps(s, d):
    return B.gaps(_bars(s, d))


@query(BARS + """ SELECT symbol, CAST(open_time AS DATE) AS d, count(*) AS bars, min(open_time) AS first, max(open_time) AS last, round(least(count(*) * 100.0::DOUBLE / 24, 100), 1) AS pct FROM bars GROUP BY ALL""")
def bars_daily_coverage(s, d):
    return B.daily_coverage(_bars(s, d))


@query("""have AS (SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS d FROM orders), span AS (SELECT priority, status, min(d) AS a, max(d) AS b FROM have GROUP BY ALL),
w AS (SELECT priority, status, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span), gone AS (SELECT * FROM w WHERE isodow(d) < 6 AND NOT EXISTS (SELECT 1 FROM have h WHERE h.priority = w.priority AND h.status = w.status AND h.d = w.d)),
r AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY priority, status ORDER BY d) AS INTEGER) AS run FROM gone) SELECT priority, status, min(d) AS start, max(d) AS "end", count(*) AS days FROM r GROUP BY priority, status, run""")
def bars_missing_ranges(s, d):
    """Weekdays without an order, for each priority and status."""
    orders = S.table(s, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("d"))
    return B.missing_ranges(orders, ["priority", "status"])


@query(BARS + """ SELECT t.event_id, t.ts, t.event_type AS symbol, b.close AS asof_close FROM (SELECT * FROM events WHERE value IS NOT NULL) t ASOF LEFT JOIN (SELECT symbol, open_time + INTERVAL 1 HOUR AS at, close FROM bars) b ON t.event_type = b.symbol AND t.ts >= b.at""")
def asof_spot(s, d):
    closed = _bars(s, d).select("symbol", (F.col("open_time") + F.expr("INTERVAL 1 HOUR")).alias("at"), "close")
    return B.as_of(S.ticks(s, d).select("symbol", "ts", "event_id"), closed, ["symbol"], "ts", "at", ["close"], bucket=F.to_date)


@query(BARS + " SELECT symbol, open_time, " + ", ".join(f"round((lead(close, {k}) OVER w - close) * 100 / nullif(close, 0), 4) AS ret_{k}" for k in (1, 2, 3, 5, 10, 20)) + """,
  round((max(close) OVER (w ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) - close) * 100 / nullif(close, 0), 4) AS mfe, round((min(close) OVER (w ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) - close) * 100 / nullif(close, 0), 4) AS mae FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)""")
def forward_returns(s, d):
    return B.forward_returns(_bars(s, d))


@query(BARS + """, x AS (SELECT symbol, open_time, close, max(high) OVER w AS hi, min(low) OVER w AS lo, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT symbol, open_time, round(CASE WHEN n = 10 THEN (hi - lo) / nullif(close, 0) END, 6) AS range, round(CASE WHEN n = 10 THEN (hi - close) / nullif(close, 0) END, 6) AS upside, round(CASE WHEN n = 10 THEN (close - lo) / nullif(close, 0) END, 6) AS downside FROM x""")
def forward_range(s, d):
    return B.forward_range(_bars(s, d))


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS n FROM events WHERE value IS NOT NULL) SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, event_id, value AS price FROM r WHERE n = 1""")
def bars_upsert(s, d):
    log = S.ticks(s, d).select("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time"), "event_id", "price")
    return B.last_write_wins(log, ["symbol", "open_time"], "event_id")


# chain


@query(CHAIN + """ SELECT symbol, d, CAST(sum(CASE WHEN option_type = 'CE' THEN oi ELSE 0 END) AS BIGINT) AS call_oi, CAST(sum(CASE WHEN option_type = 'PE' THEN oi ELSE 0 END) AS BIGINT) AS put_oi,
  round(CAST(sum(CASE WHEN option_type = 'PE' THEN oi ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN option_type = 'CE' THEN oi ELSE 0 END) AS DOUBLE), 0), 6) AS pcr FROM chain GROUP BY symbol, d""")
def put_call_ratio(s, d):
    return O.put_call_ratio(S.chain(s, d))


@query(CHAIN + """, t AS (SELECT symbol, d, strike, sum(CASE WHEN option_type = 'CE' THEN oi ELSE 0 END) AS ce, sum(CASE WHEN option_type = 'PE' THEN oi ELSE 0 END) AS pe FROM chain WHERE option_type <> 'XX' GROUP BY symbol, d, strike),
p AS (SELECT a.symbol, a.d, a.strike, CAST(sum(b.ce * greatest(a.strike - b.strike, 0) + b.pe * greatest(b.strike - a.strike, 0)) AS BIGINT) AS pain FROM t a JOIN t b ON a.symbol = b.symbol AND a.d = b.d GROUP BY a.symbol, a.d, a.strike)
SELECT symbol, d, arg_min(strike, (pain, strike)) AS max_pain, min(pain) AS pain FROM p GROUP BY symbol, d""")
def max_pain(s, d):
    return O.max_pain(S.chain(s, d))


@query(STRIKES + """, o AS (SELECT symbol, d, spot, sum(oi) AS oi FROM strikes GROUP BY symbol, d, spot), x AS (SELECT symbol, d, spot - lag(spot) OVER (PARTITION BY symbol ORDER BY d) AS p, oi - lag(oi) OVER (PARTITION BY symbol ORDER BY d) AS o FROM o)
SELECT symbol, d, CASE WHEN p > 0 AND o > 0 THEN 'LONG_BUILDUP' WHEN p < 0 AND o > 0 THEN 'SHORT_BUILDUP' WHEN p > 0 AND o < 0 THEN 'SHORT_COVERING' WHEN p < 0 AND o < 0 THEN 'LONG_UNWINDING' ELSE 'NEUTRAL' END AS quadrant FROM x""")
def oi_quadrants(s, d):
    return O.oi_quadrants(_strikes(s, d).groupBy("symbol", "d", "spot").agg(F.sum("oi").alias("oi")))


@query(CHAIN + """ SELECT option_type, CASE WHEN oi IS NULL THEN 'NULL' WHEN oi = 0 THEN 'ZERO' WHEN oi < 0 THEN 'NEGATIVE' ELSE 'OK' END AS status, count(*) AS n, count(DISTINCT strike) AS strikes FROM chain GROUP BY ALL""")
def oi_status(s, d):
    return O.oi_status(S.chain(s, d))


@query(CHAIN + """ SELECT symbol, d, expiry, strike, count(*) FILTER (option_type = 'CE') AS calls, count(*) FILTER (option_type = 'PE') AS puts FROM chain GROUP BY ALL HAVING calls > 0 AND puts > 0""")
def ce_pe_pairs(s, d):
    return O.call_put_pairs(S.chain(s, d))


@query("""k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT * FROM k""")
def duplicate_keys(s, d):
    return S.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""m AS (SELECT s_suppkey AS instrument FROM supplier UNION ALL SELECT CAST(p_partkey AS BIGINT) FROM part) SELECT instrument, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = instrument) GROUP BY instrument""")
def missing_instruments(s, d):
    known = S.table(s, d, "supplier").select(F.col("s_suppkey").alias("instrument")).unionAll(S.table(s, d, "part").select(F.col("p_partkey").cast("long")))
    return known.join(S.table(s, d, "lineitem").select(F.col("l_suppkey").alias("instrument")), "instrument", "left_anti").groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


@query(CHAIN + """, t AS (SELECT symbol, d, spot, list_sort(list(DISTINCT strike)) AS a, arg_min(strike, (abs(strike - spot), strike)) AS atm FROM chain GROUP BY symbol, d, spot)
SELECT symbol, d, atm, a[greatest(list_position(a, atm) - 2, 1)] AS below, a[least(list_position(a, atm) + 2, len(a))] AS above FROM t""")
def resolve_atm(s, d):
    return O.at_the_money(S.chain(s, d))


@query(CHAIN + """, e AS (SELECT DISTINCT symbol, d, expiry FROM chain), x AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY expiry) AS n FROM e WHERE expiry >= d), m AS (SELECT date_trunc('month', expiry) AS m, max(expiry) AS monthly FROM e GROUP BY 1),
y AS (SELECT symbol, d, max(expiry) FILTER (n = 1) AS current_week, max(expiry) FILTER (n = 2) AS next_week FROM x GROUP BY symbol, d) SELECT symbol, d, current_week, next_week, monthly FROM y LEFT JOIN m ON date_trunc('month', d) = m""")
def resolve_expiry(s, d):
    return O.expiries(S.chain(s, d))


# portfolio


@query(f"{TRADES} SELECT {METRICS} FROM trades")
def perf_summary(s, d):
    return P.performance(S.trades(s, d))


@query(f"{TRADES} SELECT strategy, {METRICS} FROM trades GROUP BY strategy")
def strategy_groups(s, d):
    return P.performance(S.trades(s, d), ["strategy"])


@query(f"{TRADES} SELECT exit_date, round(CAST(sum(pnl_c) AS DOUBLE) / 100, 2) AS pnl, count(*) AS trades FROM trades GROUP BY exit_date")
def daily_pnl(s, d):
    return P.daily_pnl(S.trades(s, d))


@query(TRADES + """, x AS (SELECT *, CASE WHEN pnl_c > 0 THEN 'WIN' WHEN pnl_c < 0 THEN 'LOSS' ELSE 'BREAKEVEN' END AS r FROM trades), y AS (SELECT *, CASE WHEN lag(r) OVER w IS NOT DISTINCT FROM r THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY entry_date, execution_id)),
z AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY entry_date, execution_id) AS run FROM y), g AS (SELECT user_id, run, r, count(*) AS n FROM z GROUP BY ALL)
SELECT user_id, coalesce(max(n) FILTER (r = 'WIN'), 0) AS max_wins, coalesce(max(n) FILTER (r = 'LOSS'), 0) AS max_losses, arg_max(r, run) AS current_result, arg_max(n, run) AS current_length FROM g GROUP BY user_id""")
def streaks(s, d):
    return P.streaks(S.trades(s, d))


EQUITY = TRADES + """, e AS (SELECT user_id, execution_id, exit_date, CAST(row_number() OVER w AS INTEGER) AS step, 10000000 + sum(pnl_c) OVER w AS e FROM trades WINDOW w AS (PARTITION BY user_id ORDER BY entry_date, execution_id)),
p AS (SELECT *, greatest(max(e) OVER (PARTITION BY user_id ORDER BY step), 10000000) AS p FROM e UNION ALL SELECT user_id, NULL, min(exit_date), 0, 10000000, 10000000 FROM e GROUP BY user_id),
curve AS (SELECT user_id, step, execution_id, exit_date, CAST(e AS DOUBLE) / 100 AS equity, CAST(e - p AS DOUBLE) / 100 AS drawdown, round(CAST(e - p AS DOUBLE) * 100 / CAST(p AS DOUBLE), 6) AS drawdown_pct FROM p)"""


@query(EQUITY + " SELECT * FROM curve")
def equity_drawdown(s, d):
    return P.equity(S.trades(s, d))


@query(EQUITY + " SELECT user_id, min(drawdown) AS max_drawdown, arg_min(drawdown_pct, (drawdown, step)) AS max_drawdown_pct, arg_max(drawdown, step) AS current, arg_max(equity, step) AS equity FROM curve GROUP BY user_id")
def max_drawdown(s, d):
    return P.max_drawdown(P.equity(S.trades(s, d)))


@query()
def net_positions(s, d):
    return P.net_positions(S.fills(s, d))


@query(FILLS + """, r AS (SELECT *, sum(quantity) OVER (PARTITION BY instrument, action ORDER BY seq, price_c ROWS UNBOUNDED PRECEDING) AS hi FROM fills WHERE quantity > 0), b AS (SELECT *, hi - quantity AS lo FROM r)
SELECT x.instrument, CAST(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo)) AS BIGINT) AS matched, CAST(sum((least(x.hi, y.hi) - greatest(x.lo, y.lo)) * (y.price_c - x.price_c)) AS BIGINT) AS gain_c
FROM b x JOIN b y ON x.instrument = y.instrument AND x.action = 'buy' AND y.action = 'sell' AND x.lo < y.hi AND y.lo < x.hi GROUP BY x.instrument""")
def fifo_allocation(s, d):
    return P.fifo_allocation(S.fills(s, d))


@query(FILLS + """ SELECT instrument, CAST(coalesce(sum(quantity) FILTER (action = 'buy'), 0) AS BIGINT) AS bought, CAST(coalesce(sum(quantity) FILTER (action = 'sell'), 0) AS BIGINT) AS sold,
  CAST(sum(CASE action WHEN 'buy' THEN quantity ELSE -quantity END) AS BIGINT) AS net, CAST(sum(CASE action WHEN 'buy' THEN -1 ELSE 1 END * quantity * price_c) AS BIGINT) AS cash_c FROM fills GROUP BY instrument""")
def reconcile_cash(s, d):
    return P.reconcile(S.fills(s, d))


@query(FILLS + """, t AS (SELECT action, CAST(sum(quantity * price_c) AS BIGINT) AS value_c, count(*) AS n FROM fills GROUP BY action) SELECT *, round(value_c * 100.0::DOUBLE / CAST(sum(value_c) OVER () AS DOUBLE), 4) AS pct FROM t""")
def position_exposure(s, d):
    return P.exposure(S.fills(s, d))


# research


DESCRIBE = """count(*) AS n, round(avg(ret), 4) AS mean, round(median(ret), 6) AS median, round(stddev_pop(ret), 4) AS std, round(avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) * 100, 2) AS win_pct, list_sort(list(ret))[1 + CAST(floor(count(*) / 4) AS INTEGER)] AS p25,
  list_sort(list(ret))[1 + CAST(least(floor(3 * count(*) / 4), count(*) - 1) AS INTEGER)] AS p75, min(ret) AS min, max(ret) AS max"""


@query(FORWARD + f" SELECT CASE WHEN net_c > 0 THEN 'POSITIVE' WHEN net_c < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS regime, symbol, {DESCRIBE} FROM fwd WHERE ret IS NOT NULL GROUP BY ALL")
def stats_by_regime(s, d):
    return R.describe(_forward(s, d).withColumn("regime", G.regime(F.col("net_c"))), "ret", "symbol", "regime")


@query(FORWARD + """, x AS (SELECT net_c, ret, row_number() OVER (PARTITION BY symbol ORDER BY net_c, d) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n, symbol FROM fwd WHERE ret IS NOT NULL)
SELECT CAST(least(floor(r / greatest(floor(n / 5), 1)), 4) + 1 AS INTEGER) AS quintile, symbol, count(*) AS n, round(avg(ret), 6) AS mean, min(net_c) AS low, max(net_c) AS high FROM x GROUP BY ALL""")
def quintile_returns(s, d):
    return R.quintiles(_forward(s, d), "net_c", "ret", "d")


PVALUES = """t AS (SELECT o_orderpriority || '/' || o_orderstatus AS test, round(exp(-abs(avg(o_totalprice) - 250000) / 2000), 6) AS p FROM orders GROUP BY 1)"""


@query(PVALUES + """, r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, test) AS r FROM t)
SELECT test, p, round(least(min(p * n / r) OVER (ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS bh, round(least(max(p * (n - r + 1)) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 1), 6) AS holm, round(least(p * n, 1), 6) AS bonferroni FROM r""")
def multiple_testing(s, d):
    tests = S.table(s, d, "orders").groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("test")).agg(F.round(F.exp(-F.abs(F.avg("o_totalprice") - 250000) / 2000), 6).alias("p"))
    return R.adjust(tests, "p", "test")


@query(FORWARD + """ SELECT CASE WHEN net_c > 0 THEN 'POSITIVE' WHEN net_c < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS regime, symbol, regr_count(ret, x) AS n, nullif(round(regr_slope(ret, x), 8), 'nan'::DOUBLE) AS beta, round(regr_intercept(ret, x), 6) AS alpha, round(regr_r2(ret, x), 6) AS r2
  FROM (SELECT *, net_c * 1e-10::DOUBLE AS x FROM fwd) GROUP BY ALL""")
def ols_by_regime(s, d):
    return R.ols(_forward(s, d).withColumn("regime", G.regime(F.col("net_c"))).withColumn("x", F.col("net_c") * 1e-10), "ret", "x", "symbol", "regime")


SIGNALS = FORWARD + """, x AS (SELECT *, lag(net_c) OVER (PARTITION BY symbol ORDER BY d) AS before, net_c - lag(net_c) OVER (PARTITION BY symbol ORDER BY d) AS change, spot - lag(spot) OVER (PARTITION BY symbol ORDER BY d) AS up FROM fwd), y AS (SELECT *, change - lag(change) OVER (PARTITION BY symbol ORDER BY d) AS accel FROM x),
signals AS (SELECT symbol, d, 'regime_shift' AS signal, ret AS value FROM y WHERE before < 0 AND net_c > 0 AND ret IS NOT NULL UNION ALL SELECT symbol, d, 'negative_expansion', abs(ret) FROM y WHERE net_c < 0 AND change < 0 AND ret IS NOT NULL
UNION ALL SELECT symbol, d, 'acceleration', ret FROM y WHERE accel > 0 AND ret IS NOT NULL UNION ALL SELECT symbol, d, 'bearish_divergence', -ret FROM y WHERE up > 0 AND change <= 0 AND ret IS NOT NULL UNION ALL SELECT symbol, d, 'bullish_divergence', ret FROM y WHERE up <= 0 AND change > 0 AND ret IS NOT NULL)"""


@query(SIGNALS + " SELECT symbol, d, signal, value FROM signals")
def research_signals(s, d):
    return R.signals(_forward(s, d))


@query(SIGNALS + f" SELECT symbol, signal, {DESCRIBE.replace('ret', 'value')} FROM signals GROUP BY ALL")
def signal_statistics(s, d):
    return R.describe(R.signals(_forward(s, d)), "value", "symbol", "signal")


@query(SIGNALS + """, r AS (SELECT *, count(*) OVER (PARTITION BY symbol, signal) AS c, row_number() OVER (PARTITION BY symbol, signal ORDER BY value, d) AS r FROM signals), t AS (SELECT symbol, signal, count(*) AS n, avg(value) AS m, avg(value) FILTER (r > greatest(floor(c * 0.05), 1) AND r <= c - greatest(floor(c * 0.05), 1)) AS t FROM r GROUP BY ALL)
SELECT symbol, signal, n, round(m, 4) AS mean, round(t, 4) AS trimmed, coalesce(n >= 30 AND abs(m) > 0.001 AND sign(m) = sign(t), false) AS robust FROM t""")
def signal_robustness(s, d):
    return R.robustness(R.signals(_forward(s, d)), "value", ["symbol", "signal"])


@query(FORWARD + """, p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY d) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7) THEN 'train' ELSE 'test' END AS part FROM fwd)
SELECT symbol, part, CASE WHEN net_c > 0 THEN 'POSITIVE' WHEN net_c < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS regime, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) * 100, 2) AS win_pct FROM p WHERE ret IS NOT NULL GROUP BY ALL""")
def walk_forward(s, d):
    return R.walk_forward(_forward(s, d))


# pricing and payoff

A1, A2, A3, A4, A5 = (f"({a}::DOUBLE)" for a in pricing.A)


def _cdf(x: str) -> str:
    t = f"(1 / (1 + {pricing.P}::DOUBLE * (abs({x}) / sqrt(2))))"
    erf = f"(1 - (((({A5} * {t} + {A4}) * {t} + {A3}) * {t} + {A2}) * {t} + {A1}) * {t} * exp(-pow(abs({x}) / sqrt(2), 2)))"
    return f"(CASE WHEN {x} = 0 THEN 0.5 WHEN {x} > 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


PRICED = CHAIN + """, o AS (SELECT DISTINCT symbol, d, expiry, strike, option_type, spot, CAST(expiry - d AS DOUBLE) / 365 AS t, 0.1::DOUBLE + 0.01::DOUBLE * (strike % 7) AS sigma FROM chain WHERE option_type <> 'XX')"""


def _priced(s: SparkSession, d: str) -> DataFrame:
    c = S.chain(s, d).filter("option_type <> 'XX'").select("symbol", "d", "expiry", "strike", "option_type", "spot").distinct()
    return c.withColumn("t", F.datediff("expiry", "d").cast("double") / 365).withColumn("sigma", 0.1 + 0.01 * (F.col("strike") % 7))


@query(PRICED + f""", v AS (SELECT *, (ln(spot / strike) + (0.065::DOUBLE + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1, CASE option_type WHEN 'CE' THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM o), w AS (SELECT *, d1 - sigma * sqrt(t) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf, s * d1 AS sd1, s * (d1 - sigma * sqrt(t)) AS sd2 FROM v),
n AS (SELECT *, {_cdf("d1")} AS n1, {_cdf("sd1")} AS ns1, {_cdf("sd2")} AS ns2 FROM w)
SELECT symbol, d, expiry, strike, option_type, round(s * (spot * ns1 - strike * exp(-0.065::DOUBLE * t) * ns2), 4) AS price, round(CASE option_type WHEN 'CE' THEN n1 ELSE n1 - 1 END, 6) AS delta, round(pdf / (spot * sigma * sqrt(t)), 8) AS gamma,
  round(spot * pdf * sqrt(t), 4) AS vega, round(-spot * pdf * sigma / (2 * sqrt(t)) - s * 0.065::DOUBLE * strike * exp(-0.065::DOUBLE * t) * ns2, 4) AS theta FROM n""")
def bs_greeks(s, d):
    x = _priced(s, d)
    g = pricing.greeks(F.col("option_type"), F.col("spot").cast("double"), F.col("strike").cast("double"), F.col("t"), F.col("sigma"))
    return x.select("symbol", "d", "expiry", "strike", "option_type", *(F.round(g[n], 8 if n == "gamma" else 6 if n == "delta" else 4).alias(n) for n in ("price", "delta", "gamma", "vega", "theta")))


def _model(sigma: str) -> str:
    """The model price in SQL, over s (1 or -1), spot, strike and t."""
    d1 = f"((ln(spot / strike) + (0.065::DOUBLE + {sigma} * {sigma} / 2) * t) / ({sigma} * sqrt(t)))"
    return f"s * (spot * {_cdf(f'(s * {d1})')} - strike * exp(-0.065::DOUBLE * t) * {_cdf(f'(s * ({d1} - {sigma} * sqrt(t)))')})"


@query(PRICED + f""", a AS (SELECT *, CASE option_type WHEN 'CE' THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM o), p AS (SELECT *, {_model("sigma")} AS price, greatest(s * (spot - strike), 0) AS intr FROM a),
q AS (SELECT *, CASE WHEN price <= 0 THEN 'INVALID_PRICE' WHEN price < intr - 1e-8 THEN 'BELOW_INTRINSIC' WHEN price > CASE option_type WHEN 'CE' THEN spot ELSE strike END THEN 'ABOVE_MAX' WHEN abs(price - intr) <= 1e-8 THEN 'SUCCESS'
  WHEN price < {_model("0.001::DOUBLE")} - 1e-8 OR price > {_model("10::DOUBLE")} + 1e-8 THEN 'NO_BRACKET' ELSE 'SUCCESS' END AS status FROM p)
SELECT symbol, d, expiry, strike, option_type, status, round(price, 4) AS price, CASE WHEN status = 'SUCCESS' THEN true END AS repriced FROM q""")
def implied_vol(s, d):
    """Solved back from model prices: the model price at the volatility found is the price again."""
    x = _priced(s, d)
    of = lambda sigma: pricing.greeks(F.col("option_type"), F.col("spot").cast("double"), F.col("strike").cast("double"), F.col("t"), sigma)["price"]
    iv = pricing.implied_vol(F.col("option_type"), F.col("spot").cast("double"), F.col("strike").cast("double"), F.col("t"), F.col("price"))
    x = x.withColumn("price", of(F.col("sigma"))).withColumn("solved", iv)
    return x.select("symbol", "d", "expiry", "strike", "option_type", F.col("solved.status").alias("status"), F.round("price", 4).alias("price"), (F.abs(of(F.col("solved.iv")) - F.col("price")) < 1e-4).alias("repriced"))


PAYOFF_LEGS = """legs AS (SELECT l_orderkey AS name, CASE l_returnflag WHEN 'A' THEN 'CE' ELSE 'PE' END AS type, CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END AS dir, CAST(1000 + 50 * (l_suppkey % 20) AS BIGINT) AS strike, 1 + l_linenumber % 3 AS qty,
  CAST(CAST(round(l_discount * 100) AS BIGINT) * 700 + 500 AS BIGINT) / 100.0::DOUBLE AS premium FROM lineitem)"""


def _curve(step: int) -> str:
    return PAYOFF_LEGS + f""", curve AS (SELECT name, CAST(price AS INTEGER) AS price, round(CAST(sum(dir * qty * (greatest(CASE type WHEN 'CE' THEN price - strike ELSE strike - price END, 0) - premium)) AS DOUBLE), 6) AS pnl FROM legs, generate_series(1000, 2000, {step}) g(price) GROUP BY ALL)"""


@query(_curve(50) + " SELECT * FROM curve")
def payoff_curve(s, d):
    return O.payoff_curve(priced_strategies(s, d), 1000, 2000, 50)


@query(_curve(25) + """, n AS (SELECT name, price, pnl, lead(price) OVER w AS p2, lead(pnl) OVER w AS v2 FROM curve WINDOW w AS (PARTITION BY name ORDER BY price)) SELECT name, round(price + (p2 - price) * (-pnl / (v2 - pnl)), 4) AS breakeven FROM n WHERE pnl * v2 < 0 OR (pnl = 0 AND v2 <> 0)""")
def payoff_breakevens(s, d):
    return O.breakevens(O.payoff_curve(priced_strategies(s, d), 1000, 2000, 25))


@query(CHAIN + """, c AS (SELECT symbol, d, spot, strike, CAST(sum(CASE option_type WHEN 'CE' THEN oi ELSE -oi END) AS BIGINT) AS oi FROM chain WHERE option_type <> 'XX' AND oi > 0 GROUP BY ALL), x AS (SELECT symbol, d, strike, oi, i, spot * (0.7::DOUBLE + 0.6::DOUBLE * i / 20) AS px, 30::DOUBLE / 365 AS t FROM c, generate_series(0, 20) g(i)),
y AS (SELECT *, (ln(px / strike) + (0.065::DOUBLE + 0.02::DOUBLE) * t) / (0.2::DOUBLE * sqrt(t)) AS d1 FROM x) SELECT symbol, d, CAST(i AS INTEGER) AS i, round(sum(exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (px * 0.2::DOUBLE * sqrt(t)) * oi * px * px * 0.01::DOUBLE), 2) AS net_gex FROM y GROUP BY symbol, d, i""")
def spot_sweep(s, d):
    return O.spot_sweep(S.chain(s, d))


@query(PAYOFF_LEGS + """, book AS (SELECT type, CAST(strike AS DOUBLE) AS strike, CAST(sum(dir * qty) AS BIGINT) AS net FROM legs GROUP BY ALL), g AS (SELECT type, net, strike, shift::DOUBLE AS shift, vol::DOUBLE AS vol, 1500 * (1 + shift::DOUBLE) AS spot, 30::DOUBLE / 365 AS t, CASE type WHEN 'CE' THEN 1.0 ELSE -1.0 END::DOUBLE AS s
FROM book, (SELECT unnest([-0.1, -0.05, 0.0, 0.05, 0.1]) AS shift), (SELECT unnest([0.1, 0.2, 0.3]) AS vol)) SELECT shift, vol, round(sum(net * """ + _model("vol") + """), 2) AS value FROM g GROUP BY shift, vol""")
def scenario_matrix(s, d):
    """The whole book; legs of the same option are one before the grid is laid over them."""
    legs = priced_strategies(s, d).select(F.explode("legs").alias("l")).groupBy("l.type", "l.strike").agg(F.sum(F.when(F.col("l.action") == "buy", F.col("l.qty")).otherwise(-F.col("l.qty"))).alias("net"))
    book = legs.select("type", "strike", F.when(F.col("net") < 0, "sell").otherwise("buy").alias("action"), F.abs("net").alias("qty"))
    return O.scenario_matrix(book, 1500.0, (-0.1, -0.05, 0.0, 0.05, 0.1), (0.1, 0.2, 0.3), 30 / 365).withColumn("value", F.round("value", 2))
