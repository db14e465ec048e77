"""Registered queries: live chains from payloads, and Greeks of stored bars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live as L
from ..sources import payloads as S
from .queries import CHAIN, _model, query


def _side(n: str, flag: str, h: str) -> str:
    """A side's values straight from the lines, without the payload."""
    at = f"d + to_minutes(CAST(strike - {h} % 50 AS INTEGER))"
    return f"""{n}_n > 0 AS {n}_there, CASE WHEN {n}_n > 0 THEN CASE WHEN {h} % 13 = 0 THEN 0 WHEN {h} % 31 = 0 THEN NULL ELSE {n}_oi END END AS {n}_open, CASE WHEN {n}_n > 0 THEN CASE WHEN {h} % 17 = 0 THEN NULL WHEN {h} % 19 = 0 THEN '-3' WHEN {h} % 23 = 0 THEN 'n/a' ELSE CAST({n}_gamma AS VARCHAR) END END AS {n}_greek,
  CASE WHEN {n}_n > 0 AND {h} % 5 <> 0 THEN {n}_oi - {h} % 7 END AS {n}_prev, CASE WHEN {n}_n > 0 AND {h} % 29 <> 0 THEN {at} END AS {n}_quote"""


LIVE = """lines AS (SELECT 'S' || l_partkey % 3 AS symbol, CAST(l_shipdate AS DATE) AS d, CAST(1000 + 50 * (l_suppkey % 20) AS BIGINT) AS strike, l_returnflag AS kind, CAST(l_quantity AS BIGINT) AS oi, CAST(round(l_discount * 100) AS BIGINT) AS gamma FROM lineitem),
k AS (SELECT symbol, d, strike, strike // 50 + dayofyear(d) AS h, """ + ", ".join(f"count(*) FILTER (kind = '{f}') AS {n}_n, sum(oi) FILTER (kind = '{f}') AS {n}_oi, sum(gamma) FILTER (kind = '{f}') AS {n}_gamma" for n, f in (("call", "A"), ("put", "R"))) + """ FROM lines GROUP BY ALL),
s AS (SELECT symbol, d, strike, CASE WHEN dayofyear(d) % 61 = 0 THEN 0 WHEN dayofyear(d) % 67 = 0 THEN NULL WHEN h % 2 = 0 THEN NULL ELSE 1475 + 5 * (dayofyear(d) % 41 - 20) END AS sent, """ + _side("call", "A", "h") + ", " + _side("put", "R", "(h + 3)") + """ FROM k),
p AS (SELECT *, CAST(arg_min(sent, strike) FILTER (sent IS NOT NULL) OVER (PARTITION BY symbol, d) AS DOUBLE) AS spot FROM s)"""


def _why(n: str) -> str:
    number = f"TRY_CAST({n}_greek AS DOUBLE)"
    return f"CASE WHEN {n}_greek IS NULL THEN 'MISSING_GAMMA' WHEN {number} IS NULL THEN 'INVALID_GAMMA' WHEN {number} < 0 THEN 'NEGATIVE_GAMMA' WHEN {number} = 0 THEN 'INVALID_GAMMA' WHEN {n}_open IS NULL THEN 'MISSING_OI' WHEN {n}_open = 0 THEN 'ZERO_OI' END AS {n}_reason"


STRIKES = LIVE + f""", w AS (SELECT *, {_why("call")}, {_why("put")} FROM p WHERE spot > 0),
e AS (SELECT symbol, d, spot, strike, CASE WHEN call_reason IS NULL THEN CAST(call_greek AS DOUBLE) * call_open * spot * spot END AS call, CASE WHEN put_reason IS NULL THEN -(CAST(put_greek AS DOUBLE) * put_open * spot * spot) END AS put, call_reason, put_reason,
  CASE WHEN call_reason IS NULL AND put_reason IS NULL THEN 'available' WHEN call_reason IS NULL OR put_reason IS NULL THEN 'partial' WHEN call_reason IN ('INVALID_GAMMA', 'NEGATIVE_GAMMA') OR put_reason IN ('INVALID_GAMMA', 'NEGATIVE_GAMMA') THEN 'invalid' ELSE 'unavailable' END AS status,
  least(call_quote, put_quote) AS quote FROM w)"""


def _chains(s, d):
    return L.canonical_chain(S.chain_payloads(s, d))


@query(LIVE + " SELECT symbol, d AS expiry, spot, CAST(strike AS DOUBLE) AS strike, type, CAST(oi AS VARCHAR) AS oi, chg_oi, strftime(quote, '%Y-%m-%dT%H:%M:%SZ') AS quote FROM (" + " UNION ALL ".join(
    f"SELECT symbol, d, spot, strike, '{t}' AS type, {n}_open AS oi, CAST({n}_open - {n}_prev AS DOUBLE) AS chg_oi, {n}_quote AS quote FROM p WHERE {n}_there" for t, n in (("CE", "call"), ("PE", "put"))) + ")")
def live_chain_rows(s, d):
    x = L.chain_rows(_chains(s, d))
    return x.select("symbol", "expiry", "spot", "strike", "type", "oi", "chg_oi", F.when(F.col("quote_time") != "soon", F.col("quote_time")).alias("quote"))


@query(STRIKES + " SELECT symbol, d AS expiry, CAST(strike AS DOUBLE) AS strike, call * 0.01::DOUBLE AS call_gex, put * 0.01::DOUBLE AS put_gex, (call + put) * 0.01::DOUBLE AS net_gex, call_reason, put_reason, status FROM e")
def live_strike_exposure(s, d):
    return L.strike_exposure(_chains(s, d))


@query(STRIKES + """, t AS (SELECT symbol, d, any_value(spot) AS spot, sum(call) AS call, sum(put) AS put, count(*) AS strikes, count(*) FILTER (status = 'available') AS available, count(*) FILTER (status = 'partial') AS partly, count(*) FILTER (status = 'invalid') AS wrong, min(quote) AS quote FROM e GROUP BY ALL),
none AS (SELECT symbol, d, any_value(spot) AS spot FROM p GROUP BY symbol, d HAVING coalesce(any_value(spot), 0) <= 0)
SELECT symbol, d AS expiry, spot, call * 0.01::DOUBLE AS call_gex, put * 0.01::DOUBLE AS put_gex, (call + put) * 0.01::DOUBLE AS net_gex, CASE WHEN available = strikes AND available > 0 THEN 'available' WHEN available + partly > 0 THEN 'partial' WHEN wrong > 0 THEN 'invalid' ELSE 'unavailable' END AS status,
  CAST(available + partly AS INTEGER) AS valid_strikes, CAST(strikes AS INTEGER) AS strikes, CASE WHEN quote IS NOT NULL THEN greatest(epoch_ms(d + INTERVAL 22 HOUR) - epoch_ms(quote), 0) END AS age_ms FROM t
UNION ALL SELECT symbol, d, spot, NULL, NULL, NULL, 'unavailable', 0, 0, NULL FROM none""")
def live_chain_exposure(s, d):
    return L.chain_exposure(_chains(s, d))


GREEKS = "RECURSIVE " + CHAIN + f""", opts AS (SELECT symbol, CAST(expiry - INTERVAL 7 DAY AS DATE) AS expiry, strike, option_type, symbol || '|' || CAST(CAST(expiry - INTERVAL 7 DAY AS DATE) AS VARCHAR) || '|' || strike || '|' || option_type AS instrument,
  d + to_minutes(CAST(540 + ltp % 420 AS INTEGER)) AS open_time, greatest(CASE option_type WHEN 'CE' THEN spot - strike ELSE strike - spot END, 0) + oi - 3 AS price FROM chain),
bars AS (SELECT instrument, symbol, expiry, strike, option_type, open_time, CAST(max(price) AS DOUBLE) AS price FROM opts WHERE option_type <> 'XX' GROUP BY ALL),
idx AS (SELECT symbol, d, d + to_minutes(CAST(555 + 15 * k AS INTEGER)) AS at, CAST(spot + k % 5 - 2 AS DOUBLE) AS spot FROM (SELECT DISTINCT symbol, d, spot FROM chain WHERE dayofyear(d) % 37 <> 0), range(25) g(k) WHERE k % 6 <> 5),
x AS (SELECT b.*, CASE WHEN CAST(i.at AS DATE) = CAST(b.open_time AS DATE) THEN i.spot END AS spot, greatest(epoch(expiry + INTERVAL 10 HOUR) - epoch(open_time), 0) / (365.25::DOUBLE * 86400) AS t, CASE option_type WHEN 'CE' THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM bars b ASOF LEFT JOIN idx i ON b.symbol = i.symbol AND b.open_time >= i.at),
y AS (SELECT *, greatest(s * (spot - strike), 0) AS intr FROM x),
z AS (SELECT *, CASE WHEN spot IS NULL THEN 'NO_SPOT' WHEN price <= 0 THEN 'ZERO_PRICE' WHEN t <= 0 THEN 'EXPIRED' WHEN price < intr - 1e-8 THEN 'BELOW_INTRINSIC' WHEN price > CASE option_type WHEN 'CE' THEN spot ELSE strike END THEN 'ABOVE_MAX' WHEN abs(price - intr) <= 1e-8 THEN 'AT_INTRINSIC'
  WHEN price < {_model("0.001::DOUBLE")} - 1e-8 OR price > {_model("10::DOUBLE")} + 1e-8 THEN 'NO_BRACKET' ELSE 'SOLVE' END AS code FROM y),
sol AS (SELECT instrument, open_time, s, spot, strike, t, price, 0.001::DOUBLE AS low, 10::DOUBLE AS high, 0 AS k FROM z WHERE code = 'SOLVE'
  UNION ALL SELECT instrument, open_time, s, spot, strike, t, price, CASE WHEN dear THEN low ELSE mid END, CASE WHEN dear THEN mid ELSE high END, k + 1 FROM (SELECT *, {_model("mid")} > price AS dear FROM (SELECT *, (low + high) / 2 AS mid FROM sol WHERE k < 34))),
v AS (SELECT z.*, CASE code WHEN 'AT_INTRINSIC' THEN 0.001::DOUBLE WHEN 'SOLVE' THEN (low + high) / 2 END AS iv FROM z LEFT JOIN sol ON z.instrument = sol.instrument AND z.open_time = sol.open_time AND k = 34),
g AS (SELECT *, (ln(spot / strike) + (0.065::DOUBLE + iv * iv / 2) * t) / (iv * sqrt(t)) AS d1 FROM v),
told AS (SELECT *, CASE code WHEN 'NO_SPOT' THEN 'INSUFFICIENT_DATA' WHEN 'ZERO_PRICE' THEN 'INVALID_PRICE' WHEN 'EXPIRED' THEN 'SUCCESS' WHEN 'SOLVE' THEN 'SUCCESS' WHEN 'AT_INTRINSIC' THEN 'SUCCESS' ELSE 'NO_IV' END AS status, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM g)"""


def _greeks(s, d):
    return L.bar_greeks(S.option_bars(s, d), S.contracts(s, d), S.index_bars(s, d))


@query(GREEKS + """ SELECT instrument, open_time, coalesce(spot, 0) AS spot, price, round(t, 8) AS t, CASE WHEN spot IS NOT NULL THEN intr + 0.0 END AS intrinsic, status, CASE WHEN status <> 'SUCCESS' THEN code END AS error, CASE WHEN spot * pdf * sqrt(t) > 0.01 THEN round(iv, 6) END AS iv,
  CASE WHEN code = 'EXPIRED' THEN CASE WHEN s * (spot - strike) > 0 THEN s ELSE 0 END END AS step_delta FROM told""")
def bar_greeks(s, d):
    """The volatility is compared where the price tells it: a vega above 0.01."""
    x = _greeks(s, d)
    return x.select("instrument", "open_time", "spot", "price", F.round("t", 8).alias("t"), "intrinsic", "status", "error", F.when(F.col("vega") > 0.01, F.round("iv", 6)).alias("iv"), F.when((F.col("status") == "SUCCESS") & (F.col("t") <= 0), F.col("delta")).alias("step_delta"))


@query(GREEKS + " SELECT option_type, status, CASE WHEN status <> 'SUCCESS' THEN code END AS error, count(*) AS bars, count(DISTINCT instrument) AS instruments, round(avg(CASE WHEN spot * pdf * sqrt(t) > 0.01 THEN iv END), 5) AS mean_iv FROM told GROUP BY ALL")
def bar_greeks_status(s, d):
    return _greeks(s, d).groupBy("option_type", "status", "error").agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("instrument").alias("instruments"), F.round(F.avg(F.when(F.col("vega") > 0.01, F.col("iv"))), 5).alias("mean_iv"))
