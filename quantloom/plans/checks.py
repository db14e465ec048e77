"""Registered queries: data quality and scalar market rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import quality
from ..sources import adapters as S
from .queries import BARS, CHAIN, GEX, _bars, query

STATUS = GEX + ", s AS (SELECT *, coalesce(reason, 'SUCCESS') AS status FROM reasoned)"


@query(STATUS + " SELECT status, count(*) AS n, count(DISTINCT (strike, option_type, expiry)) AS instruments, count(DISTINCT d) AS days FROM s GROUP BY status")
def quality_status_counts(s, d):
    return quality.status_counts(S.chain(s, d))


COVERAGE = STATUS + """, c AS (SELECT count(*) AS n, count(*) FILTER (oi > 0) AS positive_oi, count(*) FILTER (oi = 0) AS zero_oi, count(*) FILTER (reason IS NULL) AS success, count(*) FILTER (reason IS NOT NULL) AS excluded,
  count(DISTINCT d) AS days, count(DISTINCT d) FILTER (reason IS NULL) AS gex_days, count(*) FILTER (oi IS NULL OR gamma_c IS NULL) AS missing FROM s),
coverage AS (SELECT *, round(positive_oi::DOUBLE / n, 6) AS oi_coverage, round(zero_oi::DOUBLE / n * 100, 4) AS zero_oi_pct, round(success::DOUBLE / n, 6) AS gex_coverage, round(gex_days::DOUBLE / days, 6) AS timestamp_coverage,
  round(1 - missing::DOUBLE / n, 6) AS numerical_validity FROM c)"""
COMPLETE = """, z AS (SELECT d, count(*) AS size FROM chain GROUP BY d), m AS (SELECT list_sort(list(size))[1 + len(list(size)) // 2] AS median FROM z),
complete AS (SELECT count(*) AS chains, any_value(median) AS median, round(avg(size), 4) AS mean, count(*) FILTER (size * 2 >= median) AS complete, round(count(*) FILTER (size * 2 >= median)::DOUBLE / count(*), 6) AS chain_completeness FROM z, m)"""
BALANCE = """, b AS (SELECT count(DISTINCT (strike, expiry)) FILTER (option_type = 'CE') AS calls, count(DISTINCT (strike, expiry)) FILTER (option_type = 'PE') AS puts FROM chain),
balance AS (SELECT calls, puts, round(least(calls, puts)::DOUBLE / greatest(calls, puts), 6) AS balance FROM b)"""


@query(COVERAGE + " SELECT * FROM coverage")
def quality_coverage(s, d):
    return quality.coverage(S.chain(s, d))


@query(CHAIN + COMPLETE + " SELECT * FROM complete")
def quality_chain_completeness(s, d):
    return quality.completeness(S.chain(s, d))


@query(CHAIN + BALANCE + " SELECT * FROM balance")
def quality_side_balance(s, d):
    return quality.side_balance(S.chain(s, d))


@query(CHAIN + " SELECT expiry, count(*) AS zero_oi_rows FROM chain WHERE oi = 0 GROUP BY expiry")
def quality_affected_expiries(s, d):
    return quality.affected_expiries(S.chain(s, d))


@query(COVERAGE + COMPLETE + BALANCE + """, x AS (SELECT *, least(oi_coverage, gex_coverage, timestamp_coverage, numerical_validity) AS worst FROM coverage, complete, balance),
y AS (SELECT *, round(least((2 * oi_coverage + 2 * gex_coverage + 2 * timestamp_coverage + 2 * numerical_validity + chain_completeness + balance) / 10 * 100, worst * 100), 2) AS score FROM x)
SELECT score, CASE WHEN score >= 95 AND worst >= 0.95 THEN 'EXCELLENT' WHEN score >= 85 AND worst >= 0.85 THEN 'GOOD' WHEN score >= 70 AND worst >= 0.7 THEN 'DEGRADED' ELSE 'INSUFFICIENT' END AS grade,
  concat_ws('; ', CASE WHEN oi_coverage < 0.95 THEN 'oi_coverage ' || format('{:.1f}', oi_coverage * 100) || '%' END, CASE WHEN gex_coverage < 0.95 THEN 'gex_coverage ' || format('{:.1f}', gex_coverage * 100) || '%' END,
  CASE WHEN timestamp_coverage < 0.95 THEN 'timestamp_coverage ' || format('{:.1f}', timestamp_coverage * 100) || '%' END, CASE WHEN numerical_validity < 0.95 THEN 'numerical_validity ' || format('{:.1f}', numerical_validity * 100) || '%' END) AS warnings FROM y""")
def quality_score(s, d):
    return quality.score(S.chain(s, d))


@query(BARS + """, z AS (SELECT symbol, CAST(open_time AS DATE) AS d, count(*) AS n FROM bars GROUP BY ALL),
x AS (SELECT symbol, count(*) AS days, count(*) FILTER (n >= 24) AS complete, count(*) FILTER (n < 24) AS partial, CAST(sum(n) AS BIGINT) AS bars, round(sum(n) * 100.0::DOUBLE / (count(*) * 24), 4) AS average_pct FROM z GROUP BY symbol)
SELECT *, CASE WHEN bars < 200 THEN 'INSUFFICIENT' WHEN bars < 500 OR average_pct < 60 THEN 'LIMITED' WHEN bars < 3000 OR average_pct < 80 THEN 'ADEQUATE' ELSE 'STRONG' END AS readiness FROM x""")
def quality_readiness(s, d):
    return quality.coverage_summary(_bars(s, d))


@query("""t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, event_id AS arrival, value IS NULL OR value <= 0 AS bad FROM events),
x AS (SELECT *, coalesce(open_time < lag(open_time) OVER (PARTITION BY symbol, CAST(open_time AS DATE) ORDER BY arrival), false) AS back FROM t),
g AS (SELECT symbol, open_time, count(*) AS n, count(*) FILTER (NOT bad) AS ok, count(*) FILTER (back) AS back FROM x GROUP BY ALL)
SELECT symbol, CAST(sum(n) AS BIGINT) AS bars, CAST(sum(n - ok) AS BIGINT) AS invalid, CAST(sum(greatest(ok - 1, 0)) AS BIGINT) AS duplicates, CAST(sum(back) AS BIGINT) AS out_of_order, min(open_time) AS first, max(open_time) AS last FROM g GROUP BY symbol""")
def bars_batch_report(s, d):
    bad = F.col("value").isNull() | (F.col("value") <= 0)
    rows = S.table(s, d, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time"), F.col("event_id").alias("arrival"), F.when(bad, F.array(F.lit("NON_POSITIVE"))).otherwise(F.array().cast("array<string>")).alias("errors")
    )
    return quality.batch_report(rows)


MINUTE = "hour(t) * 60 + minute(t)"


@query(f"""e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' WHEN 2 THEN '' ELSE 'x' END AS stamp, event_id % 4 AS k, date_trunc('second', ts) AS ts FROM events),
c AS (SELECT event_id, CASE k WHEN 0 THEN ts + INTERVAL 330 MINUTE WHEN 1 THEN ts WHEN 2 THEN ts END AS t FROM e), x AS (SELECT *, {MINUTE} AS m, ({MINUTE}) * 60 + CAST(floor(second(t)) AS BIGINT) AS sec, isodow(t) AS dow, strftime(t, '%m-%d') IN ('01-26', '08-15', '10-02') AS fixed FROM c)
SELECT event_id, t AS wall, m BETWEEN 555 AND 930 AS in_session, m BETWEEN 927 AND 940 AS after_close, coalesce(strftime(t, '%Y-%m-%dT%H:%M:%S') || '+05:30', '') AS iso,
  CASE WHEN m < 555 THEN 'pre' WHEN m < 660 THEN 'morning' WHEN m < 780 THEN 'midday' WHEN m <= 930 THEN 'afternoon' WHEN m IS NULL THEN 'post' ELSE 'post' END AS part,
  dow < 6 AND NOT strftime(t, '%Y-%m-%d') IN ('2024-01-26', '2024-08-15', '2024-10-02') AS trading,
  CASE WHEN dow >= 6 THEN 'WEEKEND' WHEN strftime(t, '%Y-%m-%d') IN ('2024-01-26', '2024-08-15', '2024-10-02') THEN 'HOLIDAY' WHEN sec < 33300 THEN 'BEFORE_OPEN' WHEN sec > 55800 THEN 'AFTER_CLOSE' ELSE 'OPEN' END AS calendar,
  greatest(date_diff('second', t, CAST(CAST(t AS DATE) + 7 AS TIMESTAMP) + INTERVAL 10 HOUR) / (86400 * 365.25::DOUBLE), 0) AS years FROM x""")
def session_rules(s, d):
    """Wall clock of stamps in four shapes, session and calendar, by event."""
    holidays = ("2024-01-26", "2024-08-15", "2024-10-02")
    k = F.col("event_id") % 4
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, "+05:30").when(k == 2, "").otherwise("x"))
    t = F.col("wall")
    return S.table(s, d, "events").select("event_id", rules.wall_clock(stamp).alias("wall")).select(
        "event_id", "wall", rules.in_session(t).alias("in_session"), rules.after_close(t).alias("after_close"), rules.iso_offset(t).alias("iso"), rules.time_of_day(t).alias("part"),
        rules.trading_day(t, holidays).alias("trading"), rules.calendar_status(t, holidays).alias("calendar"), rules.years_to_expiry(t, F.date_add(t.cast("date"), 7)).alias("years"),
    )


@query("""e AS (SELECT event_id, event_id * 7 % 300000 AS s, value, CAST(event_id % 60 AS INTEGER) AS days FROM events)
SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' END AS label,
  s > 300 AS stale, CASE WHEN days < 5 THEN 'fresh' WHEN days < 10 THEN 'recent' WHEN days < 30 THEN 'stale' ELSE 'old' END AS freshness, CASE WHEN days <= 7 THEN 'NEAR' WHEN days <= 30 THEN 'MID' ELSE 'FAR' END AS bucket,
  CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 60 WHEN 2 THEN 15 ELSE 3 END AS interval FROM e""")
def label_rules(s, d):
    """Duration, staleness, freshness, expiry bucket and interval labels, by event."""
    seconds, days = F.col("event_id") * 7 % 300000, (F.col("event_id") % 60).cast("int")
    name = F.element_at(F.array(F.lit("3min"), F.lit("1hour"), F.lit("15min"), F.lit("day")), (F.col("event_id") % 4 + 1).cast("int"))
    return S.table(s, d, "events").select(
        "event_id", rules.duration_label(seconds).alias("label"), rules.quote_is_stale(seconds).alias("stale"), rules.chain_freshness(days).alias("freshness"), rules.dte_bucket(days).alias("bucket"), rules.interval_minutes(name).alias("interval")
    )


@query("""e AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(l_discount * 100) AS BIGINT) AS a, CAST(round(l_tax * 100) AS BIGINT) AS b, CAST(l_quantity AS BIGINT) AS q, l_linestatus FROM lineitem),
t AS (SELECT *, p // 5 AS k, p % 5 AS r FROM e)
SELECT l_orderkey, l_linenumber, CAST((CASE WHEN r < 2.5 THEN k ELSE k + 1 END) * 5 AS DECIMAL(20, 2)) / 100 AS tick, CAST((CASE WHEN r < 2.5 THEN k ELSE k + 1 END) * 5 AS DECIMAL(20, 2)) / 100 AS tick_up,
  CASE WHEN l_linestatus = 'F' THEN -p * q ELSE p * q END AS cash_c, CASE WHEN q = 0 THEN 0 ELSE (p - 100) * (q - 25) END AS unrealised_c,
  round((b - a) * 100.0::DOUBLE / nullif(a, 0), 8) AS change_pct, coalesce(round(abs(a)::DOUBLE / nullif(abs(a) + abs(b), 0), 8), 0) AS magnitude,
  a - b AS difference, round(a::DOUBLE / nullif(b, 0), 8) AS ratio, round((a - b)::DOUBLE / nullif(abs(b), 0), 8) AS relative, round((a - b)::DOUBLE / nullif(abs(a) + abs(b), 0), 8) AS normalised,
  CASE WHEN a > b THEN 'first' WHEN a < b THEN 'second' ELSE 'equal' END AS dominant, CASE WHEN a - b > 0 THEN 'up' WHEN a - b < 0 THEN 'down' ELSE 'flat' END AS direction FROM t""")
def number_rules(s, d):
    """Tick rounding, cash, unrealised result and comparisons, by order line."""
    p = F.round(F.col("l_extendedprice") * 100).cast("long")
    a, b, q = F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long"), F.col("l_quantity").cast("long")
    action = F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell")
    both = rules.compare(a, b)
    price = p.cast("decimal(20,2)") / 100
    return S.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", rules.tick(price).alias("tick"), rules.tick_up(price).alias("tick_up"), rules.cash_flow_c(action, p, q).alias("cash_c"),
        rules.unrealised_c(q - 25, F.lit(100).cast("long"), p).alias("unrealised_c"), F.round(rules.percent_change(a.cast("double"), b.cast("double")), 8).alias("change_pct"), F.round(rules.normalised(a, b), 8).alias("magnitude"),
        both["difference"].alias("difference"), *(F.round(both[k], 8).alias(k) for k in ("ratio", "relative", "normalised")), both["dominant"].alias("dominant"), rules.direction((a - b).cast("double")).alias("direction"),
    )


@query("""p AS (SELECT p_partkey, p_name, p_brand, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'CALL' WHEN 1 THEN 'PUT' WHEN 2 THEN 'CALL' WHEN 3 THEN 'PUT' END AS side, CASE WHEN k <> 4 THEN 'NSE' END AS exchange, CASE WHEN k <> 4 THEN 'FO' END AS segment, CASE WHEN k <> 4 THEN p_partkey || 'CE' END AS token,
  CASE k WHEN 0 THEN ['a', p_brand] WHEN 1 THEN [p_brand] END AS tags, CASE k WHEN 4 THEN NULL ELSE '["' || p_brand || '"]' END AS joined,
  CASE WHEN k = 0 THEN chr(34) || p_name || ', ' || repeat(chr(34), 2) || 'q' || repeat(chr(34), 3) ELSE p_name END AS csv, sha256(p_partkey || chr(10) || p_brand || chr(10)) AS fingerprint FROM p""")
def text_rules(s, d):
    """Sides, instrument keys, tags, CSV fields and fingerprints, by part."""
    k = F.col("p_partkey") % 5
    kind = F.element_at(F.array(*(F.lit(x) for x in ("ce", " PE ", "Call", "put", "XX"))), (k + 1).cast("int"))
    key = F.concat(F.when(k == 4, "NSE-FO|").otherwise("NSE_FO|"), F.col("p_partkey").cast("string"), F.lit("CE"))
    brand = F.concat(F.lit('"'), "p_brand", F.lit('"'))
    raw = F.when(k == 0, F.concat(F.lit('["a", "", '), brand, F.lit("]"))).when(k == 1, F.concat(F.lit("["), brand, F.lit(", null]"))).when(k == 2, "not json").when(k == 3, " ")
    tags = F.when(k == 4, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" ")))
    parts = rules.instrument_parts(key)
    return S.table(s, d, "part").select(
        "p_partkey", rules.side(kind).alias("side"), parts["exchange"].alias("exchange"), parts["segment"].alias("segment"), parts["token"].alias("token"), rules.parse_tags(raw).alias("tags"), rules.join_tags(tags).alias("joined"),
        rules.csv_field(F.when(k == 0, F.concat("p_name", F.lit(', "q"'))).otherwise(F.col("p_name"))).alias("csv"), rules.fingerprint(F.col("p_partkey"), F.col("p_brand"), F.lit(None)).alias("fingerprint"),
    )
