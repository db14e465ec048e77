"""Every query with SQL against DuckDB on the same tables, and operators on literal rows."""

import glob
import math
import os
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quantloom.functions import pricing
from quantloom.operators import bars, gex, portfolio, research
from quantloom.plans import QUERIES, SQL
from quantloom.streaming.ticks import stream_bars


def _plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_net_positions_by_hand(spark):
    rows = [(1, 1, "buy", 10, 100), (1, 2, "buy", 10, 200), (1, 3, "sell", 5, 250), (1, 4, "sell", 25, 100), (2, 1, "sell", 3, 50)]
    got = {r["instrument"]: tuple(r)[1:] for r in portfolio.net_positions(spark.createDataFrame(rows, "instrument int, seq int, action string, quantity long, price_c long")).collect()}
    assert got == {1: (-10, 1.0, -2.5), 2: (-3, 0.5, 0.0)}


def test_net_positions_reconcile(spark, sf_dir):
    a = {r["instrument"]: r["net_quantity"] for r in QUERIES["net_positions"](spark, sf_dir).collect()}
    assert a == {r["instrument"]: r["net"] for r in QUERIES["reconcile_cash"](spark, sf_dir).collect()}


def test_fifo_by_hand(spark):
    rows = [(1, 1, "buy", 10, 100), (1, 2, "buy", 10, 200), (1, 3, "sell", 15, 300)]
    r = portfolio.fifo_allocation(spark.createDataFrame(rows, "instrument int, seq int, action string, quantity long, price_c long")).first()
    assert (r["matched"], r["gain_c"]) == (15, 10 * 200 + 5 * 100)


@pytest.mark.parametrize("sigma", [0.10, 0.15, 0.18, 0.25, 0.40])
def test_implied_vol_round_trip(spark, sigma):
    df = spark.createDataFrame([("CE", 25000.0, 25000.0, 30 / 365.25), ("PE", 25000.0, 24500.0, 30 / 365.25)], "o string, s double, k double, t double")
    price = pricing.greeks(F.col("o"), F.col("s"), F.col("k"), F.col("t"), F.lit(sigma))["price"]
    for r in df.withColumn("p", price).select(pricing.implied_vol(F.col("o"), F.col("s"), F.col("k"), F.col("t"), F.col("p")).alias("x")).collect():
        assert r["x"]["status"] == "SUCCESS" and math.isclose(r["x"]["iv"], sigma, abs_tol=1e-4)


def test_implied_vol_guards(spark):
    df = spark.createDataFrame([("CE", 0.0, 5.0), ("CE", 0.1, 0.0), ("CE", 0.1, 10.0), ("CE", 0.1, 30000.0)], "o string, t double, p double")
    got = df.select(pricing.implied_vol(F.col("o"), F.lit(25000.0), F.lit(24000.0), F.col("t"), F.col("p"))["status"].alias("s")).collect()
    assert [r["s"] for r in got] == ["EXPIRED", "INVALID_PRICE", "BELOW_INTRINSIC", "ABOVE_MAX"]


def test_eligibility_order(spark):
    rows = [("XX", 1, 1, 1, 1), ("CE", 0, 1, 1, 1), ("CE", 1, None, 1, 1), ("CE", 1, 1, -1, 1), ("CE", 1, 1, 0, None), ("PE", 1, 1, 0, 0), ("PE", 1, 1, 0, 1)]
    got = spark.createDataFrame(rows, "option_type string, spot long, strike long, gamma_c long, oi long").select(gex.exclusion_reason().alias("r")).collect()
    assert [r["r"] for r in got] == ["INVALID_TYPE", "INVALID_SPOT", "INVALID_STRIKE", "INVALID_GAMMA", "MISSING_OI", "ZERO_OI", None]


def test_change_guards_zero(spark):
    daily = spark.createDataFrame([("S", date(2024, 1, i + 1), n) for i, n in enumerate([0, 50, 100])], "symbol string, d date, net_c long")
    assert [r["gex_change"] for r in gex.change(daily).orderBy("d").collect()] == [None, None, 50 * gex.SCALE]
    assert [r["gex_change"] for r in gex.change(daily, zero_is_missing=False).orderBy("d").collect()] == [None, 50 * gex.SCALE, 50 * gex.SCALE]


def test_as_of_without_match(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 7.0), ("a", 5, 8.0)], "k string, at int, v double")
    got = {(r["k"], r["t"]): r["asof_v"] for r in bars.as_of(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 8.0, ("b", 5): None}


def test_validation_codes(spark):
    rows = [("x", datetime(2024, 1, 1), 10.0, 9.0, 8.0, 9.5, 0), ("x", datetime(2024, 1, 1, 1), 10.0, 10.1, 10.0, 10.0, 0), ("x", datetime(2024, 1, 1, 2), 0.0, 1.0, 0.0, 1.0, 5)]
    got = bars.validate(spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume long")).collect()
    assert [(r["errors"], r["warnings"]) for r in got] == [(["HIGH_TOO_LOW"], []), ([], ["ZERO_VOLUME"]), (["NON_POSITIVE"], [])]


def test_adjusted_p_values(spark):
    got = {r["n"]: (r["bh"], r["holm"]) for r in research.adjust(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double"), "p", "n").collect()}
    assert got == {"a": (0.03, 0.03), "b": (0.04, 0.06), "c": (0.04, 0.06)}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
    ticks.write.parquet(f"{tmp_path}/in")
    stream = stream_bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    a, b = spark.table("bars_out"), stream_bars(ticks)
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()
