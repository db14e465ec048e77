"""Sinks written twice, by two at once, and with rows that cannot be stored."""

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.sinks import keyed as K

ROWS = "k string, month string, v long, w double, n long"


def put(spark, table, rows, log=None, **more):
    return K.upsert(table, spark.createDataFrame(rows, ROWS), ["k"], "month", ["v", "w"], "n", log, **more)


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table}/month=*/*.parquet")}


def held(spark, table):
    return sorted(tuple(r) for r in spark.read.schema("k string, v long, w double, month string").parquet(table).collect())


def test_upsert_twice_and_by_partition(spark, tmp_path):
    table, log = f"{tmp_path}/t", f"{tmp_path}/log"
    first = [("a", "2024-01", 1, 1.0, 0), ("a", "2024-01", 2, 1.0, 5), ("a", "2024-01", 9, 1.0, 3), ("b", "2024-01", 1, None, 0), ("c", "2024-02", 1, 1.0, 0), (None, "2024-02", 1, 1.0, 0), ("d", None, 1, 1.0, 0)]
    assert put(spark, table, first, log, run_id="one") == {"fetched": 7, "rejected": 2, "inserted": 3, "updated": 0, "unchanged": 0}
    assert held(spark, table) == [("a", 2, 1.0, "2024-01"), ("b", 1, None, "2024-01"), ("c", 1, 1.0, "2024-02")]  # the last to come wins
    before = files(table)
    second = [("a", "2024-01", 3, 1.0, 0), ("b", "2024-01", 1, None, 0), ("e", "2024-03", 1, 1.0, 0)]
    assert put(spark, table, second, log, run_id="two") == {"fetched": 3, "rejected": 0, "inserted": 1, "updated": 1, "unchanged": 1}
    want = [("a", 3, 1.0, "2024-01"), ("b", 1, None, "2024-01"), ("c", 1, 1.0, "2024-02"), ("e", 1, 1.0, "2024-03")]
    assert held(spark, table) == want
    untouched = {f: t for f, t in before.items() if "2024-02" in f}
    assert untouched and untouched.items() <= files(table).items()
    assert put(spark, table, second, log, run_id="three") == {"fetched": 3, "rejected": 0, "inserted": 0, "updated": 0, "unchanged": 3} and held(spark, table) == want
    logged = {r["run_id"]: (r["status"], r["rows_fetched"], r["rows_inserted"], r["rows_updated"], r["rows_rejected"]) for r in spark.read.parquet(log).collect()}
    assert logged == {"one": ("PARTIAL", 7, 3, 0, 2), "two": ("SUCCESS", 3, 1, 1, 0), "three": ("SUCCESS", 3, 0, 0, 0)}


def test_two_writers_and_a_failing_one(spark, tmp_path):
    table, log = f"{tmp_path}/t", f"{tmp_path}/log"
    put(spark, table, [("a", "2024-01", 1, 1.0, 0)])
    with K.locked(spark, table), pytest.raises(K.Busy):
        put(spark, table, [("a", "2024-01", 2, 1.0, 0)], log, run_id="second")
    before = files(table)
    bad = spark.createDataFrame([("a", "2024-01", 2, 1.0, 0)], ROWS).withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        K.upsert(table, bad, ["k"], "month", ["v", "w"], "n", log, run_id="bad")
    assert files(table) == before and held(spark, table) == [("a", 1, 1.0, "2024-01")] and not os.path.exists(f"{table}.lock")
    assert {(r["run_id"], r["status"]) for r in spark.read.parquet(log).collect()} == {("second", "FAILED"), ("bad", "FAILED")}
    assert put(spark, table, [("a", "2024-01", 2, 1.0, 0)])["updated"] == 1


def test_observations(spark, tmp_path):
    at = datetime(2024, 1, 1)
    ok = (" nifty ", "2024-01-25", "100", "CALL", "0.2", "99.5", "s" * 40, at)
    change = lambda **c: tuple(c.get(n, v) for n, v in zip(("symbol", "expiry", "strike", "type", "iv", "spot", "source", "at"), ok))
    rows = [ok, change(spot="n/a", source=""), change(iv="0"), change(iv=None), change(iv="NaN"), change(symbol="  "), change(symbol=None), change(expiry=""), change(type="future"), change(type=None), change(strike="x"), change(at=None, type="put")]
    df = spark.createDataFrame(rows, "symbol string, expiry string, strike string, option_type string, iv string, spot string, source string, observed_at timestamp")
    table, log = f"{tmp_path}/iv", f"{tmp_path}/log"
    assert K.append_observations(table, df, log, "r") == {"fetched": 12, "inserted": 3, "rejected": 9}
    assert K.append_observations(table, df.limit(0)) == {"fetched": 0, "inserted": 0, "rejected": 0}
    got = sorted(spark.read.parquet(table).collect(), key=lambda r: (r["option_type"], r["spot"] is None))
    assert [(r["symbol"], r["strike"], r["option_type"], r["iv"], r["spot"], r["source"]) for r in got] == [("NIFTY", 100.0, "call", 0.2, 99.5, "s" * 32), ("NIFTY", 100.0, "call", 0.2, None, "chain"), ("NIFTY", 100.0, "put", 0.2, 99.5, "s" * 32)]
    assert all(r["observed_at"] is not None for r in got) and spark.read.parquet(log).first()["rows_rejected"] == 9


def test_retention_by_group_and_from_now(spark, monkeypatch):
    from quantloom.operators import landing

    day = lambda n: datetime(2024, 1, n)
    df = spark.createDataFrame([("a", day(1)), ("a", day(8)), ("a", day(9)), ("b", day(2)), ("b", day(3)), ("b", None), (None, day(9))], "g string, at timestamp")
    want = [("a", 8), ("a", 9), ("b", 2), ("b", 3)]
    for few in (10, 1):  # the latest times go to the rows, or both meet
        monkeypatch.setattr(landing, "FEW_GROUPS", few)
        assert sorted((r["g"], r["at"].day) for r in landing.retained(df, "at", 2, "g").collect()) == want
    assert sorted(r["at"].day for r in landing.retained(df, "at", 0, now=F.lit(day(10))).collect()) == [9, 9]


def test_last_write_wins(spark):
    from quantloom.operators import bars

    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 7, "y"), ("a", 2, 1, None), ("b", 1, 1, "z")], "s string, t int, n int, v string")
    got = bars.last_write_wins(df, ["s", "t"], "n")
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [("a", 1, 7, "y"), ("a", 2, 1, None), ("b", 1, 1, "z")]
