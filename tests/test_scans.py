"""Scans: filters that reach the files, pages, and what is attached to them."""

from datetime import datetime, timedelta

from quantloom.sources import scans as X

BEGIN = datetime(2024, 1, 1)


def rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], BEGIN + timedelta(hours=i // 2), i % 5) for i in range(60)], "n int, s string, at timestamp, v int")
    df.write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def test_filters_and_columns_reach_the_files(spark, tmp_path, capsys):
    X.scan(rows(spark, tmp_path), {"s": "a", "v": [1, 2]}, "at", BEGIN, BEGIN + timedelta(hours=9), ["n"]).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(x in pushed for x in ("EqualTo(s,a)", "In(v, [1,2])", "GreaterThanOrEqual(at", "LessThanOrEqual(at"))
    assert "struct<n:int,s:string,at:timestamp,v:int>" in plan  # only what is asked for and compared


def test_pages(spark, tmp_path):
    df = rows(spark, tmp_path)
    ask = lambda **k: [r["n"] for r in X.scan(df, {"s": "a", "v": None}, "at", order=["n"], **k).collect()]
    assert ask(limit=3) == [0, 2, 4] and ask(limit=3, newest_first=True) == [58, 56, 54] and ask(limit=2, offset=3) == [6, 8]
    assert ask(limit=0) == [0] and ask(limit=9, offset=-1)[0] == 0 and len(ask()) == 30 and ask(limit=5, offset=99) == []
    assert ask(since=BEGIN + timedelta(hours=28), limit=9) == [56, 58]
    assert sorted(r["v"] for r in X.distinct_values(df, "v", s="b").collect()) == [0, 1, 2, 3, 4]


def test_attach(spark, tmp_path):
    page = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    many = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, "c", None), (9, "z", 9)], "k int, x string, y int")
    got = {r["k"]: [tuple(c) for c in r["c"]] for r in X.attach(page, many, "k", "c", "x", "y").collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [("c", None)]}
