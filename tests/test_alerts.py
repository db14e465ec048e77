"""Alerts against a walk over every quote."""

import random

from quantloom.operators import alerts as A


def test_alerts_fire_at_the_first_quote_that_reaches_them(spark):
    rng = random.Random(9)
    quotes = [("ab"[i % 2], rng.randrange(60), i, rng.choice([None, *range(20)])) for i in range(300)] + [("c", 1, 900, 5), ("c", None, 901, 50)]
    alerts = [(i, rng.choice("abcd"), rng.choice(["above", "below", "near"]), rng.randrange(-2, 23), rng.choice([None, None, 7])) for i in range(200)]
    got = {r["i"]: (r["fired_at"], r["fired_price"]) for r in A.fired(spark.createDataFrame(alerts, "i int, k string, condition string, level int, triggered_at int"), spark.createDataFrame(quotes, "k string, at int, n int, price int"), "k", "at", "price", "n").collect()}
    want = {}
    for i, k, condition, level, done in alerts:
        mine = sorted((at, n, p) for kk, at, n, p in quotes if kk == k and p is not None and at is not None)
        hit = [(at, p) for at, _, p in mine if (condition == "above" and p >= level) or (condition == "below" and p <= level)]
        want[i] = hit[0] if hit and done is None else (None, None)
    assert got == want and any(v[0] is not None for v in want.values())


def test_records_are_few(spark):
    rng = random.Random(1)
    quotes = [("a", i, i, rng.random()) for i in range(5000)]
    assert A.records(spark.createDataFrame(quotes, "k string, at int, n int, price double"), "k", "at", "price", "n").count() < 60
