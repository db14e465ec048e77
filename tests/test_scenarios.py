"""A scenario grid's extremes: equal to its cells one by one, without a row for each cell; and the marks they start from."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import scenarios as Z
from quantloom.plans import QUERIES
from quantloom.sources import scenarios as S
from quantloom.sources.adapters import chain

LEGS = "strategy_id long, symbol string, valued_on date, spot double, type string, action string, strike long, expiry date, qty long, price double"


@pytest.fixture
def small_batches(spark):
    """A strategy's legs reach over several batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    yield
    spark.conf.set(key, before)


def book(spark, seed):
    rng = random.Random(seed)
    some = lambda v, odd: None if odd and rng.random() < 0.1 else v
    rows = []
    for name in [None, *range(40)]:
        spot, odd = some(rng.choice([100.0, 90.5]), True), rng.random() < 0.4
        for _ in range(rng.choice([1, 2, 3, 4, 25])):
            rows.append((name, "X", some("2024-01-01", odd), spot, some(rng.choice(["CE", "PE"]), odd), some(rng.choice(["buy", "sell"]), odd), some(rng.choice([80, 90, 100, 110, *([777] if odd else [])]), odd), some(rng.choice(["2023-12-01", "2024-01-08", "2024-02-01"]), odd), some(rng.randrange(4), odd), some(rng.choice([0.0, 1.25, 20.0]), odd)))
    rng.shuffle(rows)
    legs = spark.createDataFrame(rows, LEGS.replace(" date", " string"))
    marks = [("X", k, t, None if (k, t) == (80, "PE") else 0.2 + k / 1000, 6.0) for k in (80, 90, 100, 110) for t in ("CE", "PE")]
    return legs.withColumns({c: F.to_date(c) for c in ("valued_on", "expiry")}), spark.createDataFrame(marks, "symbol string, strike long, type string, iv double, ltp double"), rows


@pytest.mark.parametrize("axis", ["spot_iv", "spot_time"])
def test_extremes_are_those_of_the_cells(spark, small_batches, axis):
    legs, marks, rows = book(spark, 5)
    want = {r["strategy_id"]: r for r in Z.matrix_extremes(Z.evaluate(legs, marks, Z.grid(axis))).collect()}
    found = Z.extremes(legs, marks, Z.grid(axis)).collect()
    assert len(found) == 41 and {r["strategy_id"]: r for r in found} == want
    assert {r["empty"] for r in found} == {0, 35} and {r["cells"] for r in found} == {35}


def test_totals_do_not_depend_on_batches(spark, small_batches):
    legs, marks, rows = book(spark, 6)
    got = {r["strategy_id"]: r for r in Z.evaluate(legs, marks, [Z.scenario("flat", spot=95, iv=0.5, days=99)]).collect()}
    for name in {r[0] for r in rows}:  # all have expired, so every leg is worth what it has inside
        value = pnl = 0
        for _, _, _, _, kind, action, strike, _, qty, price in (r for r in rows if r[0] == name):
            unit = 0 if strike is None else max(95 - strike if kind == "CE" else strike - 95, 0)
            scale = (1 if action == "buy" else -1) * (qty or 0)
            value, pnl = value + scale * unit, pnl + (scale * (unit - price) if price is not None else 0)
        r = got[name]
        assert (r["legs"], r["unpriced"], r["spot"], r["value"], r["pnl"]) == (sum(x[0] == name for x in rows), 0, 95, value, pnl), name


def test_first_of_equal_cells_by_name_and_no_number(spark):
    legs = [(1, "X", "2024-01-01", 100.0, "CE", "buy", 90, "2024-01-01", 1, 5.0), (2, "X", "2024-01-01", 100.0, "CE", "buy", 90, "2024-01-01", 1, float("nan"))]
    legs = spark.createDataFrame(legs, LEGS.replace(" date", " string")).withColumns({c: F.to_date(c) for c in ("valued_on", "expiry")})
    marks = spark.createDataFrame([("X", 90, "CE", 0.2, 6.0)], "symbol string, strike long, type string, iv double, ltp double")
    cells = [Z.scenario(n, spot=s) for n, s in (("b", 100), ("a10", 100), ("a9", 100), ("c", 99), ("aa", 99))]
    one, two = sorted(Z.extremes(legs, marks, cells).collect())
    assert tuple(one) == (1, 5, 0, 4.0, "aa", 5.0, "a10")
    assert str(tuple(two)) == "(2, 5, 0, nan, 'a10', nan, 'a10')" == str(tuple(Z.matrix_extremes(Z.evaluate(legs.filter("strategy_id = 2"), marks, cells)).first()))


def test_no_cell_is_a_row_in_scenario_extremes(spark, sf_dir):
    plan = QUERIES["scenario_extremes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_legs_joined_by_strategy_are_not_shuffled_again(spark, sf_dir):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        plan = QUERIES["scenario_extremes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning(strategy_id#") == 2  # orders and their lines


def test_marks_are_the_last_quotes(spark, sf_dir):
    q = chain(spark, sf_dir).filter("option_type <> 'XX' and strike % 350 <> 0").groupBy("symbol", "strike", F.col("option_type").alias("type")).agg(F.max(F.struct("d", "ltp", "iv_bp")).alias("q"))
    want = q.select("symbol", "strike", "type", F.when(F.col("q.ltp") % 11 != 0, F.col("q.iv_bp") / 10_000.0), F.when(F.col("q.ltp") % 13 != 0, F.col("q.ltp").cast("double")))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(S.marks(spark, sf_dir)) == rows(want) and rows(want)
