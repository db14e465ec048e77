"""Lots against a queue, trade details, exit targets with every error, and scenarios by hand."""

import math
import random
from collections import deque

import pytest

from quantloom.operators import lots as X
from quantloom.operators import scenarios as Z

SIDE = "k string, id long, quantity long, price_c long"


def by_queue(entries, exits):
    out = []
    for k in {r[0] for r in entries}:
        queue = deque([i, q, p] for kk, i, q, p in sorted(entries) if kk == k and q > 0)
        for _, i, q, p in (r for r in sorted(exits) if r[0] == k):
            while q > 0 and queue:
                take = min(q, queue[0][1])
                out.append((k, queue[0][0], i, take, queue[0][2], p, take * (p - queue[0][2])))
                q, queue[0][1] = q - take, queue[0][1] - take
                if not queue[0][1]:
                    queue.popleft()
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lots_against_a_queue(spark, seed):
    rng = random.Random(seed)
    side = lambda n: [(rng.choice("abc"), i, rng.randrange(0, 6), rng.randrange(1, 99)) for i in range(n)]
    entries, exits = side(60) + [("only", 1, 5, 5)], side(40)
    found = X.lots(spark.createDataFrame(entries, SIDE), spark.createDataFrame(exits, SIDE), "k")
    assert sorted(tuple(r) for r in found.collect()) == by_queue(entries, exits)


def test_details_show_the_last_lot_or_fall_back(spark):
    entries = [("a", 1, 5, 10), ("a", 2, 5, 20), ("a", 3, 1, 30), ("b", 1, 1, 1)]
    exits = [("a", 7, 3, 100), ("a", 8, 4, 200), ("a", 9, 0, 999)]
    e, x = spark.createDataFrame(entries, SIDE), spark.createDataFrame(exits, SIDE)
    got = {(r["k"], r["id"]): tuple(r)[4:] for r in X.details(e, X.lots(e, x, "k"), x, "k").collect()}
    assert got == {
        ("a", 1): (2, 5, 0, 3 * 90 + 2 * 190, 200, "ALLOCATION"), ("a", 2): (1, 2, 3, 2 * 180, 200, "ALLOCATION"),
        ("a", 3): (0, 0, 1, None, 200, "FALLBACK"), ("b", 1): (0, 0, 1, None, None, "OPEN"),
    }


REQUEST = "request_id long, user_id long, scope string, position_id long, strategy_id long, exposure_id long, option_type string, action string, mode string, quantity long"
REQUESTS = [
    ((1, "nowhere", None, None, None, None, None, "ALL", None), "INVALID_INTENT"),
    ((1, "position", 10, None, None, None, None, "most", None), "INVALID_INTENT"),
    ((1, "position", None, None, None, None, None, "ALL", None), "INVALID_INTENT"),
    ((1, "strategy", None, None, None, None, None, "ALL", None), "INVALID_INTENT"),
    ((1, "position", None, None, None, None, None, "QUANTITY", None), "MISSING_QUANTITY"),
    ((1, "position", 10, None, None, None, None, "QUANTITY", 0), "INVALID_QUANTITY"),
    ((1, "position", 99, None, None, None, None, "ALL", None), "TARGET_NOT_FOUND"),
    ((2, "position", 10, None, None, None, None, "ALL", None), "TARGET_NOT_FOUND"),
    ((1, "position", 12, None, None, None, None, "ALL", None), "TARGET_NOT_FOUND"),  # closed
    ((2, "strategy", None, 100, None, None, None, "ALL", None), "TARGET_NOT_FOUND"),
    ((1, "strategy", None, 101, None, None, None, "ALL", None), "NO_MATCHING_TARGETS"),  # its one leg is of a closed position
    ((1, "portfolio", None, None, 5, None, None, "ALL", None), "NO_MATCHING_TARGETS"),  # nothing is left of it
    ((1, " Position ", 10, None, None, None, None, "quantity", 2), "AMBIGUOUS_EXIT_QUANTITY"),
    ((1, "position", 10, None, 1, None, None, "QUANTITY", 4), "EXIT_QUANTITY_EXCEEDS_REMAINING"),
    ((1, "position", 10, None, 1, None, None, "QUANTITY", 3), [(1, "sell", 3)]),
    ((1, "portfolio", None, None, None, None, None, "ALL", None), [(1, "sell", 3), (2, "buy", 2), (3, "sell", 7)]),
    ((1, "strategy", None, 100, None, "put", None, "ALL", 50), [(3, "sell", 7)]),
    ((1, "portfolio", None, None, None, "C", "SELL", "ALL", None), [(2, "buy", 2)]),
    ((1, "portfolio", None, None, None, "future", "hold", "ALL", None), [(1, "sell", 3), (2, "buy", 2), (3, "sell", 7)]),  # what is no selector selects all
    ((None, "portfolio", None, None, None, None, None, "ALL", None), "NO_MATCHING_TARGETS"),
]


def test_exit_targets_and_every_error(spark):
    exposures = [(1, 1, 10, 100, "CE", "buy", 3), (2, 1, 10, 100, "CE", "sell", 2), (3, 1, 11, 100, "PE", "buy", 7), (4, 1, 12, 101, "PE", "buy", 7), (5, 1, 10, 100, "PE", "buy", 0), (6, 2, 20, 200, "PE", "buy", 1)]
    e = spark.createDataFrame(exposures, "id long, user_id long, position_id long, strategy_id long, option_type string, action string, remaining long")
    p = spark.createDataFrame([(10, 1, 1), (11, 1, 7), (12, 1, 0), (20, 2, 1)], "position_id long, user_id long, net long")
    s = spark.createDataFrame([(100, 1), (101, 1), (200, 2)], "strategy_id long, user_id long")
    rows = X.exit_targets(spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(REQUESTS)], REQUEST), e, p, s).collect()
    for i, (_, want) in enumerate(REQUESTS):
        mine = sorted((r for r in rows if r["request_id"] == i), key=lambda r: r["place"] or 0)
        if isinstance(want, str):
            assert [(r["error"], r["target"]) for r in mine] == [(want, None)], i
        else:
            assert [(r["target"], r["exit_side"], r["quantity"]) for r in mine] == want and [r["place"] for r in mine] == list(range(1, len(want) + 1)), i


LEGS = "strategy_id long, symbol string, valued_on string, spot double, type string, action string, strike long, expiry string, qty long, price double"


def price(kind, s, k, t, v, r=0.065):
    cdf = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
    if t <= 0:
        return max(s - k if kind == "CE" else k - s, 0)
    d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    call = s * cdf(d1) - k * math.exp(-r * t) * cdf(d1 - v * math.sqrt(t))
    return call if kind == "CE" else call - s + k * math.exp(-r * t)


def test_scenarios_precedence_partial_and_unmarked(spark):
    legs = [
        (1, "X", "2024-01-01", 100.0, "CE", "buy", 100, "2024-01-31", 2, 5.0), (1, "X", "2024-01-01", 100.0, "PE", "sell", 90, "2024-01-11", 1, 2.0),
        (2, "X", "2024-01-01", 100.0, "CE", "buy", 100, "2024-01-31", 1, 5.0), (2, "X", "2024-01-01", 100.0, "CE", "buy", 777, "2024-01-31", 1, 5.0),
        (3, "X", "2024-01-01", None, "CE", "buy", 100, "2024-01-31", 1, 5.0),
    ]
    marks = spark.createDataFrame([("X", 100, "CE", 0.2, 6.0), ("X", 90, "PE", 0.3, None)], "symbol string, strike long, type string, iv double, ltp double")
    df = spark.createDataFrame(legs, LEGS).selectExpr("*").withColumns({})
    df = df.selectExpr("strategy_id", "symbol", "to_date(valued_on) valued_on", "spot", "type", "action", "strike", "to_date(expiry) expiry", "qty", "price")
    named = {"now": {}, "abs": {"spot": 110, "spot_pct": 9}, "pct": {"spot_pct": 0.1, "spot_points": 9}, "pts": {"spot_points": -5}, "iv": {"iv": 0.5, "iv_shift": 9}, "low": {"iv_shift": -9}, "late": {"days": 20}, "gone": {"spot_pct": -1}}
    got = {(r["strategy_id"], r["scenario"]): r for r in Z.evaluate(df, marks, [Z.scenario(n, **f) for n, f in named.items()]).collect()}
    assert len(got) == 3 * len(named)
    for name, spot, call_iv, put_iv, days in (("now", 100, 0.2, 0.3, 0), ("abs", 110, 0.2, 0.3, 0), ("pct", 110, 0.2, 0.3, 0), ("pts", 95, 0.2, 0.3, 0), ("iv", 100, 0.5, 0.5, 0), ("low", 100, 1e-4, 1e-4, 0), ("late", 100, 0.2, 0.3, 20)):
        call, put = price("CE", spot, 100, max(30 - days, 0) / 365, call_iv), price("PE", spot, 90, max(10 - days, 0) / 365, put_iv)
        r = got[1, name]
        assert (r["spot"], r["value"], r["pnl"]) == (pytest.approx(spot), pytest.approx(2 * call - put, abs=2e-3), pytest.approx(2 * (call - 5) - (put - 2), abs=2e-3))
        assert not r["partial"] and r["now"] is None and r["change"] is None and r["mixed_expiry"]  # one leg has no market price
    two = got[2, "now"]
    assert two["partial"] and (two["unpriced"], two["unlisted"]) == (1, 1) and two["pnl"] == pytest.approx(price("CE", 100, 100, 30 / 365, 0.2) - 5, abs=2e-3)
    assert not got[2, "iv"]["partial"]  # one volatility for all prices the unlisted leg too
    three = got[3, "now"]
    assert (three["value"], three["pnl"], three["now"], three["partial"]) == (None, None, 6.0, True) and got[1, "gone"]["value"] is None
    cells = Z.matrix_extremes(Z.evaluate(df, marks, Z.grid()))
    by = {r["strategy_id"]: r for r in cells.collect()}
    assert (by[1]["cells"], by[1]["empty"], by[2]["empty"], by[2]["worst_cell"]) == (35, 0, 35, None) and by[1]["best_cell"] == "6:4"
