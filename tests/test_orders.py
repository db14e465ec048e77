"""Order life cycles, execution requests and bulk exits on literal rows; the stream gives what the table gives."""

import pytest

from quantloom.operators import orders as O
from quantloom.sources import requests as S
from quantloom.streaming.orders import stream_life_cycles

EVENTS = "order_id long, step long, request long, target string"


def by_table(events):
    """Each order's events through the table of transitions, one after the other."""
    status, seen, out = {}, set(), []
    for order, step, request, target in sorted(events):
        before = status.get(order, "PENDING")
        if (order, request) in seen:
            outcome = "DUPLICATE_REQUEST"
        else:
            outcome = "APPLIED" if target in O.TRANSITIONS[before] else "INVALID_STATE_TRANSITION"
            status[order] = target if outcome == "APPLIED" else before
        seen.add((order, request))
        out.append((order, step, request, target, before, status.get(order, before), outcome))
    return sorted(out)


def test_every_pair_and_triple_of_targets(spark):
    names = list(O.TRANSITIONS)
    triples = [(a, b, c) for a in names for b in names for c in names]
    rows = [(i, n, request, t) for i, ts in enumerate(triples) for n, (t, request) in enumerate(zip(ts, (1, 2, 1 + i % 3)))]
    got = sorted(tuple(r) for r in O.life_cycles(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == by_table(rows) and {r[-1] for r in got} == {"APPLIED", "DUPLICATE_REQUEST", "INVALID_STATE_TRANSITION"}


def test_stream_gives_the_rows_of_the_table(spark, sf_dir, tmp_path):
    events = S.order_events(spark, sf_dir)
    for part in range(3):  # three batches: state is carried from one to the next
        events.filter(f"least(div(step - 1, 3), 2) = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        run = stream_life_cycles(read).writeStream.format("memory").queryName("life_cycles").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got, want = spark.table("life_cycles"), O.life_cycles(events)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


LEGS = "user_id long, client_order_id long, request_id long, at int, instrument long, action string, quantity long, price_c long"


def test_executions_all_or_nothing_and_replays(spark):
    rows = [
        (1, 1, 10, 1, 5, "buy", 2, 1002), (1, 1, 10, 1, 6, "sell", 1, None),  # one leg has no price: nothing is done
        (1, 1, 11, 2, 5, "buy", 2, 1002), (1, 1, 11, 2, 6, "sell", 1, 503),  # so the retry executes
        (1, 1, 12, 3, 7, "buy", 1, None),  # and this one is a replay, priced or not
        (2, 1, 13, 3, 7, "buy", 1, 0),  # no price is not above 0
        (2, 2, 14, 3, 7, "buy", 1, 10),
    ]
    legs = spark.createDataFrame(rows, LEGS)
    answers = O.executions(legs)
    got = {r["request_id"]: (r["outcome"], r["missing"], r["execution_id"], r["legs"], r["net_c"]) for r in answers.collect()}
    net = 2 * 1000 - 505  # 10.02 rounds to 10.00, 5.03 to 5.05
    assert got == {
        10: ("CHAIN_DATA_MISSING", 1, None, 0, None), 11: ("FILLED", 0, 11, 2, net), 12: ("DUPLICATE", 1, 11, 2, net),
        13: ("CHAIN_DATA_MISSING", 1, None, 0, None), 14: ("FILLED", 0, 14, 1, 10),
    }
    filled = sorted(tuple(r) for r in O.entry_orders(legs, answers).collect())
    assert filled == [(11, 1, 5, "buy", 2, 1000, -2000), (11, 1, 6, "sell", 1, 505, 505), (14, 2, 7, "buy", 1, 10, -10)]


def test_bulk_exit_closes_all_or_none(spark):
    rows = [
        (1, 1, "exit", 1, 0, 0, None),  # nothing is open
        (1, 2, "fill", 0, 5, 10, 100), (1, 3, "fill", 0, 6, -4, 50), (1, 4, "mark", 0, 6, 0, None),
        (1, 5, "exit", 2, 0, 0, None),  # 6 has no price: nothing closes, and the key may come again
        (1, 6, "mark", 0, 6, 0, 40), (1, 7, "mark", 0, 5, 0, 110),
        (1, 8, "exit", 2, 0, 0, None), (1, 9, "exit", 2, 0, 0, None), (1, 10, "exit", 3, 0, 0, None),
        (1, 11, "fill", 0, 5, 3, 200), (1, 12, "fill", 0, 5, -3, 210), (1, 13, "fill", 0, 5, -2, 220), (1, 14, "exit", 1, 0, 0, None), (1, 15, "exit", 4, 0, 0, None),
        (2, 1, "exit", 2, 0, 0, None),
    ]
    df = spark.createDataFrame(rows, "account long, n long, kind string, key long, instrument long, quantity long, price_c long")
    got = {(r["account"], r["n"]): tuple(r)[3:] for r in O.bulk_exits(df).collect()}
    done = (2, 0, 10 * 110 - 4 * 40, (10 * 10 + 4 * 10) / 100, 8)
    assert got == {
        (1, 1): ("NO_POSITIONS", 0, 0, 0, 0.0, 1), (1, 5): ("BULK_EXIT_CHAIN_DATA_MISSING", 0, 1, 0, 0.0, None), (1, 8): ("SUCCESS", *done), (1, 9): ("DUPLICATE", *done),
        (1, 10): ("NO_POSITIONS", 0, 0, 0, 0.0, 10), (1, 14): ("DUPLICATE", 0, 0, 0, 0.0, 1), (1, 15): ("SUCCESS", 1, 0, -440, 0.0, 15), (2, 1): ("NO_POSITIONS", 0, 0, 0, 0.0, 1),
    }


@pytest.mark.parametrize("price,want", [(1001, 1000), (1002, 1000), (1003, 1005), (5, 5), (2, 0)])
def test_tick_rounding(spark, price, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(O.tick_rounded(F.lit(price)).alias("p")).first()["p"] == want
