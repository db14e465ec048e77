"""Order life cycles, execution requests and bulk exits.

Requests carry a key of their client. A key that has been answered is a replay: it gets the first
answer again and changes nothing. What fails is not an answer, so it may be asked again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The statuses that each status may change to.
TRANSITIONS = {
    "PENDING": ("FILLED", "PARTIALLY_FILLED", "CANCELLED", "REJECTED"),
    "PARTIALLY_FILLED": ("FILLED", "CANCELLED", "REJECTED"),
    "FILLED": (),
    "CANCELLED": (),
    "REJECTED": (),
}
FINAL = tuple(s for s, after in TRANSITIONS.items() if not after)
ANSWERS = "order_id long, step long, request long, target string, before string, after string, outcome string"


def life_cycles(events: DataFrame) -> DataFrame:
    """``ANSWERS`` to ``order_id, step, request, target``: the status before and after each step.

    Statuses only move on, so an order takes at most two steps: the first new one to a status that
    follows PENDING, and the first new one to a final status. Where these are tells every status.
    """
    order = Window.partitionBy("order_id")
    fresh = F.col("step") == F.min("step").over(Window.partitionBy("order_id", "request"))
    x = events.withColumn("fresh", fresh)
    at = F.struct("step", "target")
    x = x.withColumn("first", F.min(F.when(F.col("fresh") & F.col("target").isin(*TRANSITIONS["PENDING"]), at)).over(order)).withColumn("last", F.min(F.when(F.col("fresh") & F.col("target").isin(*FINAL), at)).over(order))
    status = lambda past: F.when(past("last"), F.col("last.target")).when(past("first"), F.col("first.target")).otherwise("PENDING")
    before, after = status(lambda c: F.col("step") > F.col(f"{c}.step")), status(lambda c: F.col("step") >= F.col(f"{c}.step"))
    outcome = F.when(~F.col("fresh"), "DUPLICATE_REQUEST").when(F.col("before") != F.col("after"), "APPLIED").otherwise("INVALID_STATE_TRANSITION")
    return x.select("order_id", "step", "request", "target", "fresh", before.alias("before"), after.alias("after")).select("order_id", "step", "request", "target", "before", "after", outcome.alias("outcome"))


def life_cycle_counts(answers: DataFrame) -> DataFrame:
    """How many orders end in each status, and what they were asked on the way."""
    last = answers.groupBy("order_id").agg(F.max_by("after", "step").alias("status"), *(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("APPLIED", "DUPLICATE_REQUEST", "INVALID_STATE_TRANSITION")))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("orders"), *(F.sum(c).alias(c) for c in ("applied", "duplicate_request", "invalid_state_transition")))


def tick_rounded(price_c: F.Column, tick_c: int = 5) -> F.Column:
    """A price in cents on the tick grid, halves up."""
    return F.floor((price_c + tick_c / 2) / tick_c) * tick_c


def executions(legs: DataFrame) -> DataFrame:
    """One answer a request: all of its legs are filled at once, or none.

    FILLED: every leg has a price and the key had no answer. DUPLICATE: the key was answered before, by
    ``execution_id``, whose legs and net are given again. CHAIN_DATA_MISSING: legs lack a price, nothing is done.
    """
    price = tick_rounded(F.col("price_c"))
    sign = F.when(F.col("action") == "buy", 1).otherwise(-1)
    asked = legs.groupBy("user_id", "client_order_id", "request_id", "at").agg(
        F.count(F.lit(1)).alias("legs"), F.count_if(F.coalesce(F.col("price_c") <= 0, F.lit(True))).alias("missing"), F.sum(sign * price * F.col("quantity")).cast("long").alias("net_c")
    )
    full = F.when(F.col("missing") == 0, F.struct("at", "request_id", "legs", "net_c"))
    first = F.min(full).over(Window.partitionBy("user_id", "client_order_id"))
    mine, before = F.col("first.request_id") == F.col("request_id"), F.struct("at", "request_id") > F.struct("first.at", "first.request_id")
    outcome = F.when(mine, "FILLED").when(F.col("first").isNotNull() & before, "DUPLICATE").otherwise("CHAIN_DATA_MISSING")
    told = F.col("outcome") != "CHAIN_DATA_MISSING"
    x = asked.withColumn("first", first).withColumn("outcome", outcome)
    return x.select("request_id", "user_id", "client_order_id", "outcome", "missing", F.when(told, F.col("first.request_id")).alias("execution_id"), F.when(told, F.col("first.legs")).otherwise(F.lit(0)).alias("legs"), F.when(told, F.col("first.net_c")).alias("net_c"))


def entry_orders(legs: DataFrame, answers: DataFrame) -> DataFrame:
    """The filled orders of executed requests with their cash flow; replays and failures make none."""
    done = answers.filter("outcome = 'FILLED'").select("request_id")
    price = tick_rounded(F.col("price_c")).cast("long")
    flow = F.when(F.col("action") == "buy", -1).otherwise(1) * price * F.col("quantity")
    return legs.join(done, "request_id", "left_semi").select("request_id", "user_id", "instrument", "action", "quantity", price.alias("fill_c"), flow.cast("long").alias("cash_c"))


class _Account:
    """Open positions, last prices and answered exits of one account."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[int, float]] = {}
        self.price: dict[int, int | None] = {}
        self.answered: dict[int, tuple] = {}

    def fill(self, instrument: int, quantity: int, price: int) -> None:
        net, average = self.held.get(instrument, (0, 0.0))
        if net == 0 or (net > 0) == (quantity > 0):
            average = (average * abs(net) + price * abs(quantity)) / abs(net + quantity)
        elif abs(quantity) > abs(net):
            average = float(price)
        self.price[instrument] = price
        if net + quantity:
            self.held[instrument] = net + quantity, average
        else:
            self.held.pop(instrument, None)

    def exit(self, n: int, key: int) -> tuple:
        """(outcome, exited, missing, cash, realised, the exit that is answered)."""
        if key in self.answered:
            return ("DUPLICATE", *self.answered[key][1:])
        missing = sum(self.price[i] is None for i in self.held)
        if missing:
            return "BULK_EXIT_CHAIN_DATA_MISSING", 0, missing, 0, 0.0, None
        cash, realised = 0, 0.0
        for i in sorted(self.held):
            net, average = self.held[i]
            cash += net * self.price[i]
            realised += (self.price[i] - average) * net
        self.answered[key] = ("SUCCESS" if self.held else "NO_POSITIONS", len(self.held), 0, cash, realised / 100, n)
        self.held = {}
        return self.answered[key]


EXITS = "account long, n long, key long, outcome string, exited long, missing long, cash_c long, realized double, answered_by long"
_EXITS = pa.schema([("account", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("outcome", pa.string()), ("exited", pa.int64()), ("missing", pa.int64()), ("cash_c", pa.int64()), ("realized", pa.float64()), ("answered_by", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    who, state = None, _Account()
    for batch in batches:
        out = []
        for account, n, kind, key, instrument, quantity, price in zip(*(c.to_pylist() for c in batch.columns)):
            if account != who:
                who, state = account, _Account()
            if kind == "fill":
                state.fill(instrument, quantity, price)
            elif kind == "mark":
                state.price[instrument] = price
            else:
                out.append((account, n, key, *state.exit(n, key)))
        columns = zip(*out) if out else ((),) * len(_EXITS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EXITS)], schema=_EXITS)


def bulk_exits(events: DataFrame) -> DataFrame:
    """``EXITS``: what each bulk exit of an account did. It closes every open position at its last price, or none.

    Whether an exit works depends on what the one before left open, so an account's events stream in
    order through one task, which holds its open instruments and answered keys only.
    """
    columns = ("account", "n", "kind", "key", "instrument", "quantity", "price_c")
    ordered = events.select(*columns).repartition("account").sortWithinPartitions("account", "n")
    return ordered.mapInArrow(_fold, EXITS).withColumn("realized", F.round("realized", 4))


def exit_counts(exits: DataFrame) -> DataFrame:
    """Requested, exited and failed by outcome."""
    return exits.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"), F.sum("exited").alias("exited"), F.sum("missing").alias("missing"), F.sum("cash_c").alias("cash_c"))
