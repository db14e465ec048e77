"""Ledgers: exposures and their allocation, strategy life cycles, portfolio summaries and concentration.

Money is in cents and quantities are whole, so that every sum is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pct(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def allocate_exits(exposures: DataFrame, exits: DataFrame) -> DataFrame:
    """Exits (position, quantity) against open exposures (position, id, side, remaining), first in, first out.

    The dominant side of a position is the one with more remaining; only its exposures are closed, in
    the order of their ids, each by at most what remains. An exit fails as a whole: NO_EXPOSURE,
    MIXED_SIDES (both sides have the same amount) or INSUFFICIENT.
    """
    signed = F.when(F.col("side") == "buy", F.col("remaining")).otherwise(-F.col("remaining"))
    totals = exposures.filter("remaining > 0").groupBy("position").agg(F.sum(signed).alias("net"), F.sum("remaining").alias("gross"))
    x = exits.join(totals, "position", "left")
    side = F.when(F.col("net") > 0, "buy").otherwise("sell")
    held = (F.col("gross") + F.abs("net")) / 2
    error = F.when(F.col("net").isNull(), "NO_EXPOSURE").when(F.col("net") == 0, "MIXED_SIDES").when(F.col("quantity") > held, "INSUFFICIENT")
    x = x.select("position", "quantity", side.alias("side"), error.alias("error"))
    before = Window.partitionBy("position").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    open_ = exposures.filter("remaining > 0").join(x.filter("error is null").drop("error"), ["position", "side"])
    taken = F.least(F.col("remaining"), F.greatest(F.col("quantity") - F.coalesce(F.sum("remaining").over(before), F.lit(0)), F.lit(0)))
    done = open_.withColumn("taken", taken).filter("taken > 0")
    failed = x.filter("error is not null").select("position", F.lit(None).cast(done.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("taken"), F.lit(None).cast("long").alias("left"), "error")
    return done.select("position", "id", "taken", (F.col("remaining") - F.col("taken")).alias("left"), F.lit(None).cast("string").alias("error")).unionByName(failed)


def reconcile_exposures(exposures: DataFrame, fills: DataFrame) -> DataFrame:
    """Signed exposures against the net of the fills, by position, and ids that occur more than once."""
    sign = lambda c, q: F.sum(F.when(F.col(c) == "buy", F.col(q)).otherwise(-F.col(q)))
    a = exposures.groupBy("position", "id").agg(sign("side", "remaining").alias("q"), F.count(F.lit(1)).alias("n")).groupBy("position").agg(F.sum("q").alias("exposed"), F.count_if(F.col("n") > 1).alias("repeated"))
    b = fills.groupBy(F.col("instrument").alias("position")).agg(sign("action", "quantity").alias("net"))
    return a.join(b, "position", "full").select("position", "exposed", "net", "repeated", F.when(F.col("exposed").eqNullSafe(F.col("net")), "OK").otherwise("MISMATCH").alias("verdict"))


def life_cycles(legs: DataFrame) -> DataFrame:
    """Strategies (legs: strategy_id, user_id, tag, entry, exit, closed, pnl_c) that end when their last leg closes."""
    done = F.every("closed")
    x = legs.groupBy("strategy_id", "user_id", "tag").agg(F.count(F.lit(1)).alias("legs"), F.count_if("closed").alias("closed_legs"), F.min("entry").alias("entry"), F.when(done, F.max("exit")).alias("exit"), F.sum(F.when(F.col("closed"), F.col("pnl_c")).otherwise(0)).alias("realised_c"))
    held = F.timestamp_diff("SECOND", "entry", "exit")
    status = F.when(F.col("exit").isNotNull(), "CLOSED").when(F.col("closed_legs") > 0, "PARTIAL").otherwise("OPEN")
    return x.select("strategy_id", "user_id", "tag", "legs", "closed_legs", "entry", "exit", "realised_c", status.alias("status"), F.when(held >= 0, held).alias("held_seconds"))


def durations(cycles: DataFrame, *by: str) -> DataFrame:
    """Average, median, shortest and longest holding time of closed strategies."""
    s = F.col("held_seconds")
    return cycles.filter(s.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 4).alias("mean"), F.round(F.median(s), 4).alias("median"), F.min(s).alias("shortest"), F.max(s).alias("longest"))


def account_summary(cycles: DataFrame, start_c: int = 10_000_000) -> DataFrame:
    """By account: strategies by status, realised result, win rate as a fraction and balance."""
    closed = F.col("status") == "CLOSED"
    won, lost = closed & (F.col("realised_c") > 0), closed & (F.col("realised_c") < 0)
    n = F.count_if(closed)
    return cycles.groupBy("user_id").agg(
        n.alias("closed"), F.count_if(F.col("status") == "PARTIAL").alias("partial"), F.count_if(F.col("status") == "OPEN").alias("open"), F.sum("realised_c").alias("realised_c"), (F.sum("realised_c") + start_c).alias("balance_c"),
        F.round(F.try_divide(F.count_if(won).cast("double"), n), 4).alias("win_rate"), F.round(F.try_divide(F.sum(F.when(won, F.col("realised_c"))).cast("double"), -F.sum(F.when(lost, F.col("realised_c")))), 4).alias("profit_factor"),
    )


def tag_details(cycles: DataFrame) -> DataFrame:
    """By tag: gross profit and loss, totals and the worst and best closed strategy."""
    p = F.col("realised_c")
    return cycles.filter("status = 'CLOSED'").groupBy("tag").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(F.when(p > 0, p).otherwise(0)).alias("gross_profit_c"), F.sum(F.when(p < 0, p).otherwise(0)).alias("gross_loss_c"), F.sum(p).alias("total_c"), F.min(p).alias("worst_c"), F.max(p).alias("best_c")
    )


def valued(positions: DataFrame) -> DataFrame:
    """Positions (group, side, type, quantity, average_c, mark_c) with value and unrealised result; null without a mark."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    return positions.withColumn("signed", signed).withColumn("value_c", F.abs(signed) * F.col("mark_c")).withColumn("unrealised_c", (F.col("mark_c") - F.col("average_c")) * signed)


def live_valuation(positions: DataFrame, *by: str) -> DataFrame:
    """Value and unrealised result of each group: null and ``partial`` or ``unavailable`` if marks are missing."""
    x = valued(positions).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("mark_c").alias("marked"), F.sum("value_c").alias("v"), F.sum("unrealised_c").alias("u"), F.sum(F.when(F.col("side") == "buy", F.col("average_c") * F.col("quantity")).otherwise(0)).alias("outlay_c"))
    whole = F.col("marked") == F.col("n")
    status = F.when(whole, "available").when(F.col("marked") > 0, "partial").otherwise("unavailable")
    return x.select(*by, "n", "marked", F.when(whole, F.col("v")).alias("value_c"), F.when(whole, F.col("u")).alias("unrealised_c"), "outlay_c", status.alias("status"))


def net_instruments(positions: DataFrame, *by: str) -> DataFrame:
    """Signed quantity of each instrument that is not flat, as direction and size."""
    x = valued(positions).groupBy(*by).agg(F.sum("signed").alias("net")).filter("net <> 0")
    return x.select(*by, F.when(F.col("net") > 0, "LONG").otherwise("SHORT").alias("direction"), F.abs("net").alias("quantity"))


def concentration(positions: DataFrame, by: str, basis: str = "value_c") -> DataFrame:
    """Share of each group in the whole of a basis; rows without a mark or group are left out."""
    x = valued(positions).filter(F.col(basis).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.sum(F.abs(basis)).alias("amount"))
    # one row a group
    return x.select(by, "amount", _pct(F.col("amount"), F.sum("amount").over(Window.partitionBy()), 2).alias("pct"), F.row_number().over(Window.orderBy(F.desc("amount"), by)).alias("rank"))


def risk_buckets(positions: DataFrame) -> DataFrame:
    """Contracts bought and sold in calls and puts, and their shares."""
    x = positions.groupBy("side", "type").agg(F.sum("quantity").alias("contracts"))
    return x.select("side", "type", "contracts", _pct(F.col("contracts"), F.sum("contracts").over(Window.partitionBy()), 2).alias("pct"))


#: Rules of an account: name, what is measured, and the limit.
LIMITS = (("open_value", "value_c", 2_000_000_000), ("outlay", "outlay_c", 500_000_000), ("positions", "n", 40))


def evaluate_limits(valuations: DataFrame, account: str) -> DataFrame:
    """Each rule of each account: OK, WARNING from 0.9 of the limit, BREACHED above it, UNAVAILABLE without a value."""
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(c).cast("long").alias("value"), F.lit(m).cast("long").alias("limit")) for n, c, m in LIMITS))
    x = valuations.select(account, F.explode(rules).alias("r")).select(account, "r.*")
    use = F.try_divide(F.col("value").cast("double"), F.col("limit"))
    return x.select(account, "rule", "value", F.round(use, 6).alias("used"), F.when(use.isNull(), "UNAVAILABLE").when(use > 1, "BREACHED").when(use >= 0.9, "WARNING").otherwise("OK").alias("status"))
