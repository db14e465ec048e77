"""Paper-trading metrics: results, streaks, equity, drawdown, netting, FIFO allocation.

Money is in cents (long) until the last step. Equity and drawdown of one account run in a window;
``partition`` names the account, so that accounts spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def result(pnl: Column) -> Column:
    return F.when(pnl > 0, "WIN").when(pnl < 0, "LOSS").when(pnl == 0, "BREAKEVEN")


def _metrics() -> list[Column]:
    p = F.col("pnl_c")
    won, lost = F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, -p))
    n, wins, losses = F.count("pnl_c"), F.count_if(p > 0), F.count_if(p < 0)
    money = lambda c, digits=2: F.round(c.cast("double") / 100, digits)
    return [
        n.alias("trades"), wins.alias("wins"), losses.alias("losses"), F.round(F.try_divide(wins * 100.0, n), 2).alias("win_rate"), money(F.sum("pnl_c")).alias("total"),
        F.round(F.try_divide(won.cast("double"), wins.cast("double")) / 100, 2).alias("average_winner"), F.round(-F.try_divide(lost.cast("double"), losses.cast("double")) / 100, 2).alias("average_loser"),
        F.round(F.try_divide(won.cast("double"), lost.cast("double")), 4).alias("profit_factor"), F.round(F.try_divide(F.sum("pnl_c").cast("double"), n.cast("double")) / 100, 2).alias("expectancy"),
    ]


def performance(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Win rate, averages, profit factor and expectancy of closed trades, in all or by group."""
    return trades.filter("closed").groupBy(*by).agg(*_metrics())


def daily_pnl(trades: DataFrame) -> DataFrame:
    return trades.filter("closed").groupBy("exit_date").agg(F.round(F.sum("pnl_c").cast("double") / 100, 2).alias("pnl"), F.count(F.lit(1)).alias("trades"))


def streaks(trades: DataFrame, partition: str = "user_id") -> DataFrame:
    """Longest and current runs of wins and losses in order of entry; a breakeven ends both."""
    w = Window.partitionBy(partition).orderBy("entry_date", "execution_id")
    x = trades.filter("closed").withColumn("r", result(F.col("pnl_c")))
    x = x.withColumn("new", F.when(F.lag("r").over(w).eqNullSafe(F.col("r")), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(partition, "run", "r").agg(F.count(F.lit(1)).alias("n"))
    last = F.max_by(F.struct("r", "n"), "run")
    longest = lambda r: F.coalesce(F.max(F.when(F.col("r") == r, F.col("n"))), F.lit(0))
    return runs.groupBy(partition).agg(longest("WIN").alias("max_wins"), longest("LOSS").alias("max_losses"), last.alias("last")).select(partition, "max_wins", "max_losses", F.col("last.r").alias("current_result"), F.col("last.n").alias("current_length"))


def equity(trades: DataFrame, start_c: int = 10_000_000, partition: str = "user_id") -> DataFrame:
    """Running equity, its peak so far and the drawdown of each closed trade in order of entry.

    A baseline row (``step`` 0, no trade) at the first exit date comes before them.
    """
    w = Window.partitionBy(partition).orderBy("entry_date", "execution_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = trades.filter("closed").withColumn("step", F.row_number().over(w)).withColumn("equity_c", start_c + F.sum("pnl_c").over(upto))
    x = x.withColumn("peak_c", F.greatest(F.max("equity_c").over(upto), F.lit(start_c))).select(partition, "step", "execution_id", "exit_date", "equity_c", "peak_c")
    first = x.groupBy(partition).agg(F.min("exit_date").alias("exit_date"))
    base = first.select(partition, F.lit(0).alias("step"), F.lit(None).cast("long").alias("execution_id"), "exit_date", F.lit(start_c).cast("long").alias("equity_c"), F.lit(start_c).cast("long").alias("peak_c"))
    fall = F.col("equity_c") - F.col("peak_c")
    return base.unionByName(x).select(partition, "step", "execution_id", "exit_date", (F.col("equity_c") / 100.0).alias("equity"), (fall / 100.0).alias("drawdown"), F.round(F.try_divide(fall * 100.0, F.col("peak_c")), 6).alias("drawdown_pct"))


def max_drawdown(curve: DataFrame, partition: str = "user_id") -> DataFrame:
    """The deepest drawdown, the per cent at that point (the first of equal ones) and the current one."""
    x = curve.groupBy(partition).agg(F.min(F.struct("drawdown", "step", "drawdown_pct")).alias("m"), F.max_by("drawdown", "step").alias("current"), F.max_by("equity", "step").alias("equity"))
    return x.select(partition, F.col("m.drawdown").alias("max_drawdown"), F.col("m.drawdown_pct").alias("max_drawdown_pct"), "current", "equity")


def net_positions(fills: DataFrame) -> DataFrame:
    """Signed quantity, average entry price and realised result of each instrument, by an ordered fold.

    A fill on the same side averages in; on the other side it realises, and beyond flat it opens at
    its own price. Sorted fills stream through their task, which holds one instrument's state only.
    """
    signed = F.when(F.col("action") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    ordered = fills.select("instrument", "seq", signed.alias("q"), "price_c").repartition("instrument").sortWithinPartitions("instrument", "seq", "price_c").select("instrument", "q", "price_c")
    schema = pa.schema([("instrument", pa.int64()), ("net_quantity", pa.int64()), ("average_price", pa.float64()), ("realized_pnl", pa.float64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, average, real = None, 0, 0.0, 0.0
        for batch in batches:
            done = []
            for instrument, q, price in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)):
                if instrument != current:
                    if current is not None:
                        done.append((current, held, round(average / 100, 4), round(real / 100, 2)))
                    current, held, average, real = instrument, 0, 0.0, 0.0
                if held == 0 or (held > 0) == (q > 0):
                    average = (average * abs(held) + price * abs(q)) / abs(held + q) if held + q else 0.0
                else:
                    real += min(abs(held), abs(q)) * (price - average) * (1 if held > 0 else -1)
                    if abs(q) >= abs(held):
                        average = float(price) if abs(q) > abs(held) else 0.0
                held += q
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (current, held, round(average / 100, 4), round(real / 100, 2))))], schema=schema)

    return ordered.mapInArrow(fold, "instrument long, net_quantity long, average_price double, realized_pnl double")


def fifo_allocation(fills: DataFrame) -> DataFrame:
    """Sells matched to buys first in, first out: the overlaps of their running quantities.

    Both sides become steps on one quantity axis; a window over their union cuts the axis at every
    edge, so there is no range join.
    """
    w = Window.partitionBy("instrument", "action").orderBy("seq", "price_c").rowsBetween(Window.unboundedPreceding, 0)
    ends = fills.withColumn("end", F.sum("quantity").over(w)).filter("quantity > 0")
    axis = Window.partitionBy("instrument").orderBy("end")
    edges = ends.groupBy("instrument", "end").agg(F.max(F.when(F.col("action") == "buy", F.col("price_c"))).alias("buy"), F.max(F.when(F.col("action") == "sell", F.col("price_c"))).alias("sell"))
    # backwards, so that the frame ends at the current row and each row is looked at once
    after = Window.partitionBy("instrument").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = edges.select(
        "instrument", F.coalesce(F.lag("end").over(axis), F.lit(0)).alias("start"), "end",
        F.last("buy", ignorenulls=True).over(after).alias("buy_c"), F.last("sell", ignorenulls=True).over(after).alias("sell_c"),
    )
    return cut.filter("buy_c is not null and sell_c is not null").groupBy("instrument").agg(F.sum(F.col("end") - F.col("start")).alias("matched"), F.sum((F.col("end") - F.col("start")) * (F.col("sell_c") - F.col("buy_c"))).alias("gain_c"))


def reconcile(fills: DataFrame) -> DataFrame:
    """Bought and sold quantity, open quantity and cash of each instrument."""
    buy = F.col("action") == "buy"
    q, cash = F.when(buy, F.col("quantity")).otherwise(-F.col("quantity")), F.col("quantity") * F.col("price_c")
    return fills.groupBy("instrument").agg(F.sum(F.when(buy, F.col("quantity")).otherwise(0)).alias("bought"), F.sum(F.when(buy, 0).otherwise(F.col("quantity"))).alias("sold"), F.sum(q).alias("net"), F.sum(F.when(buy, -cash).otherwise(cash)).alias("cash_c"))


def exposure(fills: DataFrame) -> DataFrame:
    """Long and short entry value by action, and its share."""
    t = fills.groupBy("action").agg(F.sum(F.col("quantity") * F.col("price_c")).alias("value_c"), F.count(F.lit(1)).alias("n"))
    return t.withColumn("pct", F.round(F.try_divide(F.col("value_c") * 100.0, F.sum("value_c").over(Window.partitionBy())), 4))
