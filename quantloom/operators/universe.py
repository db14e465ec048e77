"""Which contracts a history is fetched for: monthly expiries, their at-the-money strike then, the strikes around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def on_grid(price: Column, grid: int = 25) -> Column:
    """The nearest strike of the grid; halves go to the even multiple."""
    return (F.bround(price.cast("decimal(20,6)") / F.lit(grid).cast("decimal(10,0)"), 0) * grid).cast("long")


def first_opens(bars: DataFrame, last_minute: int = 927) -> DataFrame:
    """symbol, day, open: of the first bar of each session (09:15 to 15:27); a day whose first bar has no open above 0 is left out."""
    inside = bars.filter(rules.minute_of_day(F.col("open_time")).between(555, last_minute))
    x = inside.groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.min(F.struct("open_time", "open")).alias("b"))
    return x.select("symbol", "day", F.col("b.open").alias("open")).filter("open > 0")


def historical_atm(targets: DataFrame, opens: DataFrame, days_back: int = 5) -> DataFrame:
    """symbol, target, atm, days_back: by the target's own day, or the nearest one before it, ``days_back`` at most; targets without one are left out.

    A target asks for its few days by an equality join, so a bounded look-back is no range join.
    """
    asked = targets.select("symbol", "target", F.explode(F.sequence(F.lit(0), F.lit(days_back))).alias("back")).withColumn("day", F.date_sub("target", F.col("back")))
    found = asked.join(opens, ["symbol", "day"]).groupBy("symbol", "target").agg(F.min(F.struct("back", "open")).alias("f"))
    return found.select("symbol", "target", on_grid(F.col("f.open")).alias("atm"), F.col("f.back").alias("days_back"))


def upper_median_strikes(contracts: DataFrame) -> DataFrame:
    """symbol, expiry, median: the upper median of the listed strikes, a row a contract; counts of strikes, so no list is sorted."""
    n = contracts.filter("strike > 0").groupBy("symbol", "expiry", "strike").agg(F.count(F.lit(1)).alias("n"))
    listed = n.groupBy("symbol", "expiry").agg(F.array_sort(F.collect_list(F.struct("strike", "n"))).alias("s"), F.sum("n").alias("all"))  # a row a strike, as an exchange lists
    place = F.floor(F.col("all") / 2)
    upto = F.transform("s", lambda x, i: F.struct(x["strike"].alias("strike"), F.aggregate(F.slice("s", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")))
    return listed.select("symbol", "expiry", F.filter(upto, lambda x: x["upto"] > place)[0]["strike"].alias("median"))


def tier_one(contracts: DataFrame, opens: DataFrame, steps: int = 20, grid: int = 25) -> DataFrame:
    """A row a contract of each symbol's monthly expiries within ``steps`` strikes of the money as it was on the expiry day.

    ``source`` of the money: EXACT (that day), LOOKBACK (up to five days before), MEDIAN (of the listed strikes).
    """
    monthly = contracts.groupBy("symbol", F.date_format("expiry", "yyyy-MM").alias("month")).agg(F.max("expiry").alias("expiry")).select("symbol", "expiry")
    atm = historical_atm(monthly.withColumnRenamed("expiry", "target"), opens).withColumnRenamed("target", "expiry")
    own = contracts.join(monthly, ["symbol", "expiry"], "left_semi")
    money = monthly.join(atm, ["symbol", "expiry"], "left").join(upper_median_strikes(own), ["symbol", "expiry"], "left")
    source = F.when(F.col("days_back") == 0, "EXACT").when(F.col("days_back") > 0, "LOOKBACK").otherwise("MEDIAN")
    money = money.select("symbol", "expiry", F.coalesce("atm", on_grid(F.col("median"), grid)).alias("atm"), "days_back", source.alias("source")).filter("atm is not null")
    near = (F.abs(F.col("strike") - F.col("atm")) <= steps * grid) & ((F.col("strike") - F.col("atm")) % grid == 0)
    return own.join(money, ["symbol", "expiry"]).filter(near).select("symbol", "expiry", "atm", "source", "days_back", "instrument", "option_type", "strike", "lot_size")


def selection_report(chosen: DataFrame) -> DataFrame:
    """By expiry: the money, its source, the strikes and contracts chosen, and lot sizes."""
    of = lambda t: F.count_if(F.col("option_type") == t)
    return chosen.groupBy("symbol", "expiry", "atm", "source", "days_back").agg(
        F.min("strike").alias("lowest"), F.max("strike").alias("highest"), F.countDistinct("strike").alias("strikes"), of("CE").alias("calls"), of("PE").alias("puts"), F.count(F.lit(1)).alias("contracts"), F.countDistinct("lot_size").alias("lot_sizes"),
    )
