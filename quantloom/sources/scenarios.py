"""Views of the star-schema tables as legs of executed strategies with the marks of their chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import chain, strategies, table


def priced_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, legs: every order as a strategy whose legs have a strike, a quantity and a premium."""
    leg = F.transform("legs", lambda x: F.struct(x["type"].alias("type"), x["action"].alias("action"), x["strike"].cast("double").alias("strike"), x["qty"].alias("qty"), (x["premium_c"] / 100.0).alias("premium")))
    return strategies(spark, sf_dir).select(F.col("strategy_id").alias("name"), leg.alias("legs"))


def scenario_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy_id, spot, valued_on and each leg: type, action, strike, expiry, qty, price."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("strategy_id"), F.concat(F.lit("S"), F.col("o_custkey") % 3).alias("symbol"), F.to_date("o_orderdate").alias("valued_on"))
    legs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("strategy_id"), F.when(F.col("l_returnflag") == "A", "CE").otherwise("PE").alias("type"), F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("action"),
        (1000 + 50 * (F.col("l_suppkey") % 20)).cast("long").alias("strike"), (1 + F.col("l_linenumber") % 3).cast("long").alias("qty"), (5 + F.col("l_partkey") % 200).cast("double").alias("price"), (F.col("l_partkey") % 5).alias("weeks"),
    )
    x = orders.join(legs, "strategy_id")
    return x.select("strategy_id", "symbol", "valued_on", F.when(F.col("strategy_id") % 97 != 0, 1475.0).alias("spot"), "type", "action", "strike", F.date_add("valued_on", (7 * F.col("weeks")).cast("int")).alias("expiry"), "qty", "price")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, strike, type, iv, ltp: the last quote of each option that the chain lists; some strikes are not listed, some have no volatility.

    The last days are found first, so that only their quotes are compared whole. The chain has three symbols,
    twenty strikes and two types, so both the last days and the quotes go to every task.
    """
    keys = ["symbol", "strike", "type"]
    quotes = chain(spark, sf_dir).filter("option_type <> 'XX' and strike % 350 <> 0").select("symbol", "strike", F.col("option_type").alias("type"), "d", "ltp", "iv_bp")
    days = quotes.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("d").alias("_d"))
    same = F.lit(True)
    for c in (*keys, "d"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    x = quotes.join(F.broadcast(days), same, "left_semi").groupBy(*keys).agg(F.max(F.struct("ltp", "iv_bp")).alias("q"))
    x = x.select(*keys, F.when(F.col("q.ltp") % 11 != 0, F.col("q.iv_bp") / 10_000.0).alias("iv"), F.when(F.col("q.ltp") % 13 != 0, F.col("q.ltp").cast("double")).alias("ltp"))
    return F.broadcast(x)
