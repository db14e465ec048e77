"""Views of the star-schema tables as an option chain, price bars, closed trades and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option rows. ``gamma_c`` is gamma in hundredths, ``iv_bp`` volatility in 1/10,000, so that sums are of integers and exact."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_partkey") % 3).alias("symbol"),
        F.to_date("l_shipdate").alias("d"),
        F.date_add(F.to_date("l_shipdate"), (7 * (1 + F.col("l_orderkey") % 3)).cast("int")).alias("expiry"),
        (1000 + 50 * (F.col("l_suppkey") % 20)).cast("long").alias("strike"),
        F.when(F.col("l_returnflag") == "A", "CE").when(F.col("l_returnflag") == "R", "PE").otherwise("XX").alias("option_type"),
        F.round(F.col("l_discount") * 100).cast("long").alias("gamma_c"),
        (F.col("l_quantity").cast("long") - 1).alias("oi"),
        (1475 + 5 * ((7 * F.year("l_shipdate") + 3 * F.month("l_shipdate") + F.dayofmonth("l_shipdate")) % 41 - 20)).cast("long").alias("spot"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("ltp"),
        (1000 + 37 * (F.col("l_orderkey") % 50) + F.round(F.col("l_tax") * 100).cast("long")).alias("iv_bp"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price")).filter("price is not null")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed or open strategy execution an order; money in cents."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("execution_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("strategy"),
        F.to_date("o_orderdate").alias("exit_date"),
        F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 10).cast("int")).alias("entry_date"),
        (F.round(F.col("o_totalprice") * 100).cast("long") - 25_000_000).alias("pnl_c"),
        (F.col("o_orderstatus") == "F").alias("closed"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys and sells of an instrument (a part), numbered in order; price in cents."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instrument"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"),
        F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("action"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("price_c"),
    )


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy_id, legs: an order as a strategy, its lines as legs; premiums in cents."""
    leg = F.struct(
        F.col("l_linenumber").cast("long").alias("leg"),
        F.when(F.col("l_returnflag") == "A", "CE").otherwise("PE").alias("type"),
        F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("action"),
        (1000 + 50 * (F.col("l_suppkey") % 20)).cast("long").alias("strike"),
        (1 + F.col("l_linenumber") % 3).cast("long").alias("qty"),
        (F.round(F.col("l_discount") * 100).cast("long") * 700 + 500).alias("premium_c"),
        (F.col("l_partkey") % 4 == 0).alias("far"),
        F.col("l_partkey").alias("part"),
    )
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("strategy_id")).agg(F.array_sort(F.collect_list(leg)).alias("legs"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open exposures of positions (suppliers), one an order line and side."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("position"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("side"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("remaining"))
    )


def strategy_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of executed strategies (orders), with entry and exit time and result."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("strategy_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("tag"), F.col("o_orderdate").alias("entry"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("strategy_id"), F.col("l_shipdate").alias("exit"), (F.col("l_linestatus") == "F").alias("closed"), (F.round(F.col("l_extendedprice") * 100).cast("long") - 3_500_000).alias("pnl_c"))
    return orders.join(lines, "strategy_id")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with a mark; some have none."""
    average = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("account"), F.concat(F.lit("S"), F.col("l_partkey") % 3).alias("symbol"), F.col("l_partkey").alias("instrument"), F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("side"),
        F.when(F.col("l_returnflag") == "A", "CE").otherwise("PE").alias("type"), F.col("l_quantity").cast("long").alias("quantity"), average.alias("average_c"),
        F.when(F.col("l_partkey") % 997 != 0, average + (F.col("l_suppkey") % 41 - 20) * 100).alias("mark_c"),
    )
