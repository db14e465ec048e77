"""Views of the star-schema tables as order events, execution requests and account streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adapters import table

_LINE = ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _price_c() -> F.Column:
    return F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, step, request, target: the status changes asked of an order, numbered; a request that comes again is a replay."""
    later = F.element_at(F.array(*map(F.lit, ("FILLED", "CANCELLED", "REJECTED", "PENDING", "PARTIALLY_FILLED"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    target = F.when((F.col("l_linenumber") <= 2) & (F.col("l_partkey") % 3 < 2), "PARTIALLY_FILLED").otherwise(later)
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), step.alias("step"), (F.col("l_suppkey") % 6).alias("request"), target.alias("target"))


def execution_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of execution requests: a user sends few client ids, so some come again; some legs have no price."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 3).alias("client_order_id"), F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("at")
    )
    legs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("instrument"), F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("action"),
        F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_partkey") % 23 == 0, None).when(F.col("l_partkey") % 29 == 0, 0).otherwise(_price_c()).alias("price_c"),
    )
    return orders.join(legs, "request_id")


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, n, kind, key, instrument, quantity, price_c: fills, marks and bulk exits of an account in order; a mark may lack a price."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    turn = F.col("l_partkey") % 9
    kind = F.when(turn == 0, "exit").when(turn == 1, "mark").otherwise("fill")
    signed = F.col("l_quantity").cast("long") * F.when(F.col("l_linestatus") == "F", 1).otherwise(-1)
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", *_LINE)).cast("long")
    return joined.select(
        F.col("o_custkey").alias("account"), n.alias("n"), kind.alias("kind"), (F.col("l_suppkey") % 5).alias("key"), (F.col("l_partkey") % 7).alias("instrument"),
        signed.alias("quantity"), F.when((turn == 1) & (F.col("l_suppkey") % 3 == 0), None).otherwise(_price_c()).alias("price_c"),
    )
