"""Price alerts: each fires once, at the first quote that reaches its level.

Only quotes that set a new high or low of their instrument can be the first to reach any level, and of
those there are few (about the logarithm of the quotes, where prices wander). So alerts meet an
instrument's records, not its quotes, however many alerts it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def records(quotes: DataFrame, key: str, at: str, price: str, tie: str) -> DataFrame:
    """key, side, at, tie, price: the quotes above (``above``) or below all quotes of their instrument before them; equal times are in order of ``tie``."""
    before = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    x = quotes.filter(F.col(price).isNotNull() & F.col(at).isNotNull()).select(key, at, tie, price, F.max(price).over(before).alias("_high"), F.min(price).over(before).alias("_low"))
    first = F.col("_high").isNull()
    sides = F.array_compact(F.array(F.when(first | (F.col(price) > F.col("_high")), F.lit("above")), F.when(first | (F.col(price) < F.col("_low")), F.lit("below"))))
    return x.select(key, F.explode(sides).alias("side"), at, tie, price)


def fired(alerts: DataFrame, quotes: DataFrame, key: str, at: str, price: str, tie: str) -> DataFrame:
    """``alerts`` (key, condition, level, triggered_at) with what fired them: ``fired_at`` and ``fired_price``; null while nothing did.

    Above fires at a price of at least the level, below at one of at most it. Alerts that are triggered
    already, or whose condition is neither, do not fire.
    """
    number = alerts.withColumn("_n", F.monotonically_increasing_id())
    waiting = number.filter(F.col("triggered_at").isNull()).select("_n", F.col(key).alias("_k"), "condition", "level")
    r = records(quotes, key, at, price, tie)
    met = waiting.join(r, (F.col("_k") == F.col(key)) & (F.col("condition") == F.col("side")))
    reached = F.when(F.col("condition") == "above", F.col(price) >= F.col("level")).otherwise(F.col(price) <= F.col("level"))
    first = met.filter(reached).groupBy("_n").agg(F.min(F.struct(at, tie, price)).alias("_f"))
    return number.join(first, "_n", "left").select(*alerts.columns, F.col(f"_f.{at}").alias("fired_at"), F.col(f"_f.{price}").alias("fired_price"))
