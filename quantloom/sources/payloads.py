"""Views of the star-schema tables as nested chain payloads, and as option bars with their contracts and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import chain, table


def _side(kind: str, h: Column) -> Column:
    """One side of a strike as a broker sends it: null if there is none, with gaps and bad values here and there."""
    n, oi, gamma = (F.col(f"{kind}_{c}") for c in ("n", "oi", "gamma"))
    greek = F.when(h % 17 == 0, None).when(h % 19 == 0, "-3").when(h % 23 == 0, "n/a").otherwise(gamma.cast("string"))
    open_interest = F.when(h % 13 == 0, 0).when(h % 31 == 0, None).otherwise(oi)
    at = F.date_format(F.col("d").cast("timestamp_ntz") + F.make_interval(mins=F.col("strike").cast("int") - h.cast("int") % 50), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    market = F.struct(
        (oi * 3).alias("ltp"), open_interest.alias("oi"), F.when(h % 5 != 0, oi - h % 7).alias("prev_oi"), n.alias("volume"),
        F.when(h % 29 == 0, "soon").when(h % 3 == 0, None).otherwise(at).alias("last_trade_time"), at.alias("last_update_time"),
    )
    return F.when(n > 0, F.struct(market.alias("market_data"), F.struct(greek.alias("gamma"), (n * 2).alias("iv")).alias("option_greeks")))


def chain_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, expiry, captured_at, raw: the chain of a symbol and day as nested JSON."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_partkey") % 3).alias("symbol"), F.to_date("l_shipdate").alias("d"), (1000 + 50 * (F.col("l_suppkey") % 20)).cast("long").alias("strike"),
        F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("oi"), F.round(F.col("l_discount") * 100).cast("long").alias("gamma"),
    )
    of = lambda f, k, c: f(F.when(F.col("kind") == k, F.col(c)))
    k = lines.groupBy("symbol", "d", "strike").agg(*(a for n, f in (("call", "A"), ("put", "R")) for a in (of(F.count, f, "oi").alias(f"{n}_n"), of(F.sum, f, "oi").alias(f"{n}_oi"), of(F.sum, f, "gamma").alias(f"{n}_gamma"))))
    h = F.col("strike") / 50 + F.dayofyear("d")
    h = h.cast("long")
    spot = F.when(F.dayofyear("d") % 61 == 0, 0).when(F.dayofyear("d") % 67 == 0, None).when(h % 2 == 0, None).otherwise(1475 + 5 * (F.dayofyear("d") % 41 - 20))
    item = F.struct(F.col("strike").alias("strike_price"), spot.alias("underlying_spot_price"), _side("call", h).alias("call_options"), _side("put", h + 3).alias("put_options"))
    # a payload has a row a strike, as many as an exchange lists
    return k.groupBy("symbol", F.col("d").alias("expiry")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("data"))).alias("raw")).select("symbol", "expiry", (F.col("expiry").cast("timestamp_ntz") + F.make_interval(days=F.lit(1), hours=F.lit(-2))).alias("captured_at"), "raw")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, symbol, option_type, strike, expiry, lot_size: the options that are known."""
    known = _options(spark, sf_dir).filter("option_type <> 'XX'").select("instrument", "symbol", "option_type", "strike", "expiry").distinct()
    return known.withColumn("lot_size", F.lit(50))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir).withColumn("expiry", F.date_sub("expiry", 7))
    return c.withColumn("instrument", F.concat_ws("|", "symbol", "expiry", "strike", "option_type"))


def option_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, open_time, price: one bar a time, some at or below 0, some under the intrinsic value."""
    inner = F.greatest(F.when(F.col("option_type") == "CE", F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot")), F.lit(0))
    at = F.col("d").cast("timestamp_ntz") + F.make_interval(mins=(540 + F.col("ltp") % 420).cast("int"))
    return _options(spark, sf_dir).select("instrument", at.alias("open_time"), (inner + F.col("oi") - 3).alias("price")).groupBy("instrument", "open_time").agg(F.max("price").cast("double").alias("price"))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, open_time, close: a bar each quarter of an hour of the session; some days have none, some closes are 0."""
    days = chain(spark, sf_dir).filter(F.dayofyear("d") % 37 != 0).select("symbol", "d", "spot").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(24)))
    return days.withColumn("k", k).select("symbol", (F.col("d").cast("timestamp_ntz") + F.make_interval(mins=555 + 15 * F.col("k"))).alias("open_time"), F.when(F.col("k") % 6 == 5, 0).otherwise(F.col("spot") + F.col("k") % 5 - 2).cast("double").alias("close"))
