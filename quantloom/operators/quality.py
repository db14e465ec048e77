"""Data quality of an option chain: coverage, completeness, balance, validity, score and readiness.

Every metric is one grouping of the chain; medians of group sizes come from the counts of sizes,
which are few, never from a sorted list of all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gex import exclusion_reason


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def instrument() -> Column:
    return F.struct("strike", "option_type", "expiry")


def status_counts(chain: DataFrame) -> DataFrame:
    """status, n, instruments, days: SUCCESS or the reason a row is left out."""
    status = F.coalesce(exclusion_reason(), F.lit("SUCCESS"))
    return chain.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(instrument()).alias("instruments"), F.countDistinct("d").alias("days"))


def coverage(chain: DataFrame) -> DataFrame:
    """One row: open interest, exposure, day and numerical coverage."""
    n, ok = F.count(F.lit(1)), exclusion_reason().isNull()
    missing = F.count_if(F.col("oi").isNull() | F.col("gamma_c").isNull())
    return chain.agg(
        n.alias("n"), F.count_if(F.col("oi") > 0).alias("positive_oi"), F.count_if(F.col("oi") == 0).alias("zero_oi"), F.count_if(ok).alias("success"), (n - F.count_if(ok)).alias("excluded"),
        F.countDistinct("d").alias("days"), F.countDistinct(F.when(ok, F.col("d"))).alias("gex_days"), missing.alias("missing"),
    ).select(
        "*", F.round(_ratio(F.col("positive_oi"), F.col("n")), 6).alias("oi_coverage"), F.round(_ratio(F.col("zero_oi"), F.col("n")) * 100, 4).alias("zero_oi_pct"),
        F.round(_ratio(F.col("success"), F.col("n")), 6).alias("gex_coverage"), F.round(_ratio(F.col("gex_days"), F.col("days")), 6).alias("timestamp_coverage"),
        F.round(F.when(F.col("n") > 0, 1 - _ratio(F.col("missing"), F.col("n"))).otherwise(0.0), 6).alias("numerical_validity"),
    )


def completeness(chain: DataFrame) -> DataFrame:
    """One row: chains (days), mean and upper median of their sizes, share of at least half the median."""
    sizes = chain.groupBy("d").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("chains"))
    total = F.sum("chains").over(Window.partitionBy())
    upto = F.sum("chains").over(Window.orderBy("size"))  # one row a size
    x = sizes.withColumn("total", total).withColumn("upto", upto).withColumn("median", F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("size"))).over(Window.partitionBy()))
    return x.groupBy("total", "median").agg(
        (F.sum(F.col("size") * F.col("chains")).cast("double") / F.sum("chains")).alias("m"),
        F.sum(F.when(F.col("size") * 2 >= F.col("median"), F.col("chains")).otherwise(0)).alias("complete"),
    ).select(F.col("total").alias("chains"), "median", F.round("m", 4).alias("mean"), "complete", F.round(_ratio(F.col("complete"), F.col("total")), 6).alias("chain_completeness"))


def side_balance(chain: DataFrame) -> DataFrame:
    """Distinct calls and puts, and the smaller over the larger number."""
    n = lambda t: F.countDistinct(F.when(F.col("option_type") == t, F.struct("strike", "expiry")))
    x = chain.agg(n("CE").alias("calls"), n("PE").alias("puts"))
    return x.select("calls", "puts", F.round(_ratio(F.least("calls", "puts"), F.greatest("calls", "puts")), 6).alias("balance"))


def affected_expiries(chain: DataFrame) -> DataFrame:
    """expiry, zero_oi_rows: expiries with rows without open interest."""
    return chain.filter("oi = 0").groupBy("expiry").agg(F.count(F.lit(1)).alias("zero_oi_rows"))


#: The metrics of the score; critical ones weigh twice and cap it.
CRITICAL, OTHERS = ("oi_coverage", "gex_coverage", "timestamp_coverage", "numerical_validity"), ("chain_completeness", "balance")


def score(chain: DataFrame) -> DataFrame:
    """One row: the weighted score (at most 100 times the worst critical metric), its class and warnings."""
    # three rows of one line each
    x = coverage(chain).crossJoin(completeness(chain)).crossJoin(side_balance(chain))
    clamp = lambda c: F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0))
    total = sum((clamp(c) * 2 for c in CRITICAL), F.lit(0.0)) + sum((clamp(c) for c in OTHERS), F.lit(0.0))
    worst = F.least(*(clamp(c) for c in CRITICAL))
    x = x.withColumn("worst", worst).withColumn("score", F.round(F.least(total / (2 * len(CRITICAL) + len(OTHERS)) * 100, F.col("worst") * 100), 2))
    grade = F.when((F.col("score") >= 95) & (F.col("worst") >= 0.95), "EXCELLENT").when((F.col("score") >= 85) & (F.col("worst") >= 0.85), "GOOD").when((F.col("score") >= 70) & (F.col("worst") >= 0.7), "DEGRADED").otherwise("INSUFFICIENT")
    low = [F.when(F.col(c) < 0.95, F.concat(F.lit(f"{c} "), F.format_string("%.1f", F.col(c) * 100), F.lit("%"))) for c in CRITICAL]
    return x.select("score", grade.alias("grade"), F.array_join(F.array_compact(F.array(*low)), "; ").alias("warnings"))


def coverage_summary(bars: DataFrame, expected: int = 24, enough: tuple[int, int, int] = (200, 500, 3000)) -> DataFrame:
    """By symbol: complete and partial days, average completeness (not capped) and readiness for research."""
    days = bars.groupBy("symbol", F.to_date("open_time").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    x = days.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("n") >= expected).alias("complete"), F.count_if(F.col("n") < expected).alias("partial"),
        F.sum("n").alias("bars"), F.round(F.sum("n") * 100.0 / (F.count(F.lit(1)) * expected), 4).alias("average_pct"),
    )
    low, some, full = enough
    ready = F.when(F.col("bars") < low, "INSUFFICIENT").when((F.col("bars") < some) | (F.col("average_pct") < 60), "LIMITED").when((F.col("bars") < full) | (F.col("average_pct") < 80), "ADEQUATE").otherwise("STRONG")
    return x.withColumn("readiness", ready)


def batch_report(bars: DataFrame) -> DataFrame:
    """By symbol: bars, invalid ones, repeated times among the valid, steps back in order of arrival, first and last time."""
    arrival = Window.partitionBy("symbol", F.to_date("open_time")).orderBy("arrival")
    x = bars.withColumn("back", F.coalesce(F.col("open_time") < F.lag("open_time").over(arrival), F.lit(False)))
    valid = F.size("errors") == 0
    times = x.groupBy("symbol", "open_time").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("ok"), F.count_if("back").alias("back"))
    return times.groupBy("symbol").agg(
        F.sum("n").alias("bars"), F.sum(F.col("n") - F.col("ok")).alias("invalid"), F.sum(F.greatest(F.col("ok") - 1, F.lit(0))).alias("duplicates"),
        F.sum("back").alias("out_of_order"), F.min("open_time").alias("first"), F.max("open_time").alias("last"),
    )
