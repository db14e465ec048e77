"""Gamma exposure: eligibility, totals by strike, day and expiry, flips, walls, regimes, change.

Sums run over integers (``gex_c``, exposure times 10,000), so they do not depend on row order.
Series are kept apart by ``symbol``; ``d`` is the time of a chain, a day here, but any grain will do. A
window holds one row for each time of one symbol, however many options there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1e-4


def exclusion_reason() -> Column:
    """Why a row is left out, in order of priority; null if it is in."""
    return (
        F.when(~F.col("option_type").isin("CE", "PE") | F.col("option_type").isNull(), "INVALID_TYPE")
        .when(F.col("spot").isNull() | (F.col("spot") <= 0), "INVALID_SPOT")
        .when(F.col("strike").isNull() | (F.col("strike") <= 0), "INVALID_STRIKE")
        .when(F.col("gamma_c").isNull() | (F.col("gamma_c") < 0), "INVALID_GAMMA")
        .when(F.col("oi").isNull(), "MISSING_OI")
        .when(F.isnan(F.col("oi").cast("double")) | F.abs(F.col("oi").cast("double")).eqNullSafe(float("inf")), "INVALID_OI")
        .when(F.col("oi") <= 0, "ZERO_OI")
    )


def with_gex(chain: DataFrame) -> DataFrame:
    """Eligible rows with signed exposure: calls positive, puts negative."""
    raw = F.col("gamma_c") * F.col("oi") * F.col("spot") * F.col("spot")
    return chain.withColumn("reason", exclusion_reason()).filter("reason is null").withColumn("gex_c", F.when(F.col("option_type") == "CE", raw).otherwise(-raw))


def _money(c: Column) -> Column:
    return c.cast("double") * SCALE


def exclusions(chain: DataFrame) -> DataFrame:
    """Rows, days and share of the excluded for each reason."""
    return (
        chain.withColumn("reason", exclusion_reason())
        .filter("reason is not null")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("d").alias("days"), F.countDistinct("expiry").alias("expiries"))
        .withColumn("pct_of_excluded", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))
    )


def _sides() -> list[Column]:
    call = F.sum(F.when(F.col("option_type") == "CE", F.col("gex_c")))
    put = F.sum(F.when(F.col("option_type") == "PE", F.col("gex_c")))
    return [call.alias("call_c"), put.alias("put_c")]


def strike_totals(chain: DataFrame) -> DataFrame:
    """By day and strike; ``net`` adds what there is, ``net_both`` is 0 and ``net_strict`` null if a side is missing."""
    t = with_gex(chain).groupBy("symbol", "d", "strike", "spot").agg(*_sides(), F.sum("oi").alias("oi"))
    both = F.col("call_c").isNotNull() & F.col("put_c").isNotNull()
    net = F.coalesce("call_c", F.lit(0)) + F.coalesce("put_c", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("symbol", "d").orderBy(F.desc(F.abs("net_c")), "strike"))
    return (
        t.withColumn("net_c", net)
        .withColumn("rank", rank)
        .select("symbol", "d", "strike", "spot", "oi", "rank", _money(F.col("call_c")).alias("call_gex"), _money(F.col("put_c")).alias("put_gex"), _money(net).alias("net"), _money(F.when(both, net).otherwise(0)).alias("net_both"), _money(F.when(both, net)).alias("net_strict"), "net_c")
    )


def daily_totals(chain: DataFrame) -> DataFrame:
    """By day: sides, net, |net| and the sum of magnitudes (two different notions of absolute)."""
    t = with_gex(chain).groupBy("symbol", "d", "spot").agg(*_sides(), F.sum(F.abs("gex_c")).alias("gross_c"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("strike").alias("strikes"))
    net = F.coalesce("call_c", F.lit(0)) + F.coalesce("put_c", F.lit(0))
    return t.withColumn("net_c", net).select(
        "symbol", "d", "spot", "n_rows", "strikes", "net_c",
        _money(F.coalesce("call_c", F.lit(0))).alias("call_gex"), _money(F.coalesce("put_c", F.lit(0))).alias("put_gex"), _money(net).alias("net_gex"),
        _money(F.abs(net)).alias("abs_net_gex"), _money(F.col("gross_c")).alias("gross_gex"), _money(F.greatest(net, F.lit(0))).alias("positive_gex"), _money(F.least(net, F.lit(0))).alias("negative_gex"),
    )


def expiry_totals(chain: DataFrame) -> DataFrame:
    """By day and expiry, with the share of the day's sum of |net|."""
    t = with_gex(chain).groupBy("symbol", "d", "expiry").agg(F.sum("gex_c").alias("net_c"), F.countDistinct("strike").alias("strikes"))
    share = F.try_divide(F.abs("net_c") * 100.0, F.sum(F.abs("net_c")).over(Window.partitionBy("symbol", "d")))
    return t.select("symbol", "d", "expiry", "strikes", _money(F.col("net_c")).alias("net_gex"), F.round(share, 6).alias("concentration_pct"))


def _series(partition: Sequence[str]) -> Window:
    return Window.partitionBy(*partition).orderBy("d")


def change(daily: DataFrame, zero_is_missing: bool = True, partition: Sequence[str] = ("symbol",)) -> DataFrame:
    """Difference to the day before, in per cent of its magnitude, and the change of the change."""
    w = _series(partition)
    before = F.lag("net_c").over(w)
    out = daily.withColumn("before_c", F.when(before != 0, before) if zero_is_missing else before).withColumn("change_c", F.col("net_c") - F.col("before_c"))
    out = out.withColumn("accel_c", F.col("change_c") - F.lag("change_c").over(w))
    pct = F.try_divide(F.col("change_c") * 100.0, F.abs("before_c"))
    return out.select(*partition, "d", _money(F.col("net_c")).alias("net_gex"), _money(F.col("change_c")).alias("gex_change"), F.round(pct, 6).alias("change_pct"), _money(F.col("accel_c")).alias("acceleration"))


def regime(net: Column) -> Column:
    return F.when(net > 0, "POSITIVE").when(net < 0, "NEGATIVE").when(net == 0, "NEUTRAL").otherwise("UNKNOWN")


def regime_runs(daily: DataFrame, partition: Sequence[str] = ("symbol",)) -> DataFrame:
    """Regime of each day, the one before, the transition and the length of the run so far."""
    w = _series(partition)
    out = daily.withColumn("regime", regime(F.col("net_c"))).withColumn("previous", F.lag("regime").over(w))
    out = out.withColumn("run", F.sum(F.when(F.col("previous").eqNullSafe(F.col("regime")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*partition, "run").orderBy("d")
    return out.select(
        *partition, "d", "regime", "previous",
        F.when(F.col("previous") != F.col("regime"), F.concat_ws("->", "previous", "regime")).alias("transition"),
        F.row_number().over(inside).alias("run_length"),
    )


def percentile_regimes(daily: DataFrame) -> DataFrame:
    """Detailed regimes by nearest-rank quartiles of a symbol's series; near the median's tenth is the flip zone.

    The value at index int(p * (n - 1)) of the sorted series comes from ranks, not from an array.
    """
    ranked = daily.select("symbol", "net_c", (F.row_number().over(Window.partitionBy("symbol").orderBy("net_c")) - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.floor(F.lit(p) * (F.col("n") - 1)), F.col("net_c")))
    levels = ranked.groupBy("symbol").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    net = F.col("net_c")
    return daily.join(levels, "symbol").select(
        "symbol", "d", regime(net).alias("regime"),
        F.when(F.abs(net) <= 0.1 * F.abs("p50"), "FLIP_ZONE").when((net > 0) & (net >= F.col("p75")), "STRONG_POSITIVE").when(net > 0, "POSITIVE").when(net <= F.col("p25"), "STRONG_NEGATIVE").otherwise("NEGATIVE").alias("detail"),
    )


def flips(strikes: DataFrame) -> DataFrame:
    """Where net exposure changes sign between neighbouring strikes; of several, the nearest to spot."""
    w = Window.partitionBy("symbol", "d").orderBy("strike")
    n = strikes.withColumn("k2", F.lead("strike").over(w)).withColumn("n2", F.lead("net_c").over(w))
    a, b = F.col("net_c").cast("double"), F.col("n2").cast("double")
    crosses = F.col("n2").isNotNull() & ((a * b < 0) | (a == 0))
    level = F.when(a == 0, F.col("strike").cast("double")).otherwise(F.col("strike") + (F.col("k2") - F.col("strike")) * F.try_divide(F.abs(a), F.abs(a) + F.abs(b)))
    sure = F.when(a == 0, 1.0).otherwise(1 - F.try_divide(F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))))
    n = n.withColumn("level", F.when(crosses, level)).withColumn("sure", F.when(crosses, sure))
    found = n.groupBy("symbol", "d", "spot").agg(
        F.count(F.lit(1)).alias("strikes"), F.count("level").alias("crossings"), F.count_if(F.col("level").isNotNull() & (F.col("net_c") == 0)).alias("exact"),
        F.min(F.when(F.col("level").isNotNull(), F.struct(F.abs(F.col("level") - F.col("spot")).alias("far"), "level", "sure"))).alias("best"),
    )
    return found.select(
        "symbol", "d", "spot", "crossings",
        F.when(F.col("strikes") < 2, "INSUFFICIENT_DATA").when(F.col("crossings") == 0, "NO_CROSSING").when((F.col("crossings") == 1) & (F.col("exact") == 1), "EXACT_ZERO").otherwise("FOUND").alias("status"),
        F.round("best.level", 6).alias("flip"), F.round(F.col("best.level") - F.col("spot"), 6).alias("distance"), F.round("best.sure", 6).alias("confidence"),
    )


def walls(strikes: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` strikes of each sign by size, with their distance to spot."""
    side = F.when(F.col("net_c") > 0, "POSITIVE").otherwise("NEGATIVE")
    ranked = strikes.filter("net_c <> 0").withColumn("side", side).withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "d", "side").orderBy(F.desc(F.abs("net_c")), "strike")))
    return ranked.filter(F.col("rank") <= top).select("symbol", "d", "side", "rank", "strike", _money(F.col("net_c")).alias("net_gex"), (F.col("strike") - F.col("spot")).alias("distance"), F.round(F.try_divide((F.col("strike") - F.col("spot")) * 100.0, F.col("spot")), 6).alias("distance_pct"))


def wall_moves(strikes: DataFrame) -> DataFrame:
    """The first wall of each sign and how far it moved since the day before."""
    first = walls(strikes, 1).groupBy("symbol", "d").agg(F.max(F.when(F.col("side") == "POSITIVE", F.col("strike"))).alias("positive"), F.max(F.when(F.col("side") == "NEGATIVE", F.col("strike"))).alias("negative"))
    w = _series(("symbol",))
    return first.select("symbol", "d", "positive", "negative", (F.col("positive") - F.lag("positive").over(w)).alias("positive_move"), (F.col("negative") - F.lag("negative").over(w)).alias("negative_move"))


def concentration(strikes: DataFrame) -> DataFrame:
    """Share of the largest strikes, centroid of exposure and its shift; a small shift is STABLE."""
    size = F.abs("net_c")
    rank = F.row_number().over(Window.partitionBy("symbol", "d").orderBy(F.desc(size), "strike"))
    t = strikes.withColumn("size", size).withColumn("rn", rank).groupBy("symbol", "d", "spot").agg(
        *(F.sum(F.when(F.col("rn") <= n, F.col("size"))).alias(f"t{n}") for n in (3, 5, 10)), F.sum("size").alias("total"), F.sum(F.col("size") * F.col("strike").cast("decimal(20,0)")).alias("moment")
    )
    centre = F.try_divide(F.col("moment").cast("double"), F.col("total").cast("double"))
    t = t.withColumn("centre", centre).withColumn("shift", F.col("centre") - F.lag("centre").over(_series(("symbol",))))
    level = F.greatest(F.col("spot") * 0.001, F.lit(1.0))
    return t.select(
        "symbol", "d", *(F.round(F.try_divide(F.col(f"t{n}") * 100.0, F.col("total")), 6).alias(f"top{n}_pct") for n in (3, 5, 10)),
        F.round("centre", 6).alias("centroid"), F.when(F.abs("shift") <= level, "STABLE").when(F.col("shift") > 0, "UP").when(F.col("shift") < 0, "DOWN").alias("migration"),
    )


def rolling(daily: DataFrame, window: int = 10, partition: Sequence[str] = ("symbol",)) -> DataFrame:
    """Moving mean, velocity a day, volatility of changes, mean-rank percentile and z of |net|."""
    w, trail = _series(partition), _series(partition).rowsBetween(1 - window, 0)
    x = daily.select(*partition, "d", _money(F.col("net_c")).alias("net")).withColumn("delta", F.col("net") - F.lag("net").over(w))
    x = x.withColumn("velocity", F.try_divide("delta", F.datediff("d", F.lag("d").over(w)).cast("double"))).withColumn("size", F.abs("net"))
    x = x.withColumn("seen", F.collect_list("size").over(trail)).withColumn("mean", F.avg("size").over(trail)).withColumn("sd", F.stddev_pop("size").over(trail))
    n = F.size("seen")
    below = F.size(F.filter("seen", lambda v: v < F.col("size"))) + 0.5 * F.size(F.filter("seen", lambda v: v == F.col("size")))
    return x.select(
        *partition, "d", F.round(F.avg("net").over(trail), 6).alias("sma"), F.round("velocity", 8).alias("velocity"),
        F.round(F.when(F.count("delta").over(trail) >= 2, F.stddev_pop("delta").over(trail)), 2).alias("delta_volatility"),
        F.when(n >= 5, F.round(below / n * 100, 6)).alias("percentile"), F.when((n >= 5) & (F.col("sd") > 0), F.round(F.try_divide(F.col("size") - F.col("mean"), "sd"), 4)).alias("z"),
    )


def forward_join(daily: DataFrame, horizon: int = 5) -> DataFrame:
    """Daily net exposure with the return of spot ``horizon`` rows later."""
    later = F.lead("spot", horizon).over(_series(("symbol",)))
    return daily.withColumn("ret", F.round(F.try_divide((later - F.col("spot")) * 100.0, F.col("spot")), 4))
