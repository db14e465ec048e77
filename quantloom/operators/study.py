"""Research on the exposure series: dataset, the ten signals, grouped outcomes, splits, effects.

``dataset`` has one row for each time of a symbol; windows run within a symbol. Outcomes look ahead,
everything else looks back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import normal_cdf
from . import gex
from .research import describe

HORIZONS = (3, 6, 9, 15, 30, 60)


def _series() -> Window:
    return Window.partitionBy("symbol").orderBy("d")


def dataset(chain: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Net exposure and its changes, regime, distance to the flip (above 0: the flip is above spot), first walls, open interest, and returns ahead."""
    strikes = gex.strike_totals(chain)
    flips = gex.flips(strikes).select("symbol", "d", "flip")
    wall = lambda s: F.max(F.when(F.col("side") == s, F.col("strike")))
    walls = gex.walls(strikes, 1).groupBy("symbol", "d").agg(wall("POSITIVE").alias("wall_pos"), wall("NEGATIVE").alias("wall_neg"))
    base = strikes.groupBy("symbol", "d", "spot").agg(F.sum("net_c").alias("net_c"), F.sum("oi").alias("oi"))
    x = base.join(flips, ["symbol", "d"]).join(walls, ["symbol", "d"], "left")
    w, spot = _series(), F.col("spot")
    x = x.withColumn("before", F.lag("net_c").over(w)).withColumn("change", F.col("net_c") - F.col("before")).withColumn("dist", F.round(F.col("flip") - spot, 6))
    ahead = [F.round(F.try_divide((F.lead("spot", k).over(w) - spot) * 100.0, spot), 4).alias(f"ret_{k}") for k in horizons]
    return x.select(
        "symbol", "d", "spot", "net_c", "before", "change", (F.col("change") - F.lag("change").over(w)).alias("accel"), gex.regime(F.col("net_c")).alias("regime"), "dist", "wall_pos", "wall_neg", "oi",
        (F.col("oi") - F.lag("oi").over(w)).alias("oi_change"), (spot - F.lag("spot").over(w)).alias("up"), (spot - F.lag("spot", 3).over(w)).alias("momentum"), *ahead,
    )


def signals(data: DataFrame, ret: str = "ret_15", slow: str = "ret_30") -> DataFrame:
    """symbol, d, signal, value: each signal that a time gives, with the outcome in the signal's direction."""
    w, c = _series(), F.col
    lag = lambda name, k=1: F.lag(name, k).over(w)
    x = data.withColumn("dist1", lag("dist")).withColumn("dist2", lag("dist", 2)).withColumn("spot1", lag("spot")).withColumn("wall1", lag("wall_pos")).withColumn("i", F.row_number().over(w))
    near = lambda spot, wall, pct: F.abs(spot - wall) * 100.0 / spot < pct
    rules: list[tuple[str, Column, Column]] = [
        ("regime_shift", (c("before") < 0) & (c("net_c") > 0), c(ret)),
        ("flip_break", (c("dist1") < 0) & (c("dist") > 0), c(ret)),
        ("flip_rejection", c("dist2").isNotNull() & (F.abs("dist1") < 30) & (F.abs("dist") > F.abs("dist1") * 1.5), -c(ret)),
        ("positive_pin", (c("net_c") > 0) & near(c("spot"), c("wall_pos"), 0.3), F.abs(slow)),
        ("negative_expansion", (c("net_c") < 0) & (c("change") < 0), F.abs(ret)),
        ("acceleration", c("accel") > 0, c(ret)),
        ("negative_oi_up", (c("net_c") < 0) & (c("oi_change") > 0), -c(ret)),
        ("wall_rejection", (c("i") > 2) & c("wall_pos").isNotNull() & near(c("spot1"), c("wall1"), 0.5) & (c("spot") < c("spot1")), c(ret)),
        ("wall_breakout", (c("spot1") < c("wall1")) & (c("spot") > c("wall_pos")), c(ret)),
        ("divergence", ((c("up") > 0) & (c("change") <= 0)) | ((c("up") <= 0) & (c("change") > 0)), F.when(c("up") > 0, -c(ret)).otherwise(c(ret))),
    ]
    found = F.explode(F.array_compact(F.array(*(F.when(when & value.isNotNull(), F.struct(F.lit(n).alias("signal"), value.alias("value"))) for n, when, value in rules))))
    return x.select("symbol", "d", found.alias("s")).select("symbol", "d", "s.*")


def ranking(found: DataFrame) -> DataFrame:
    """By symbol and signal: statistics, confidence and the rank by the size of the expected value."""
    x = describe(found, "value", "symbol", "signal")
    sure = F.when(F.col("n") < 10, "INSUFFICIENT").when(F.col("n") < 50, "LOW").when(F.col("win_pct").between(45, 55), "MEDIUM").otherwise("HIGH")
    # ten signals a symbol
    return x.select("symbol", "signal", "n", "mean", "win_pct", sure.alias("confidence"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.abs("mean")), "signal")).alias("rank"))


def grouped(data: DataFrame, groups: Mapping[str, Column], value: str) -> DataFrame:
    """Statistics of ``value`` in named, possibly overlapping groups; empty ones have no row."""
    names = F.array_compact(F.array(*(F.when(when, F.lit(n)) for n, when in groups.items())))
    named = data.select("symbol", value, names.alias("names"))
    return describe(named.select("symbol", value, F.explode("names").alias("grp")), value, "symbol", "grp")


def flip_groups() -> dict[str, Column]:
    d, before = F.col("dist"), F.lag("dist").over(_series())
    return {"near": F.abs(d) < 20, "above": (F.abs(d) >= 20) & (d > 0), "below": (F.abs(d) >= 20) & (d < 0), "crossing_up": (before <= 0) & (d > 0), "crossing_down": (before >= 0) & (d < 0)}


def combo_groups() -> dict[str, Column]:
    """Change, momentum and open-interest groups; where exposure is named negative, zero is in."""
    c, w = F.col, _series()
    pos, up, rising, more = c("net_c") > 0, c("momentum") > 0, c("change") > 0, c("oi_change") > 0
    last = F.lag("change").over(w)
    return {
        "increasing": c("change") > 0, "decreasing": c("change") < 0, "flat": c("change") == 0,
        "pos_up": pos & up, "pos_down": pos & ~up, "neg_up": ~pos & up, "neg_down": ~pos & ~up, "rising_up": rising & up, "rising_down": rising & ~up, "falling_up": ~rising & up, "falling_down": ~rising & ~up,
        "rising_twice": rising & (last > 0), "falling_twice": (c("change") < 0) & (last < 0), "accelerating": c("accel") > 0, "decelerating": c("accel") < 0, "turned_positive": (c("before") < 0) & pos, "turned_negative": (c("before") > 0) & (c("net_c") < 0),
        "pos_oi_up": pos & more, "pos_oi_down": pos & ~more, "neg_oi_up": ~pos & more, "neg_oi_down": ~pos & ~more, "rising_oi_up": rising & more, "rising_oi_down": rising & ~more, "falling_oi_up": ~rising & more, "falling_oi_down": ~rising & ~more,
        "thursday": F.weekday("d") == 3, "other_day": F.weekday("d") != 3,
    }


def regime_by_horizon(data: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    x = data.select("symbol", "regime", F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.col(f"ret_{k}").alias("ret")) for k in horizons))).alias("h")).select("symbol", "regime", "h.*")
    return describe(x, "ret", "symbol", "regime", "horizon")


def wall_events(data: DataFrame, touch_pct: float = 0.5, break_pct: float = 0.3, back_pct: float = 0.5, ahead: int = 10) -> DataFrame:
    """symbol, side, event, n: what follows when spot comes near a wall; the first event wins.

    Positive walls break upwards, negative ones downwards. Times with fewer than three after them are
    not looked at, nor are negative walls without a positive one.
    """
    w = _series()
    x = data.withColumn("later", F.collect_list("spot").over(w.rowsBetween(1, ahead))).filter(F.size("later") >= 3)
    sides = F.array(F.struct(F.lit("POSITIVE").alias("side"), F.lit(1).alias("sign"), F.col("wall_pos").alias("wall")), F.struct(F.lit("NEGATIVE").alias("side"), F.lit(-1).alias("sign"), F.col("wall_neg").alias("wall")))
    x = x.filter("wall_pos is not null").select("symbol", "spot", "later", F.explode(sides).alias("s")).select("symbol", "spot", "later", "s.*")
    x = x.filter(F.abs(F.col("wall") - F.col("spot")) * 100.0 / F.col("spot") < touch_pct)
    beyond = lambda v: (v - F.col("wall")) * F.col("sign") * 100.0 / F.col("wall")
    event = F.get(F.filter(F.transform("later", lambda v: F.when(beyond(v) > break_pct, "BREAK").when(beyond(v) < -back_pct, "REJECTION")), lambda e: e.isNotNull()), F.lit(0))
    return x.groupBy("symbol", "side", F.coalesce(event, F.lit("TOUCH")).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def walk_forward(data: DataFrame, share: float = 0.7) -> DataFrame:
    """Signals in the first ``share`` of a symbol's times and in the rest; lags start anew at the split."""
    n, r = F.count(F.lit(1)).over(Window.partitionBy("symbol")), F.row_number().over(_series())
    parted = data.withColumn("part", F.when(r <= F.floor(n * share), "train").otherwise("test"))
    # each part is a series of its own
    own = parted.withColumn("symbol", F.concat_ws("|", "symbol", "part"))
    w = _series()
    own = own.withColumn("before", F.lag("net_c").over(w)).withColumn("change", F.col("net_c") - F.col("before")).withColumn("oi_change", F.col("oi") - F.lag("oi").over(w)).withColumn("up", F.col("spot") - F.lag("spot").over(w))
    own = own.withColumn("accel", F.col("change") - F.lag("change").over(w))
    x = describe(signals(own), "value", "symbol", "signal").withColumn("p", F.split("symbol", r"\|"))
    return x.select(F.col("p")[0].alias("symbol"), F.col("p")[1].alias("part"), "signal", "n", F.round("mean", 4).alias("mean"), "win_pct")


def quintile_effect(data: DataFrame, feature: str, outcome: str, least: int = 200) -> DataFrame:
    """By symbol with at least ``least`` rows: outcome of the top and bottom fifth, lift, spread and Cohen's d."""
    x = data.filter(F.col(feature).isNotNull() & F.col(outcome).isNotNull())
    all_ = Window.partitionBy("symbol")
    n = F.count(F.lit(1)).over(all_)
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(feature, "d")) - 1
    x = x.withColumn("n", n).withColumn("q", F.least(F.floor(r / F.floor(n / 5)), F.lit(4)) + 1).filter(F.col("n") >= least)
    of = lambda f, q: f(F.when(F.col("q") == q, F.col(outcome)))
    g = x.groupBy("symbol", "n").agg(F.avg(outcome).alias("m"), of(F.avg, 1).alias("m1"), of(F.avg, 5).alias("m5"), of(F.var_samp, 1).alias("v1"), of(F.var_samp, 5).alias("v5"), of(F.count, 1).alias("n1"), of(F.count, 5).alias("n5"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n5") - 1) * F.col("v5"), F.col("n1") + F.col("n5") - 2))
    return g.select("symbol", "n", F.round("m1", 6).alias("bottom"), F.round("m5", 6).alias("top"), F.round(F.col("m5") - F.col("m"), 6).alias("lift"), F.round(F.col("m5") - F.col("m1"), 6).alias("spread"), F.round(F.try_divide(F.col("m5") - F.col("m1"), pooled), 6).alias("cohen_d"))


def t_test(data: DataFrame, value: str, *by: str) -> DataFrame:
    """One-sample t of the mean with its two-sided p: the normal tail beyond 30 degrees of freedom, steps below."""
    x = data.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    t = F.try_divide(F.col("m"), F.col("sd") / F.sqrt("n"))
    x = x.withColumn("t", t)
    size = F.abs("t")
    steps = F.when(size > 3.5, 0.001).when(size > 2.75, 0.01).when(size > 2.04, 0.05).when(size > 1.7, 0.1).otherwise(0.5)
    half = F.col("sd") / F.sqrt("n") * 1.96
    return x.select(
        *by, "n", F.round("m", 6).alias("mean"), F.round("t", 6).alias("t"), F.round(F.when(F.col("n") > 31, 2 * (1 - normal_cdf(size))).otherwise(steps), 6).alias("p"),
        F.round(F.col("m") - half, 6).alias("low95"), F.round(F.col("m") + half, 6).alias("high95"), F.round(F.try_divide(F.col("m"), F.col("sd")), 6).alias("cohen_d"),
    )


def regimes_by_percentile(data: DataFrame, feature: str, outcome: str) -> DataFrame:
    """Outcome below the interpolated 20th, above the 80th percentile of a symbol's feature, and between."""
    levels = data.groupBy("symbol").agg(F.percentile(feature, 0.2).alias("p20"), F.percentile(feature, 0.8).alias("p80"))
    v = F.col(feature)
    band = F.when(v <= F.col("p20"), "LOW").when(v >= F.col("p80"), "HIGH").otherwise("MID")
    return data.join(levels, "symbol").filter(F.col(outcome).isNotNull()).groupBy("symbol", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(outcome), 8).alias("mean"))


def split_windows(data: DataFrame, outcome: str, train: int = 300, test: int = 100, step: int = 100) -> DataFrame:
    """Rolling train and test windows of a symbol: mean outcome in both, agreement in sign, degradation."""
    x = data.filter(F.col(outcome).isNotNull()).withColumn("i", F.row_number().over(_series()) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    # a row is in the few windows that reach over it
    first = F.greatest(F.ceil((F.col("i") - (train + test - 1)) / step), F.lit(0))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - train - test) / step))
    x = x.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("part", F.when(F.col("i") - F.col("k") * step < train, "train").otherwise("test"))
    of = lambda p: F.avg(F.when(F.col("part") == p, F.col(outcome)))
    g = x.groupBy("symbol", "k").agg(of("train").alias("a"), of("test").alias("b"))
    return g.select("symbol", F.col("k").alias("window"), F.round("a", 6).alias("train"), F.round("b", 6).alias("test"), (F.signum("a") == F.signum("b")).alias("agrees"), F.round(1 - F.try_divide(F.abs("b"), F.abs("a")), 6).alias("degradation"))


def bootstrap(data: DataFrame, value: str, replicates: int = 100) -> DataFrame:
    """By symbol: mean and the 95 % interval of resampled means. Draws come from a digest, so runs repeat.

    Every replicate draws as many rows as there are; draws are rows of a join, none is kept in one task.
    """
    x = data.filter(F.col(value).isNotNull()).select("symbol", F.col(value).alias("v"), (F.row_number().over(_series()) - 1).cast("long").alias("i"))
    sizes = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    draws = x.select("symbol", "i").join(sizes, "symbol").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    picked = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "i").cast("binary")), 1, 8), 16, 10).cast("long"), F.col("n"))
    means = draws.select("symbol", "rep", picked.alias("i")).join(x, ["symbol", "i"]).groupBy("symbol", "rep").agg(F.avg("v").alias("m"))
    return means.groupBy("symbol").agg(F.count(F.lit(1)).alias("replicates"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


def rolling_windows(data: DataFrame, value: str, days: int = 90, slide: int = 30, least: int = 5) -> DataFrame:
    """Statistics in windows of ``days`` that slide by ``slide``, by symbol; ``least`` rows at least."""
    x = data.filter(F.col(value).isNotNull()).withColumn("w", F.window(F.col("d").cast("timestamp"), f"{days} days", f"{slide} days"))
    g = x.groupBy("symbol", F.to_date("w.start").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg((F.col(value) > 0).cast("int")) * 100, 4).alias("win_pct"))
    return g.filter(F.col("n") >= least)
