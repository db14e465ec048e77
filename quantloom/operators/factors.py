"""Factor research: features of each time of a series, and what returns follow them.

``features`` gives one row for each time of a symbol from one pass over its chain; windows run within
a symbol. The screens unpivot these rows once, so a further feature or family is no further pass.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gex import exclusion_reason

#: Rows ahead of each horizon.
HORIZONS = {"15m": 5, "30m": 10, "60m": 20}
#: Features that are screened by their quartiles, and those screened by group.
NUMERIC = (
    "net_gex", "abs_gex", "gex_change", "gex_change_pct", "gex_acceleration", "price_momentum_pct", "price_acceleration", "ce_pe_ratio", "gex_imbalance", "total_oi", "oi_change",
    "call_oi_change", "put_oi_change", "vol_oi_ratio", "atm_iv", "iv_skew", "iv_change", "flip_distance", "pos_wall_dist_pct", "neg_wall_dist_pct", "gex_momentum_align",
)
GROUPED = ("regime", "oi_class", "regime_momentum")


def _series() -> Window:
    return Window.partitionBy("symbol").orderBy("d")


def _double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _lag0(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(_series())


def _direction(up: Column, names: tuple[str, str, str]) -> Column:
    return F.when(up > 0, names[0]).when(up < 0, names[1]).otherwise(names[2])


def features(chain: DataFrame, near: int = 100, volume: str = "ltp") -> DataFrame:
    """symbol, d, idx and 40 features; differences are 0 on a symbol's first rows, not null.

    Volatility is the mean of options of one side within ``near`` of spot, in 1/10,000. The chain of a
    time has one row a strike after the first aggregate, so the array of its strikes is bounded by
    what an exchange lists. ``volume``: the column that stands for it.
    """
    call, put = F.col("option_type") == "CE", F.col("option_type") == "PE"
    raw = F.col("gamma_c") * F.col("oi") * F.col("spot") * F.col("spot")
    x = chain.withColumn("g", F.when(exclusion_reason().isNull(), F.when(call, raw).otherwise(-raw))).filter(call | put)
    iv = F.when((F.abs(F.col("strike") - F.col("spot")) <= near) & (F.col("iv_bp") > 0), F.col("iv_bp"))
    of = lambda f, side, c: f(F.when(side, c))
    sides = (("call", call), ("put", put))
    k = x.groupBy("symbol", "d", "strike").agg(
        F.min("spot").alias("spot"), F.sum("g").alias("net"), F.sum(F.abs("g")).alias("gross"), *(of(F.sum, s, F.col("g")).alias(f"{n}_g") for n, s in sides),
        *(of(F.sum, s, F.col("oi")).alias(f"{n}_oi") for n, s in sides), *(of(F.sum, s, F.col(volume)).alias(f"{n}_vol") for n, s in sides),
        *(of(F.sum, s, iv).alias(f"{n}_iv") for n, s in sides), *(of(F.count, s, iv).alias(f"{n}_ivs") for n, s in sides),
    )
    strikes = F.array_sort(F.collect_list(F.when(F.col("net").isNotNull(), F.struct("strike", "net"))))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = k.groupBy("symbol", "d").agg(
        F.min("spot").alias("spot"), F.sum("gross").alias("abs_gex"), *(zero(f"{n}_g").alias(f"{m}_gex") for n, m in (("call", "ce"), ("put", "pe"))), *(zero(f"{n}_{w}").alias(f"{n}_{w}") for w in ("oi", "vol") for n, _ in sides),
        *(F.try_divide(F.sum(f"{n}_iv"), F.sum(f"{n}_ivs")).alias(f"{m}_iv") for n, m in (("call", "ce"), ("put", "pe"))), strikes.alias("strikes"),
    ).filter("abs_gex is not null")
    # neighbouring strikes of opposite sign, and the largest of each sign
    pairs = F.zip_with(F.slice("strikes", 1, F.greatest(F.size("strikes") - 1, F.lit(0))), F.slice("strikes", 2, F.size("strikes")), lambda a, b: F.struct(a["strike"].alias("k1"), _double(a["net"]).alias("g1"), b["strike"].alias("k2"), _double(b["net"]).alias("g2")))
    crossed = F.filter(pairs, lambda p: p["g1"] * p["g2"] < 0)
    levels = F.transform(crossed, lambda p: p["k1"] - p["g1"] * (p["k2"] - p["k1"]) / (p["g2"] - p["g1"]))
    flip = F.array_min(F.transform(levels, lambda v: F.struct(F.abs(v - F.col("spot")).alias("far"), v.alias("level"))))["level"]
    wall = lambda sign: F.array_min(F.transform(F.filter("strikes", lambda s: s["net"] * sign > 0), lambda s: F.struct((-s["net"] * sign).alias("size"), s["strike"].alias("strike"))))["strike"]
    t = t.select("*", (F.col("ce_gex") + F.col("pe_gex")).alias("net_gex"), F.round(flip, 6).alias("gamma_flip"), wall(1).alias("pos_wall"), wall(-1).alias("neg_wall"), (F.col("call_oi") + F.col("put_oi")).alias("total_oi"), (F.col("call_vol") + F.col("put_vol")).alias("total_vol"))
    t = t.withColumn("atm_iv", (F.col("ce_iv") + F.col("pe_iv")) / 2)
    up, before, last_iv = F.col("spot") - _lag0("spot"), _lag0("net_gex"), _lag0("atm_iv")
    first = lambda c: F.coalesce(c, F.lit(0))
    t = t.select(
        "*", (F.row_number().over(_series()) - 1).alias("idx"), first(F.col("net_gex") - before).alias("gex_change"), first(F.try_divide(_double(F.col("net_gex") - before) * 100.0, _double(F.abs(before)))).alias("gex_change_pct"),
        first(F.col("net_gex") - 2 * before + _lag0("net_gex", 2)).alias("gex_acceleration"), first(up).alias("price_momentum"), first(_double(up) * 100.0 / _lag0("spot")).alias("price_momentum_pct"), first(F.col("spot") - 2 * _lag0("spot") + _lag0("spot", 2)).alias("price_acceleration"),
        *(first(F.col(c) - _lag0(c)).alias(f"{n}_change") for c, n in (("total_oi", "oi"), ("call_oi", "call_oi"), ("put_oi", "put_oi"))), (F.col("atm_iv") - last_iv).alias("iv_change"),
    )
    share = lambda c: F.coalesce(F.try_divide(_double(c), _double("abs_gex")), F.lit(0.0))
    momentum, change, oi = F.col("price_momentum"), F.col("gex_change"), F.col("oi_change")
    regime = F.when(F.col("net_gex") > 0, "POS_GAMMA").when(F.col("net_gex") < 0, "NEG_GAMMA").otherwise("NEUTRAL")
    walls = [c for n in ("pos", "neg") for c in ((F.col(f"{n}_wall") - F.col("spot")).alias(f"{n}_wall_dist"), (_double(F.col(f"{n}_wall") - F.col("spot")) * 100.0 / F.col("spot")).alias(f"{n}_wall_dist_pct"))]
    moved = (momentum != 0) & (F.col("net_gex") != 0)
    return t.select(
        "symbol", "d", "idx", "spot", "net_gex", "abs_gex", "ce_gex", "pe_gex", F.abs(F.try_divide(_double("ce_gex"), _double("pe_gex"))).alias("ce_pe_ratio"), share("net_gex").alias("gex_imbalance"),
        share(F.greatest("ce_gex", F.lit(0))).alias("pos_conc"), share(F.abs(F.least("pe_gex", F.lit(0)))).alias("neg_conc"), regime.alias("regime"), "gex_change", "gex_change_pct", "gex_acceleration",
        "price_momentum", "price_momentum_pct", "price_acceleration", "total_oi", "call_oi", "put_oi", F.try_divide(_double("call_oi"), _double("put_oi")).alias("oi_ratio"), "total_vol", "call_vol", "put_vol",
        F.try_divide(_double("total_vol"), _double("total_oi")).alias("vol_oi_ratio"), "oi_change", "call_oi_change", "put_oi_change",
        F.when((oi == 0) | (momentum == 0), "NEUTRAL").when(oi > 0, F.when(momentum > 0, "LONG_BUILDUP").otherwise("SHORT_BUILDUP")).otherwise(F.when(momentum > 0, "SHORT_COVERING").otherwise("LONG_UNWINDING")).alias("oi_class"),
        "ce_iv", "pe_iv", "atm_iv", (F.col("pe_iv") - F.col("ce_iv")).alias("iv_skew"), "iv_change", "gamma_flip", F.round(F.col("gamma_flip") - F.col("spot"), 6).alias("flip_distance"), "pos_wall", "neg_wall", *walls,
        F.when(momentum == 0, 0).when(F.signum(change) == F.signum(momentum), 1).otherwise(-1).alias("gex_momentum_align"),
        F.when(moved, F.concat(regime, _direction(momentum, ("_UP", "_DOWN", "")))).otherwise("NEUTRAL").alias("regime_momentum"),
    )


def with_returns(rows: DataFrame, horizons: Mapping[str, int] = HORIZONS) -> DataFrame:
    """Rows with ``ret_<horizon>``: the change of spot in per cent so many rows ahead."""
    return rows.select("*", *(F.round((F.lead("spot", k).over(_series()) - F.col("spot")) * 100.0 / F.col("spot"), 4).alias(f"ret_{h}") for h, k in horizons.items()))


def tail_p(t: Column, n: Column) -> Column:
    """Two-sided p of a t value: the leading term of the normal tail beyond 31 rows, steps below."""
    size = F.abs(t)
    tail = F.when(size > 0, F.exp(-0.5 * size * size) / (size * math.sqrt(2 * math.pi))).otherwise(0.5)
    steps = F.when(size > 4, 0.001).when(size > 3, 0.005).when(size > 2.5, 0.02).when(size > 2.0, 0.05).when(size > 1.5, 0.15).otherwise(0.3)
    return F.when(n < 2, 1.0).when(n > 31, F.least(2 * tail, F.lit(1.0))).otherwise(steps)


def _tested(groups: DataFrame) -> DataFrame:
    """t, p and effect of groups with ``n``, ``m`` and ``sd``; a group without spread has t 0."""
    t = F.coalesce(F.try_divide(F.col("m"), F.col("sd") / F.sqrt("n")), F.lit(0.0))
    return groups.withColumn("t_stat", t).withColumn("p_value", F.round(tail_p(F.col("t_stat"), F.col("n")), 8)).withColumn("effect", F.round(F.coalesce(F.try_divide("m", "sd"), F.lit(0.0)), 6)).withColumn("t_stat", F.round("t_stat", 6))


def exact_mean(value: Column, when: Column | None = None) -> Column:
    """The mean of values of four digits from a sum of integers, so it does not depend on their order."""
    scaled = F.round(value * 10_000).cast("long")
    kept = scaled if when is None else F.when(when, scaled)
    return F.try_divide(F.sum(kept), F.count(kept)) / 10_000.0


def _moments(ret: str = "ret") -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), exact_mean(F.col(ret)).alias("m"), F.stddev_samp(ret).alias("sd"), F.round(F.avg(F.when(F.col(ret) > 0, 100.0).otherwise(0.0)), 8).alias("win_pct")]


def screen(rows: DataFrame, numeric: Sequence[str] = NUMERIC, grouped: Sequence[str] = GROUPED, horizons: Sequence[str] = tuple(HORIZONS)) -> DataFrame:
    """One test a row: the outer quartiles of each feature and the groups of each class, at each horizon.

    ``t`` is of the quartiles' returns together, as one list; p-values are adjusted over a symbol's
    whole set of tests (Benjamini-Hochberg), which has as many rows as there are tests.
    """
    horizon = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in horizons)))
    named = F.array(*(F.struct(F.lit(c).alias("feature"), _double(c).alias("value"), F.lit(None).cast("string").alias("cls")) for c in numeric), *(F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("value"), F.col(c).alias("cls")) for c in grouped))
    long = rows.select("symbol", "d", horizon.alias("h"), named.alias("f")).filter("h.ret is not null").select("symbol", "d", "h.*", F.explode("f").alias("f")).select("symbol", "d", "horizon", "ret", "f.*").filter("value is not null or cls is not null")
    by = Window.partitionBy("symbol", "horizon", "feature", "cls")
    long = long.withColumn("total", F.count(F.lit(1)).over(by)).withColumn("i", F.row_number().over(by.orderBy("value", "d")) - 1)
    quarter = F.when(F.col("cls").isNotNull(), 0).when(F.col("i") < F.floor(F.col("total") / 4), 1).when(F.col("i") >= F.floor(3 * F.col("total") / 4), 4)
    kept = long.withColumn("q", quarter).filter(F.col("q").isNotNull() & (F.col("total") >= F.when(F.col("cls").isNull(), 20).otherwise(10)))
    mean = lambda q: exact_mean(F.col("ret"), F.col("q") == q)
    tests = _tested(kept.groupBy("symbol", "horizon", "feature", "cls").agg(*_moments(), mean(1).alias("q1_mean"), mean(4).alias("q4_mean")))
    order = ("p_value", "horizon", "feature", F.coalesce("cls", F.lit("")))
    up = Window.partitionBy("symbol").orderBy(*order)
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    tests = tests.withColumn("raw", F.least(F.col("p_value") * size / F.row_number().over(up), F.lit(1.0)))
    adjusted = F.min("raw").over(up.rowsBetween(0, Window.unboundedFollowing))
    return tests.select("symbol", "horizon", "feature", "cls", "n", "q1_mean", "q4_mean", F.coalesce(F.col("q4_mean") - F.col("q1_mean"), F.col("m")).alias("spread"), F.col("m").alias("mean"), "win_pct", "t_stat", "p_value", F.round(adjusted, 8).alias("adj_p_value"), "effect")


def _families() -> dict[str, Column]:
    momentum = _direction(F.col("price_momentum"), ("UP", "DOWN", "FLAT"))
    iv = F.when(F.col("iv_change") > 0.001, "IV_UP").when(F.col("iv_change") < -0.001, "IV_DOWN").when(F.col("iv_change").isNotNull(), "IV_FLAT")
    far = F.col("flip_distance")
    near = lambda c: F.abs(F.col(c)) < 0.5
    return {
        "regime_momentum": F.concat_ws("_", "regime", momentum),
        "align_oi": F.concat(F.lit("gma="), F.col("gex_momentum_align").cast("string"), F.lit("_oi="), F.col("oi_class")),
        "regime_iv": F.concat(F.col("regime"), F.lit("_"), iv),
        "positive_wall": F.when(near("pos_wall_dist_pct"), F.concat(F.lit("NEAR_POS_WALL_"), momentum)),
        "negative_wall": F.when(near("neg_wall_dist_pct"), F.concat(F.lit("NEAR_NEG_WALL_"), momentum)),
        "regime_flip": F.concat(F.col("regime"), F.lit("_"), F.when(F.abs(far) < 30, "NEAR_FLIP").when(far > 0, "ABOVE_FLIP").when(far <= 0, "BELOW_FLIP")),
    }


def combinations(rows: DataFrame, ret: str = "ret_15m", least: int = 10, least_at_walls: int = 5) -> DataFrame:
    """Returns by family and group of two factors, every family in one aggregate."""
    named = F.array(*(F.struct(F.lit(n).alias("family"), g.alias("grp")) for n, g in _families().items()))
    long = rows.filter(F.col(ret).isNotNull()).select("symbol", F.col(ret).alias("ret"), F.explode(named).alias("f")).select("symbol", "ret", "f.*").filter("grp is not null")
    found = _tested(long.groupBy("symbol", "family", "grp").agg(*_moments()))
    enough = F.when(F.col("family").isin("positive_wall", "negative_wall"), least_at_walls).otherwise(least)
    return found.filter(F.col("n") >= enough).select("symbol", "family", "grp", "n", F.col("m").alias("mean"), "win_pct", "t_stat", "p_value")


def interaction(rows: DataFrame, a: str, b: str, ret: str, least: int = 50) -> DataFrame:
    """By symbol: terciles of two features, the effect of the middle over the low of ``a`` at low and at high ``b``, and how much they differ."""
    x = rows.select("symbol", _double(a).alias("a"), _double(b).alias("b"), F.col(ret).alias("ret")).dropna()
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    at = lambda c, share: F.max(F.when(F.col(f"r{c}") == F.floor(share * F.col("n") / 3), F.col(c))).over(Window.partitionBy("symbol"))
    x = x.withColumn("n", n).withColumn("ra", F.row_number().over(Window.partitionBy("symbol").orderBy("a")) - 1).withColumn("rb", F.row_number().over(Window.partitionBy("symbol").orderBy("b")) - 1)
    x = x.filter(F.col("n") >= least).select("symbol", "a", "b", "ret", "n", at("a", 1).alias("t1a"), at("a", 2).alias("t2a"), at("b", 1).alias("t1b"), at("b", 2).alias("t2b"))
    level = lambda c: F.when(F.col(c) <= F.col(f"t1{c}"), "L").when(F.col(c) >= F.col(f"t2{c}"), "H").otherwise("M")
    x = x.withColumn("cell", F.concat(level("a"), level("b")))
    mean = lambda cell: F.coalesce(exact_mean(F.col("ret"), F.col("cell") == cell), F.lit(0.0))
    count = lambda cell: F.count_if(F.col("cell") == cell).alias(f"n_{cell.lower()}")
    g = x.groupBy("symbol", "n", "t1a", "t2a", "t1b", "t2b").agg((mean("ML") - mean("LL")).alias("low"), (mean("MH") - mean("LH")).alias("high"), *(count(p + q) for p in "LMH" for q in "LMH"))
    cells = [f"n_{p}{q}" for p in "lmh" for q in "lmh"]
    return g.select("symbol", "n", "t1a", "t2a", "t1b", "t2b", *cells, F.col("low").alias("effect_at_low_b"), F.col("high").alias("effect_at_high_b"), F.abs(F.col("high") - F.col("low")).alias("magnitude"))


def _candidates() -> dict[str, Column]:
    c, up = F.col, F.col("price_momentum")
    regimes = {f"{r}_{n}": (c("regime") == r) & when for r in ("NEG_GAMMA", "POS_GAMMA") for n, when in (("UP", up > 0), ("DOWN", up < 0))}
    return regimes | {
        "LOW_VOL_RANGING": up == 0, "IV_EXPANDING": c("iv_change") > 0.001, "IV_CONTRACTING": c("iv_change") < -0.001, "HIGH_OI_BUILDUP": (c("oi_change") > 0) & (up > 0),
        "SHORT_COVERING": (c("oi_change") < 0) & (up > 0), "GEX_POS_MOM_ALIGN": c("gex_momentum_align") == 1, "GEX_NEG_MOM_ALIGN": c("gex_momentum_align") == -1,
    }


def walk_forward(rows: DataFrame, ret: str = "ret_15m", splits: tuple[float, float] = (0.6, 0.8), least: int = 5) -> DataFrame:
    """Eleven conditions by three parts in time, all from one aggregate; parts with few rows are named so."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    part = F.when(F.col("idx") < F.floor(n * splits[0]), "Train").when(F.col("idx") < F.floor(n * splits[1]), "Val").otherwise("Test")
    names = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in _candidates().items())))
    # the parts are of all times, before conditions repeat or drop any
    parted = rows.select("symbol", part.alias("part"), F.col(ret).alias("ret"), names.alias("names"))
    long = parted.filter("ret is not null").select("symbol", "part", "ret", F.explode("names").alias("candidate"))
    found = _tested(long.groupBy("symbol", "candidate", "part").agg(*_moments()))
    enough = F.col("n") >= least
    told = [F.when(enough, F.col(c)).alias(c) for c in ("win_pct", "t_stat", "p_value")]
    return found.select("symbol", "candidate", "part", "n", enough.alias("sufficient"), F.when(enough, F.col("m")).alias("mean"), *told)


def block_bootstrap(rows: DataFrame, value: str, by: Sequence[str], order: str, block: int = 2, replicates: int = 2000, level: float = 0.95, least: int | None = None) -> DataFrame:
    """Mean of a series with the interval and error of means over blocks drawn with replacement.

    A replicate draws as many blocks of ``block`` neighbours as cover the series and cuts the last to its
    length. A block is one row, its sum taken from running sums, so a replicate costs a row a block and
    nothing is resampled row by row. Draws are digests of replicate and place, so runs repeat. A series
    shorter than ``least`` rows (two blocks) has no interval.
    """
    series = Window.partitionBy(*by).orderBy(order)
    scaled = F.round(F.col(value) * 10_000).cast("long")  # sums of integers do not depend on their order
    x = rows.filter(F.col(value).isNotNull()).select(*by, order, scaled.alias("v"))
    x = x.select(*by, "v", (F.row_number().over(series) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"), F.sum("v").over(series.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    size = x.groupBy(*by).agg(F.max("n").alias("n"), F.sum("v").alias("total"))
    enough = size.filter(F.col("n") >= (2 * block if least is None else least))
    blocks = F.ceil(F.col("n") / block)
    # few rows become many: they are dealt out before, by what their sums are grouped by
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = enough.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(tasks, *by, "rep")
    draws = reps.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "b").cast("binary")), 1, 8), 16, 10).cast("long")
    draws = draws.select(*by, "rep", "n", F.pmod(digest, F.col("n") - block + 1).alias("i"), F.least(F.lit(block).cast("long"), F.col("n") - F.col("b") * block).alias("len"))
    # the sum of len rows from i on: the running sum at their end, less that before them
    starts = x.withColumn("ahead", F.collect_list("upto").over(Window.partitionBy(*by).orderBy("i").rowsBetween(0, block - 1))).select(*by, "i", (F.col("upto") - F.col("v")).alias("before"), "ahead")
    sums = draws.join(starts, [*by, "i"]).withColumn("s", F.element_at("ahead", F.col("len").cast("int")) - F.col("before"))
    means = sums.groupBy(*by, "rep", "n").agg(F.sum("s").alias("s")).withColumn("m", F.col("s") / F.col("n") / 10_000.0)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("m", "rep")) - 1
    tail = (1 - level) / 2
    low, high = math.floor(tail * replicates + 1e-9), math.floor((1 - tail) * replicates + 1e-9) - 1
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("m")))
    told = means.withColumn("rank", rank).groupBy(*by).agg(at(low).alias("ci_low"), at(high).alias("ci_high"), F.round(F.stddev_samp("m"), 6).alias("se"))
    return size.join(told, list(by), "left").select(*by, "n", (F.col("total") / F.col("n") / 10_000.0).alias("mean"), "ci_low", "ci_high", "se")
