"""Landing data: vendor bar arrays, contract upserts, checkpoints, retention, date chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def _number(x: Column) -> Column:
    return rules.finite(F.try_to_number(F.trim(x), F.lit("S9999999999999.999999")).cast("double"))


def vendor_bars(raw: DataFrame, json_col: str = "raw", option: bool = False) -> DataFrame:
    """Rows of JSON arrays ``[time, open, high, low, close, volume, open interest]`` as bars.

    Rows with fewer than six values (seven for options), without a time or with a price that is no
    number go; a volume or open interest that is no number is 0. Symbols are trimmed, in capitals.
    """
    x = raw.withColumn("a", F.from_json(json_col, "array<string>")).filter(F.size("a") >= (7 if option else 6))
    at = lambda i: F.get("a", F.lit(i))
    prices = {n: _number(at(i)) for i, n in enumerate(("open", "high", "low", "close"), 1)}
    extra = {"volume": F.coalesce(_number(at(5)), F.lit(0.0))} | ({"open_interest": F.coalesce(_number(at(6)), F.lit(0.0))} if option else {})
    out = x.select(F.upper(F.trim("symbol")).alias("symbol"), "arrival", rules.wall_clock(at(0)).alias("open_time"), *(c.alias(n) for n, c in (prices | extra).items()))
    return out.filter(F.col("open_time").isNotNull() & (F.col("symbol") != "")).na.drop(subset=list(prices))


def contract_actions(existing: DataFrame, incoming: DataFrame, key: str, fixed: Sequence[str], fillable: str) -> DataFrame:
    """What an upsert of contracts does: error (no key), insert, conflict (a fixed field differs; the old row stays), filled (an empty ``fillable`` gets its value) or unchanged."""
    old = existing.select(key, *(F.col(c).alias(f"old_{c}") for c in (*fixed, fillable)), F.lit(True).alias("known"))
    x = incoming.join(old, key, "left")
    differs = F.lit(False)
    for c in fixed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    fill = F.col(f"old_{fillable}").isNull() & F.col(fillable).isNotNull()
    clash = F.col(f"old_{fillable}").isNotNull() & F.col(fillable).isNotNull() & (F.col(fillable) != F.col(f"old_{fillable}"))
    action = F.when(F.col(key).isNull(), "error").when(F.col("known").isNull(), "insert").when(differs | clash, "conflict").when(fill, "filled").otherwise("unchanged")
    known = F.col("known").isNotNull()
    kept = [F.when(known, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in fixed]
    return x.withColumn("action", action).select(key, *kept, F.when(F.col("action") == "conflict", F.col(f"old_{fillable}")).otherwise(F.coalesce(f"old_{fillable}", fillable)).alias(fillable), "action")


def checkpoints(log: DataFrame, *by: str) -> DataFrame:
    """The state of each job from its log (status, ts): start of the first RUNNING, end of the last COMPLETED, latest status."""
    of = lambda f, s: f(F.when(F.col("status") == s, F.col("ts")))
    return log.groupBy(*by).agg(of(F.min, "RUNNING").alias("started_at"), of(F.max, "COMPLETED").alias("completed_at"), F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count(F.lit(1)).alias("updates"))


#: Groups whose latest time may go to every task; a row each.
FEW_GROUPS = 10_000


def retained(rows: DataFrame, time_col: str, days: int, *by: str, now: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` (one at least) before ``now``, or else before each group's latest; older ones go.

    The latest times are aggregated, not carried over sorted rows; while there are few groups they go to
    the rows, which then are not shuffled at all. Rows without a time or group go.
    """
    span = F.make_interval(days=F.lit(max(1, days)))
    if now is not None:
        return rows.filter(F.col(time_col) >= now - span)
    last = rows.groupBy(*by).agg(F.max(time_col).alias("_last"))
    few = last.limit(FEW_GROUPS + 1).collect()
    small = len(few) <= FEW_GROUPS
    bounds = F.broadcast(rows.sparkSession.createDataFrame(few, last.schema)) if small else last
    return rows.join(bounds, list(by)).filter(F.col(time_col) >= F.col("_last") - span).select(*rows.columns)


def date_chunks(spans: DataFrame, days: int) -> DataFrame:
    """Spans (name, start, end) in contiguous chunks of at most ``days``, both ends included."""
    step = F.expr(f"INTERVAL {days} DAYS")
    x = spans.filter("start <= end").select("name", "end", F.explode(F.sequence("start", "end", step)).alias("from"))
    return x.select("name", F.col("from").cast("date").alias("from"), F.least(F.date_add(F.col("from").cast("date"), days - 1), F.col("end")).alias("to"))
