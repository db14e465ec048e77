"""What strategies are worth if spot, volatility and time were others.

A scenario has the fields of ``SCENARIO``, none where it says nothing. Spot: an absolute one
goes before a share, a share before points. Volatility: one for all legs goes before a shift of each
leg's own; neither falls under ``LEAST_IV``. A leg whose spot or volatility is not known has no model
value, so its strategy is partial.

Legs are dealt out by strategy once and stream through their task a strategy after the other. The grid
is laid over a batch of legs there, so a cell is never a row before it is summed, and no cell is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import prices


class Scenario(NamedTuple):
    name: str
    spot: float | None = None
    spot_pct: float | None = None
    spot_points: float | None = None
    iv: float | None = None
    iv_shift: float | None = None
    days: float | None = None


SCENARIO = Scenario._fields[1:]
#: The least volatility, the yearly rate, and the default grids: shares of spot, volatility points, days.
LEAST_IV, RATE = 1e-4, 0.065
SPOT_STEPS, IV_STEPS, DAY_STEPS = (-0.03, -0.02, -0.01, 0.0, 0.01, 0.02, 0.03), (-0.04, -0.02, 0.0, 0.02, 0.04), (0, 1, 3, 5, 7)


def scenario(name: str, **fields: float) -> Scenario:
    """One scenario by name and the fields that it sets."""
    return Scenario(name, *(None if fields.get(f) is None else float(fields[f]) for f in SCENARIO))


def grid(axis: str = "spot_iv", rows: Sequence[float] | None = None, columns: Sequence[float] | None = None) -> list[Scenario]:
    """The scenarios of a matrix, named by row and column."""
    by = {"spot_iv": ("spot_pct", "iv_shift", SPOT_STEPS, IV_STEPS), "spot_time": ("spot_pct", "days", SPOT_STEPS, DAY_STEPS), "iv_time": ("iv_shift", "days", (-0.05, -0.02, 0.0, 0.02, 0.05), DAY_STEPS)}
    a, b, default_rows, default_columns = by[axis]
    return [scenario(f"{i}:{j}", **{a: r, b: c}) for i, r in enumerate(rows or default_rows) for j, c in enumerate(columns or default_columns)]


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which of them are known."""
    c = batch.column(batch.schema.get_field_index(name))
    known = c.is_valid().to_numpy(zero_copy_only=False)
    return (c.fill_null(0) if c.null_count else c).to_numpy(zero_copy_only=False), known


OPTION = ("call", "spot", "strike", "days", "iv")


class _Options:
    """The options of a batch of legs, each once; what they are worth under a scenario. ``at`` is the place of each leg's."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        at = np.zeros(batch.num_rows, np.int64)
        for c in OPTION:
            each = batch.column(batch.schema.get_field_index(c)).dictionary_encode("encode")
            at = pa.array(at * len(each.dictionary) + each.indices.to_numpy()).dictionary_encode().indices.to_numpy().astype(np.int64)
        self.at, any_leg = at, np.empty(at.max() + 1, np.int64)
        any_leg[at] = np.arange(len(at))
        batch = batch.select(OPTION).take(pa.array(any_leg))
        self.call = _column(batch, "call")[0].astype(bool)
        (self.spot, self.has_spot), (self.strike, self.has_strike), (self.iv, self.has_iv) = (_column(batch, c) for c in ("spot", "strike", "iv"))
        self.days, self.has_days = _column(batch, "days")

    def moved(self, s: Scenario) -> tuple[np.ndarray, np.ndarray]:
        """Spot, and where it is known; one that is not above zero is not."""
        if s.spot is not None:
            at, known = np.full(len(self.call), s.spot), np.ones(len(self.call), bool)
        else:
            at, known = self.spot * (1 + s.spot_pct) if s.spot_pct is not None else self.spot + (s.spot_points or 0.0), self.has_spot
        return at, known & ~(at <= 0)

    def units(self, s: Scenario, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model values at a spot, 0 where there is none, and where there is one."""
        t = np.where(self.has_days, np.maximum(self.days - (s.days or 0.0), 0.0), 0.0) / 365.0
        iv, has_iv = (np.full(len(t), s.iv), True) if s.iv is not None else (self.iv + (s.iv_shift or 0.0), self.has_iv)
        over, live = np.where(self.has_strike, np.where(self.call, at - self.strike, self.strike - at), 0.0), t > 0
        known = known & has_iv & (~live | (self.has_strike & (self.strike >= 0)))
        with np.errstate(all="ignore"):  # what is not known is priced too, and left out
            model = prices(self.call, at, self.strike, t, np.maximum(iv, LEAST_IV), RATE)
        return np.where(known, np.where(live, model, np.maximum(over, 0.0)), 0.0), known


def _dealt(legs: DataFrame, marks: DataFrame, lot_size: int, tasks: int | None) -> DataFrame:
    """Legs and their marks, those of a strategy one after the other in one task; ``legs`` is their number."""
    x = legs.join(marks.withColumn("listed", F.lit(True)), ["symbol", "strike", "type"], "left")
    if tasks:
        x = x.repartition(tasks, "strategy_id")
    side = F.when(F.col("action") == "buy", 1.0).otherwise(-1.0)
    x = x.select(
        "strategy_id", F.coalesce(F.col("type") == "CE", F.lit(False)).alias("call"), F.col("spot").cast("double"), F.col("strike").cast("double"), F.datediff("expiry", "valued_on").alias("days"), F.unix_date("expiry").alias("expiry"),
        F.col("iv").cast("double"), F.col("ltp").cast("double"), F.col("price").cast("double"), (side * F.col("qty") * lot_size).alias("scale"), F.col("listed").isNotNull().alias("listed"),
    )
    # the window deals and sorts: legs that were joined by strategy stay where they are, and a strategy stays in one task whatever Spark makes of that join
    return x.withColumn("legs", F.count(F.lit(1)).over(Window.partitionBy("strategy_id")))


Totals = tuple[np.ndarray, np.ndarray]


def _folded(dealt: DataFrame, columns: Sequence[str], sums: Callable[[pa.RecordBatch, np.ndarray], Totals], told: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``told`` of each strategy's totals, which a task holds for the strategies of one batch.

    ``sums`` has the totals of a batch by strategy, given its legs' strategies, numbered: those that are added
    over the batches of a strategy, and those of which the largest counts (NaN: none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, added, most = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            opens = np.append(who is None or not ids[0].equals(who[0]), np.diff(ids.dictionary_encode("encode").indices.to_numpy()) != 0)
            ids = ids.filter(pa.array(opens))
            a, m = sums(batch, np.cumsum(opens) - opens[0])
            if who is not None:
                ids = pa.concat_arrays([who, ids])
                if opens[0]:
                    a, m = np.concatenate([added, a], axis=1), np.concatenate([most, m], axis=1)
                else:
                    a[:, :1] += added
                    m[:, :1] = np.fmax(m[:, :1], most)
            if len(ids) > 1:
                yield row(ids[:-1], a[:, :-1], m[:, :-1])
            who, added, most = ids[-1:], a[:, -1:].copy(), m[:, -1:].copy()
        if who is not None:
            yield row(who, added, most)

    def row(ids: pa.Array, added: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
        out = told(added, most)
        each = len(next(iter(out.values()))) // len(ids)
        return pa.RecordBatch.from_pydict({"strategy_id": ids.take(pa.array(np.repeat(np.arange(len(ids)), each))) if each != 1 else ids, **out})

    return dealt.select("strategy_id", "legs", *OPTION, *columns).mapInArrow(run, f"strategy_id {dealt.schema['strategy_id'].dataType.simpleString()}, {schema}")


def evaluate(legs: DataFrame, marks: DataFrame, scenarios: Sequence[Scenario], lot_size: int = 1, tasks: int | None = None) -> DataFrame:
    """strategy_id, scenario and its totals; ``legs`` and ``marks`` as the views of ``sources.scenarios``.

    ``value`` and ``pnl`` are over the legs that have a model value, and null without a spot; ``now`` and
    ``change`` (from the market value) are null unless every leg has a market price.
    """
    names, n = [s.name for s in scenarios], len(scenarios)

    def sums(batch: pa.RecordBatch, who: np.ndarray) -> Totals:
        (scale, scaled), (price, priced), (ltp, marked), (expiry, dated) = (_column(batch, c) for c in ("scale", "price", "ltp", "expiry"))
        listed, options, starts = _column(batch, "listed")[0].astype(bool), _Options(batch), np.searchsorted(who, np.arange(who[-1] + 1))
        of = lambda v, known: np.bincount(who, np.where(known, v, 0.0))
        added, most = [np.bincount(who), np.bincount(who, ~marked), np.bincount(who, ~listed), of(scale * ltp, scaled & marked)], [np.where(dated, expiry, np.nan), np.where(dated, -expiry, np.nan)]
        for s in scenarios:
            at, known = options.moved(s)
            most.append(np.where(known, at, np.nan)[options.at])
            added.append(np.bincount(who, known[options.at]))
            unit, known = (v[options.at] for v in options.units(s, at, known))
            whole = known & scaled
            added += [np.bincount(who, ~known), of(scale * unit, whole), of(scale * (unit - price), whole & priced), of(scale * (unit - ltp), whole & marked)]
        return np.array(added, float), np.array([np.fmax.reduceat(v, starts) for v in most])

    def told(added: np.ndarray, most: np.ndarray) -> dict[str, pa.Array]:
        g = added.shape[1]
        every = lambda v: np.repeat(v, n)
        cells, spot = added[4:].reshape(n, 5, g), most[2:].T.ravel()
        of = lambda k: cells[:, k].T.ravel()
        legs, unmarked, unlisted, now = (every(v) for v in added[:4])
        last, first, no_spot = every(most[0]), every(-most[1]), of(0) == 0
        whole = lambda v: pa.array(v.astype(np.int64))
        return {
            "scenario": pa.array(names * g, pa.string()), "legs": whole(legs), "unpriced": whole(of(1)), "unlisted": whole(unlisted), "mixed_expiry": pa.array(first != last, mask=np.isnan(last)), "partial": pa.array(of(1) > 0),
            "spot": pa.array(spot, mask=no_spot), "value": pa.array(of(2), mask=no_spot), "now": pa.array(now, mask=unmarked > 0), "pnl": pa.array(of(3), mask=no_spot), "change": pa.array(of(4), mask=unmarked > 0),
        }

    schema = "scenario string, legs long, unpriced long, unlisted long, mixed_expiry boolean, partial boolean, spot double, value double, now double, pnl double, change double"
    x = _folded(_dealt(legs, marks, lot_size, tasks), ("scale", "price", "ltp", "expiry", "listed"), sums, told, schema)
    return x.withColumns({c: F.round(c, 4) + 0.0 for c in ("spot", "value", "now", "pnl", "change")})


def matrix_extremes(cells: DataFrame) -> DataFrame:
    """Of each strategy's matrix: cells, how many are empty as it is partial there, and its worst and best cell by result (the first of equal ones)."""
    pnl = F.when(~F.col("partial"), F.col("pnl"))
    at = lambda f, sign: f(F.when(pnl.isNotNull(), F.struct((sign * pnl).alias("k"), "scenario")))
    g = cells.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(pnl.isNull()).alias("empty"), F.min(pnl).alias("worst_pnl"), F.max(pnl).alias("best_pnl"), at(F.min, 1).alias("w"), at(F.min, -1).alias("b"))
    return g.select("strategy_id", "cells", "empty", "worst_pnl", F.col("w.scenario").alias("worst_cell"), "best_pnl", F.col("b.scenario").alias("best_cell"))


def _rounded(v: np.ndarray) -> np.ndarray:
    """To four places, halves away from zero."""
    with np.errstate(all="ignore"):
        whole = np.trunc(x := v * 1e4)
        return np.where(np.isfinite(x), (whole + np.sign(x) * (np.abs(x - whole) >= 0.5)) / 1e4, v) + 0.0


def extremes(legs: DataFrame, marks: DataFrame, scenarios: Sequence[Scenario], lot_size: int = 1, tasks: int | None = None) -> DataFrame:
    """``matrix_extremes`` of what ``evaluate`` tells, found where the legs are summed: a strategy is one row, not one for each cell."""
    inner, n = sorted(scenarios, key=lambda s: s.name), len(scenarios)
    names = pa.array([s.name for s in inner], pa.string())

    def sums(batch: pa.RecordBatch, who: np.ndarray) -> Totals:
        (scale, scaled), (price, priced) = _column(batch, "scale"), _column(batch, "price")
        options, unpriced, pnl, before = _Options(batch), [], [], None
        scale = np.where(scaled & priced, scale, 0.0)
        for s in inner:
            unit, known = options.units(s, *options.moved(s))
            pnl.append(np.bincount(who, scale * (unit[options.at] - price)))  # with what a leg without a value adds, the cell is empty
            unpriced.append(unpriced[-1] if np.array_equal(known, before) else np.bincount(who, ~known[options.at]))
            before = known
        return np.array(unpriced + pnl, float), np.empty((0, who[-1] + 1))

    def told(added: np.ndarray, most: np.ndarray) -> dict[str, pa.Array]:
        full = added[:n] == 0
        pnl, none = np.where(full, _rounded(added[n:]), np.nan), ~full.any(axis=0)
        worst, best = np.fmin.reduce(pnl), np.fmax.reduce(pnl)
        # a result that is no number is above all others, and its cell is told only if there is no other
        first = lambda v: names.take(pa.array(np.argmax(full & ((pnl == v) | np.isnan(v)), axis=0), mask=none))
        top = np.where((full & np.isnan(pnl)).any(axis=0), np.nan, best)
        count = lambda v: pa.array(v, pa.int64())
        return {"cells": count(np.full(len(none), n)), "empty": count((~full).sum(axis=0)), "worst_pnl": pa.array(worst, mask=none), "worst_cell": first(worst), "best_pnl": pa.array(top, mask=none), "best_cell": first(best)}

    schema = "cells long, empty long, worst_pnl double, worst_cell string, best_pnl double, best_cell string"
    return _folded(_dealt(legs, marks, lot_size, tasks), ("scale", "price"), sums, told, schema)
