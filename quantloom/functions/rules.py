"""Scalar rules of the market: session times, buckets, normalisers, rounding, cash and comparison.

All are Column expressions and stay inside whole-stage code.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes after midnight of the session, India time.
OPEN, CLOSE = 9 * 60 + 15, 15 * 60 + 30


# time


def wall_clock(stamp: Column) -> Column:
    """India wall clock of an ISO string; one with an offset is shifted, one without is kept, others are null."""
    bare = F.nullif(F.trim(stamp), F.lit(""))
    aware = bare.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    shifted = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.try_to_timestamp(bare).cast("timestamp_ntz"))
    return F.when(aware, shifted).otherwise(F.try_to_timestamp(bare).cast("timestamp_ntz"))


def minute_of_day(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def in_session(t: Column) -> Column:
    """09:15 to 15:30, both included, by the minute."""
    return minute_of_day(t).between(OPEN, CLOSE)


def after_close(t: Column) -> Column:
    return minute_of_day(t).between(15 * 60 + 27, 15 * 60 + 40)


def iso_offset(t: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")), F.lit(""))


def trading_day(d: Column, holidays: Iterable[str] = ()) -> Column:
    """Monday to Friday and no holiday."""
    days = list(holidays)
    return (F.weekday(d) < 5) & (~F.date_format(d, "yyyy-MM-dd").isin(days) if days else F.lit(True))


def calendar_status(t: Column, holidays: Iterable[str] = ()) -> Column:
    """Weekend, then holiday, then before the open, after the close, or open; seconds count."""
    second = minute_of_day(t) * 60 + F.second(t)
    return (
        F.when(F.weekday(t) >= 5, "WEEKEND")
        .when(~trading_day(t, holidays), "HOLIDAY")
        .when(second < OPEN * 60, "BEFORE_OPEN")
        .when(second > CLOSE * 60, "AFTER_CLOSE")
        .otherwise("OPEN")
    )


def time_of_day(t: Column) -> Column:
    m = minute_of_day(t)
    return F.when(m < OPEN, "pre").when(m < 660, "morning").when(m < 780, "midday").when(m <= 930, "afternoon").otherwise("post")


def interval_minutes(name: Column) -> Column:
    """``3min`` is 3, ``1hour`` is 60, anything else 3."""
    n = F.regexp_extract(name, r"^(\d+)(min|hour)$", 1)
    unit = F.regexp_extract(name, r"^(\d+)(min|hour)$", 2)
    return F.when(unit == "hour", F.expr("0") + F.try_to_number(n, F.lit("999999")).cast("int") * 60).when(unit == "min", F.try_to_number(n, F.lit("999999")).cast("int")).otherwise(3)


def bar_clock(d: Column, seconds_after_open: Column) -> Column:
    return F.timestamp_add("SECOND", seconds_after_open, F.timestamp_add("MINUTE", F.lit(OPEN), d.cast("timestamp_ntz")))


def duration_label(seconds: Column) -> Column:
    """``30s``, ``45m``, ``2h 14m`` or ``3d 4h``, cut off, not rounded."""
    s = seconds.cast("long")
    part = lambda a, b, u, v: F.concat(F.floor(s / a).cast("string"), F.lit(f"{u} "), F.floor(F.pmod(s, F.lit(a)) / b).cast("string"), F.lit(v))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).when(s < 86400, part(3600, 60, "h", "m")).otherwise(part(86400, 3600, "d", "h"))


def quote_is_stale(age_seconds: Column) -> Column:
    """Older than five minutes; a missing age is not stale."""
    return F.coalesce(age_seconds > 300, F.lit(False))


def chain_freshness(age_minutes: Column) -> Column:
    return F.when(age_minutes < 5, "fresh").when(age_minutes < 10, "recent").when(age_minutes < 30, "stale").otherwise("old")


def holding_seconds(entry: Column, exit_: Column) -> Column:
    s = F.timestamp_diff("SECOND", entry, exit_)
    return F.when(s >= 0, s)


def dte_bucket(days: Column) -> Column:
    return F.when(days <= 7, "NEAR").when(days <= 30, "MID").otherwise("FAR")


def years_to_expiry(t: Column, expiry: Column) -> Column:
    """Calendar years from ``t`` to 10:00 of the expiry day, at least 0."""
    end = F.timestamp_add("HOUR", F.lit(10), expiry.cast("timestamp_ntz"))
    return F.greatest(F.timestamp_diff("SECOND", t, end) / F.lit(86400 * 365.25), F.lit(0.0))


def years_by_days(d: Column, expiry: Column) -> Column:
    return F.greatest(F.datediff(expiry, d) / F.lit(365.0), F.lit(0.0))


# strings


def side(kind: Column) -> Column:
    """CE and PE in any case are CALL and PUT."""
    k = F.upper(F.trim(kind))
    return F.when(k.isin("CE", "CALL"), "CALL").when(k.isin("PE", "PUT"), "PUT")


def instrument_parts(key: Column) -> Column:
    """struct<exchange, segment, token> of ``EXCH_SEG|token``; null if it has another shape."""
    p = r"^([A-Z]+)_([A-Z]+)\|(.+)$"
    return F.when(key.rlike(p), F.struct(*(F.regexp_extract(key, p, i).alias(n) for i, n in ((1, "exchange"), (2, "segment"), (3, "token")))))


def parse_tags(json: Column) -> Column:
    """The non-empty strings of a JSON array; null if malformed or blank."""
    found = F.from_json(F.nullif(F.trim(json), F.lit("")), "array<string>")
    return F.filter(found, lambda x: x.isNotNull() & ~x.isin("", "0", "false"))


def join_tags(tags: Column) -> Column:
    """A JSON array of the trimmed tags that are not blank; null if none is left."""
    kept = F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def csv_field(value: Column) -> Column:
    """Quoted if it holds a quote, a comma or a line end; quotes are doubled; null is empty."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as text, one a line."""
    return F.sha2(F.array_join(F.array(*(p.cast("string") for p in parts)), "\n", ""), 256)


# numbers


def finite(x: Column) -> Column:
    """The number if it is finite, else null; 0 is a number."""
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def tick(price: Column, size: str = "0.05") -> Column:
    """Rounded half-even to the tick; a negative price is left as it is."""
    steps = F.bround(price.cast("decimal(28,10)") / F.lit(size).cast("decimal(10,4)"), 0)
    return F.when(price < 0, price).otherwise((steps * F.lit(size).cast("decimal(10,4)")).cast("double"))


def tick_up(price: Column, size: str = "0.05") -> Column:
    """Rounded to the tick, halves towards plus infinity."""
    steps = F.floor(price.cast("decimal(28,10)") / F.lit(size).cast("decimal(10,4)") + F.lit("0.5").cast("decimal(3,1)"))
    return (steps.cast("decimal(20,0)") * F.lit(size).cast("decimal(10,4)")).cast("double")


def cash_flow_c(action: Column, price_c: Column, quantity: Column) -> Column:
    """Cents that come in: a buy pays, a sell receives."""
    return F.when(action == "buy", -price_c * quantity).otherwise(price_c * quantity)


def unrealised_c(quantity: Column, average_c: Column, mark_c: Column) -> Column:
    """Signed result of an open position; 0 if flat, null without a mark."""
    return F.when(quantity == 0, 0).otherwise((mark_c - average_c) * quantity)


def percent_change(before: Column, after: Column) -> Column:
    return F.try_divide((after - before) * 100.0, F.nullif(before, F.lit(0).cast("double")))


def normalised(d: Column, p: Column) -> Column:
    """|d| / (|p| + |d|); 0 if both are 0."""
    return F.coalesce(F.try_divide(F.abs(d).cast("double"), F.abs(p) + F.abs(d)), F.when((d == 0) & (p == 0), 0.0))


def compare(a: Column, b: Column) -> dict[str, Column]:
    """Difference, ratio, relative and normalised difference, and the larger side by size."""
    return {
        "difference": a - b,
        "ratio": F.try_divide(a.cast("double"), b.cast("double")),
        "relative": F.try_divide((a - b).cast("double"), F.abs(b).cast("double")),
        "normalised": F.try_divide((a - b).cast("double"), F.abs(a) + F.abs(b)),
        "dominant": F.when(F.abs(a) > F.abs(b), "first").when(F.abs(a) < F.abs(b), "second").otherwise("equal"),
    }


def direction(x: Column, eps: float = 1e-9) -> Column:
    return F.when(x > eps, "up").when(x < -eps, "down").when(x.isNotNull(), "flat")
