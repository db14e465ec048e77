"""Line dedup by site-relative frequency.

The share of a line at a host is the number of the host's pages with that line, over the host's
pages. Lines on more than ``ratio`` of the pages are boilerplate there and go from every page of the
host; a line on one page only repeats nothing and stays, however few pages the host has.

Lines are compared without spaces around them; blank lines always stay and count as nothing.
Defined cases: null text stays null (the page counts); a null host is no site, so its pages stay as
they are; a line repeated within a page counts once; every row is a page, equal rows too; a page
may end up as an empty text; an empty table stays empty; other columns pass through,
but for one named ``dropped_col``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, without, written

#: Boilerplate line keys (16 bytes each, plus one row per host) that may be broadcast.
BROADCAST_KEYS = 200_000
#: Parts over which a host's pages are dealt when the keys are too many for a broadcast.
SALTS = 64


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def boilerplate_keys(pages: DataFrame, host: Column, text: Column, ratio: float) -> DataFrame:
    """host, keys: the boilerplate lines of each host that has any.

    A host has at most (its mean lines per page) / ratio of them, so the array is bounded by the
    pages' length and not by their number.
    """
    on_host = pages.filter(host.isNotNull())
    totals = on_host.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _key))
    counts = (
        on_host.select(host.alias("host"), F.explode(keys).alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return (
        counts.join(totals, "host")
        .filter(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("key").alias("keys"))
    )


def drop_boilerplate_lines(
    pages: DataFrame,
    host: Column,
    text_col: str = "text",
    ratio: float = 0.05,
    broadcast_keys: int = BROADCAST_KEYS,
    dropped_col: str | None = "n_dropped",
) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text_col``, plus the number of lines that went (``dropped_col``; None: no such column)."""
    found = written(boilerplate_keys(pages, host, F.col(text_col), ratio), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("keys") + 8), F.lit(0)).alias("n")).first()["n"]
    at, keys, salt, lines, kept = free_name(pages, "host_", "keys_", "salt_", "lines_", "kept_")
    found = found.select(F.col("host").alias(at), F.col("keys").alias(keys))
    if size <= broadcast_keys:
        joined = pages.join(F.broadcast(found), host == F.col(at), "left")
    else:
        spread = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pages.withColumn(f"{salt}p", F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = dealt.join(spread, (host == F.col(at)) & (F.col(f"{salt}p") == F.col(salt)), "left").drop(salt, f"{salt}p")
    has = F.col(keys).isNotNull() & F.col(text_col).isNotNull()
    (gone,) = free_name(joined, "gone_")
    cleaned = (
        joined.withColumn(lines, F.when(has, F.split(text_col, "\n")))
        .withColumn(kept, F.filter(lines, lambda x: ~((F.trim(x) != "") & F.array_contains(F.col(keys), _key(x)))))
        .withColumn(gone, F.when(has, F.size(lines) - F.size(kept)).otherwise(0).cast("long"))
        .withColumn(text_col, F.when(F.col(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    )
    added = [F.col(gone).alias(dropped_col)] if dropped_col else []
    return cleaned.select(*without(pages.columns, dropped_col), *added)
