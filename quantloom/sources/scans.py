"""Scans of stored tables: filters that reach the files, order, pages, and what belongs to a page's rows.

Filters compare plain columns with values, so Parquet row groups are skipped by them and only the
asked columns are read. A page is the feature: its rows are chosen by a distributed top-n, and what is
attached to them is looked up for those rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(
    table: DataFrame, equal: Mapping[str, Any] | None = None, time_col: str | None = None, since: Any = None, until: Any = None, columns: Sequence[str] | None = None,
    order: Sequence[str] = (), newest_first: bool = False, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Rows whose columns equal the values given (None: any), in a time range with both ends, in order of time and ``order``.

    A limit below 1 is 1. With a limit, equal places in the order are settled by ``order``, so give columns that tell rows apart.
    """
    kept = F.lit(True)
    for c, v in (equal or {}).items():
        if v is not None:
            kept = kept & (F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == F.lit(v))
    if since is not None:
        kept = kept & (F.col(time_col) >= F.lit(since))
    if until is not None:
        kept = kept & (F.col(time_col) <= F.lit(until))
    out = table.filter(kept)
    if columns:
        out = out.select(*columns)
    if limit is not None:
        way: list[Column] = [(F.desc if newest_first else F.asc)(c) for c in ([time_col] if time_col else []) + list(order)]
        out = out.orderBy(*way).offset(max(0, offset)).limit(max(1, limit))
    return out


def distinct_values(table: DataFrame, column: str, **equal: Any) -> DataFrame:
    """The values of a column that is not null, once each."""
    return scan(table, equal, columns=[column]).filter(F.col(column).isNotNull()).distinct()


def attach(page: DataFrame, many: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """``page`` with an array of what ``many`` has for each of its rows, in order; empty where it has nothing.

    Only what belongs to the page is gathered, so its arrays are as long as one row's children.
    """
    own = many.join(page.select(key).distinct(), key, "left_semi")
    found = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return page.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
