"""Series thinned to a least distance in time: which point comes next depends on the one taken before.

Points stream in order through their key's task, which holds the last one taken; no fixed window says
the same. What follows from neighbours alone, and the cap on a series, are windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def spaced(points: DataFrame, key: str, at: str, value: str, seconds: float, skip_flat: bool = False, tie: str | None = None) -> DataFrame:
    """Points at least ``seconds`` after the last one taken of their key; with ``skip_flat``, of another value than it.

    Points at the same time are in order of ``tie``, then value. Columns pass through.
    """
    kinds = points.schema
    order = [key, at, *([tie] if tie else []), value]
    ordered = points.select("*", F.unix_micros(F.col(at).cast("timestamp")).alias("_at")).repartition(key).sortWithinPartitions(*order)
    gap, names = int(seconds * 1_000_000), points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last, held = None, None, None
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, value, "_at")}
            keep = []
            for k, v, t in zip(column[key], column[value], column["_at"]):
                take = t is not None and (last is None or k != who or (t - last >= gap and not (skip_flat and v == held)))
                if take:
                    who, last, held = k, t, v
                keep.append(take)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, kinds)


def newest(points: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """The last ``most`` points of each key."""
    return points.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter(F.col("_r") <= most).drop("_r")


def cleaned(points: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Points of trading days within market hours (both ends included) that differ from the one before; what is off the market is no one's before."""
    open_now = points.filter((F.dayofweek(at).between(2, 6)) & rules.minute_of_day(F.col(at)).between(555, 930))
    before = F.lag(value).over(Window.partitionBy(key).orderBy(at, tie))
    return open_now.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")
