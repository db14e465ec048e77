"""Sinks that may be written twice: keyed upserts, appends of checked rows, and a log of what was done.

A table is a folder of Parquet files, partitioned by one column. An upsert reads only the partitions
that its rows touch, and overwrites only those: Spark stages them and moves them in when the job is
done, so a failed run leaves the table as it was. A second writer meets the first one's lock.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What a run logs; one row an operation.
LOG = "run_id string, operation string, status string, rows_fetched long, rows_inserted long, rows_updated long, rows_unchanged long, rows_rejected long, error string, completed_at timestamp"
_COUNTS = ("inserted", "updated", "unchanged")


class Busy(RuntimeError):
    """Another run is writing the table."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds the table; creating the lock either works or does not, whoever else tries."""
    at, fs = _path(spark, f"{path.rstrip('/')}.lock")
    try:
        made = fs.createNewFile(at)
    except Exception as e:  # some stores raise where others answer
        raise Busy(path) from e
    if not made:
        raise Busy(path)
    try:
        yield
    finally:
        fs.delete(at, False)


def log(spark: SparkSession, path: str, run_id: str, operation: str, status: str, error: str | None = None, **counts: int) -> None:
    """Append a row to a log of ``LOG``."""
    row = (run_id, operation, status, *(counts.get(c, 0) for c in ("fetched", *_COUNTS, "rejected")), error)
    schema = LOG.rsplit(", ", 1)[0]
    spark.createDataFrame([row], schema).withColumn("completed_at", F.current_timestamp()).write.mode("append").parquet(path)


def _last_written(rows: DataFrame, keys: Sequence[str], partition: str, values: Sequence[str], arrival: str) -> DataFrame:
    """One row a key: the one that came last. Of those that came together, the largest values."""
    last = F.max(F.struct(arrival, *values)).alias("new")
    return rows.groupBy(*keys, partition).agg(last)


def upsert(table: str, rows: DataFrame, keys: Sequence[str], partition: str, values: Sequence[str], arrival: str, log_to: str | None = None, operation: str = "upsert", run_id: str | None = None) -> dict[str, int]:
    """Rows into ``table`` by ``keys``: new ones inserted, known ones replaced if a value differs.

    ``partition`` follows from the key. Rows whose key or partition holds a null are rejected and
    counted, as are failures of the whole; returns the counts that are logged.
    """
    spark, run = rows.sparkSession, run_id or uuid.uuid4().hex
    named = F.lit(True)
    for c in (*keys, partition):
        named = named & F.col(c).isNotNull()
    fetched = Observation()
    seen = rows.withColumn("_named", named).observe(fetched, F.count(F.lit(1)).alias("fetched"), F.count_if(~F.col("_named")).alias("rejected"))
    new = _last_written(seen.filter("_named"), keys, partition, values, arrival)
    on = [*keys, partition]
    try:
        with locked(spark, table):
            kinds = rows.select(*keys, *values, partition).schema
            if exists(spark, table):
                touched = rows.filter(named).select(partition).distinct()
                old = spark.read.schema(kinds).parquet(table).join(touched, partition, "left_semi")
            else:
                old = spark.createDataFrame([], kinds)
            both = new.join(old.select(*on, F.struct(*values).alias("old")), on, "full")
            mine = F.struct(*(F.col(f"new.{v}").alias(v) for v in values))
            action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(mine == F.col("old"), "unchanged").otherwise("updated")
            both = both.withColumn("action", action)
            done = Observation()
            both = both.observe(done, *(F.count_if(F.col("action") == a).alias(a) for a in _COUNTS))
            row = F.when(F.col("new").isNull(), F.col("old")).otherwise(mine)
            out = both.withColumn("row", row).select(*keys, *(F.col(f"row.{v}").alias(v) for v in values), partition)
            # small partitions share a task, a large one gets several
            out.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
    except Exception as e:
        if log_to:
            log(spark, log_to, run, operation, "FAILED", type(e).__name__)
        raise
    counts = {**fetched.get, **done.get}
    if log_to:
        log(spark, log_to, run, operation, "PARTIAL" if counts["rejected"] else "SUCCESS", **counts)
    return counts


def valid_observations(rows: DataFrame) -> DataFrame:
    """Volatility observations worth keeping, in their stored form.

    ``iv`` is above 0, the symbol (trimmed, in capitals) and the expiry are not empty, the type is call or
    put in any case, and the strike is a number; a spot that is no number is null, a source is cut to 32
    characters, and an observation without a time is of now.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    x = rows.select(
        F.upper(F.trim("symbol")).alias("symbol"), F.nullif(F.col("expiry").cast("string"), F.lit("")).alias("expiry"), number("strike").alias("strike"), F.lower("option_type").alias("option_type"), number("iv").alias("iv"), number("spot").alias("spot"),
        F.coalesce(F.nullif(F.substring("source", 1, 32), F.lit("")), F.lit("chain")).alias("source"), F.coalesce("observed_at", F.current_timestamp().cast(rows.schema["observed_at"].dataType)).alias("observed_at"),
    )
    return x.filter((F.col("iv") > 0) & (F.col("symbol") != "") & F.col("expiry").isNotNull() & F.col("option_type").isin("call", "put") & F.col("strike").isNotNull())


def append_observations(table: str, rows: DataFrame, log_to: str | None = None, run_id: str | None = None) -> dict[str, int]:
    """Valid observations appended; how many came, were stored and were rejected."""
    came, stored = Observation(), Observation()
    good = valid_observations(rows.observe(came, F.count(F.lit(1)).alias("fetched"))).observe(stored, F.count(F.lit(1)).alias("inserted"))
    good.write.mode("append").parquet(table)
    counts = {**came.get, **stored.get}
    counts["rejected"] = counts["fetched"] - counts["inserted"]
    if log_to:
        log(rows.sparkSession, log_to, run_id or uuid.uuid4().hex, "iv_observations", "SUCCESS", **counts)
    return counts


def action_counts(log_table: DataFrame, *by: str) -> DataFrame:
    """The log summed by its run and operation."""
    return log_table.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), *(F.sum(f"rows_{c}").alias(c) for c in ("fetched", *_COUNTS, "rejected")))


def month_of(day: Column) -> Column:
    """A partition by month, as text."""
    return F.date_format(day, "yyyy-MM")
