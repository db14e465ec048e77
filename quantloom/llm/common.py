"""Helpers shared by the corpus operators: input tables, the shared folder, names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The word pattern of the corpus operators: runs without space, tab, line or page breaks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors are one process, may lack the setting;
    it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="quantloom-")
    return _own[context.applicationId]


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, name: str, **options: str) -> DataFrame:
    """``df`` as a table of ``written`` in buckets of ``key``: joins on it shuffle their other side only.

    A retried task must find the same rows again, so ``df`` should read files.
    """
    spark = df.sparkSession
    name, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").options(path=f"{shared_dir(spark)}/{name}", **options).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files are in the shared folder
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what a task makes of a batch is never all in memory at once.

    Large buffers go back to the system when they are freed, not to a pool of the worker.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()  # the worker now waits for its next task


def give_back() -> None:
    """Free memory of this process goes back to the system, where the C library can do that."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def without(names: list[str], *replaced: str | None) -> list[str]:
    """The names but those that a new column replaces, in any case of letters, as Spark finds columns."""
    gone = {r.lower() for r in replaced if r}
    return [n for n in names if n.lower() not in gone]


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that ``df`` does not have, so caller columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
