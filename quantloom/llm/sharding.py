"""Rendezvous sharding: every record goes to the shard that scores highest for its key.

The score of key k on shard s is -w_s / ln(u(k, s)) with u a hash in (0, 1), so shard s wins a
share w_s / sum(w) of the keys, and a further shard takes records only into itself.

Defined cases: a null key is a key like any other; equal keys share a shard; rows with equal keys
get different slots, ordered by ``order_by``; an empty table stays empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name


def _uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1): the upper 52 bits of a 64-bit hash, plus a half."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / F.lit(float(2**52))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, of ``key``; a weight of 0 takes nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard with a weight above 0 is needed")
    scored = [F.struct((-F.lit(float(w)) / F.ln(_uniform(key, s))).alias("score"), F.lit(-s).alias("s")) for s, w in enumerate(weights) if w > 0]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["s"]).cast("int")


def assign_slots(df: DataFrame, shard: str, key: str, order_by: Sequence[Column] = (), parts: int = 1024, name: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is split by the hash of the key into ``parts`` parts. Rows are numbered within a part,
    and the count of the parts before is added, so no task holds a whole shard. The table of counts
    has at most shards x parts rows whatever the input, hence the broadcast.
    """
    part, n, before, at = free_name(df, "part", "n", "before", name)
    if at != name:
        raise ValueError(f"{name} is taken")
    df = df.withColumn(part, F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(parts)).cast("int"))
    counts = df.groupBy(shard, part).agg(F.count(F.lit(1)).alias(n))
    ahead = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, part, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(shard, part).orderBy(F.col(key), *order_by)) - 1
    return (
        df.withColumn(name, local)
        .join(F.broadcast(offsets), [shard, part])
        .withColumn(name, (F.col(name) + F.col(before)).cast("long"))
        .drop(part, before)
    )
