"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link when they differ in at most two. Cut in two halves, one half of a
linked pair differs in at most one bit. So each half is indexed under 32 variants, each with one
bit as a wildcard: linked fingerprints share a variant of a half. An equality join on variants
proposes pairs, and the bit count of their XOR verifies them.

Work is on distinct fingerprints; copies share one. A variant that many fingerprints share (a
bucket of more than ``bucket``) is not joined with itself: its members get the variants of the
other half too, with as many wildcards as are left, so that all who share both are linked, and
each links to the smallest of them only. No link between components is lost, no group of pairs
is written out.

Components come from rounds of minimum labels with shortcuts over the links.

Defined cases: null text counts as one without words, whose fingerprint is 0 and links like any
other; a text of fewer words than a shingle is one shingle; a row is placed by its text alone, so
rows with equal ids and other texts may be in several components; equal rows give equal rows; a row
without an id links the others, and its component's smallest id is null only if none of it has one;
an empty table gives none; other columns are not used and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, slices, written

_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOW = 0xFFFFFFFF
#: The most links whose labels Spark may broadcast.
BROADCAST = 300_000


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if set in over half of the shingles' hashes."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    k, h = words_per_shingle, xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), max(1, len(words) - k + 1)
    for at in range(0, n, 8192):  # in blocks, so that a very long text takes little memory
        hashes = [h(" ".join(words[i : i + k]), seed) for i in range(at, min(n, at + 8192))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fp long")


def _half(fp: Column, half: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if half else fp).bitwiseAND(F.lit(LOW))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(nodes: DataFrame) -> DataFrame:
    """fp, key: 32 variants of each half, a wildcard at each bit in turn."""
    keys = [
        _half(F.col("fp"), half).bitwiseAND(F.lit(LOW & ~(1 << bit))) + F.lit((half * 32 + bit) << 32)
        for half in (0, 1)
        for bit in range(32)
    ]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _stars(members: DataFrame, *keys: str) -> DataFrame:
    """Links from each member of a group to the group's smallest."""
    low = members.groupBy(*keys).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(low.hint("merge"), list(keys)).select("a", F.col("fp").alias("b")).filter("a <> b")


def links(nodes: DataFrame, bucket: int = 32) -> DataFrame:
    """a, b: links between distinct fingerprints ``fp`` that keep their components whole.

    Spark takes an exploded table for as small as the table before it, and would broadcast millions of
    variants through the driver; so joins of variants are hinted to be merge joins.
    """
    index = _variants(nodes)
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(index.join(counts.hint("merge"), "key"), "variants")
    few = shared.filter(F.col("n") <= bucket).select("key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b").hint("merge"), "key")
        .filter((F.col("a") < F.col("b")) & (_distance("a", "b") <= 2))
        .select("a", "b")
        .distinct()
    )
    # Members of a full bucket agree in 31 bits of a half. Either they agree in its wildcard bit, and
    # may differ in two bits of the other half, or they differ in it, and may in one of the other.
    many = shared.filter(F.col("n") > bucket).select("key", "fp")
    upper = F.shiftright("key", 32) >= 32
    own = F.when(upper, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    other = F.when(upper, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1))
    # every key has the bits of the half without its wildcard: what is left over is the wildcard's bit
    wildcard = F.when(own == F.col("key").bitwiseAND(F.lit(LOW)), 0).otherwise(1)
    masks = [(LOW & ~(1 << i) & ~(1 << j), 0) for i, j in combinations(range(32), 2)] + [(LOW & ~(1 << i), 1) for i in range(32)]
    table = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(w).alias("any")) for m, w in masks])
    finer = many.select("key", "fp", other.alias("other"), wildcard.alias("bit"), F.posexplode(table).alias("i", "m")).select(
        "key", "fp", "i", F.col("other").bitwiseAND(F.col("m.mask")).alias("rest"), F.when(F.col("m.any") == 1, F.lit(2)).otherwise(F.col("bit")).alias("bit")
    )
    return pairs.unionByName(_stars(finer, "key", "i", "rest", "bit").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label: the smallest node reachable over ``edges`` (a, b), for nodes that have one.

    Each round rewires every edge to the smallest label around it (large and small stars); edges
    become stars around the smallest node in a number of rounds that grows with the logarithm of
    a component's size. Every round is a table in the shared folder.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        size = edges.count()
        # a file of labels may take many times its size in memory, so a large one is not left to be broadcast
        held = lambda low: low.hint("merge") if size > BROADCAST else low  # noqa: E731, B023
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(held(low), "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = (
            large.select(F.col("b").alias("u"), F.col("a").alias("v"))
            .join(held(low), "u")
            .select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
            .filter("a <> b")
            .distinct()
        )
        new = written(small, "edges")
        same = new.count() == size and new.exceptAll(edges).isEmpty()
        discard(edges)
        edges = new
        if same:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    raise RuntimeError(f"no end after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: one row a document, the smallest doc_id of its component."""
    prints = written(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = components(links(nodes.select("fp")))
    found = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    found = written(found, "labels")
    lowest = found.groupBy("label").agg(F.min("low").alias("component_id"))
    return prints.join(found.join(lowest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
