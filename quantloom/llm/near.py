"""Near copies by Jaccard similarity of word shingles: deletion variants of MinHash segments.

A text's fingerprint is 40 minimum values of its shingles' hashes, in 8 segments of 5. Each segment
is indexed under 5 variants, each with one value deleted, and an equality join on variants proposes
pairs. At a similarity of 0.8 two texts share a variant of a segment with probability 0.74 and of
any segment with 0.99998; at more, with more. A 64-bit SimHash cannot do this: at 0.8 its bits
differ in about 10 places, where segments short enough to agree no longer tell texts apart.

Every proposed pair is verified: the exact similarity of the whole shingle sets decides.

Work is on distinct shingle sets; exact copies share one. What is asked is components, so the join on
variants is not written out in full: each member of a variant's group is held against the group's
centre (the member that shares most), and the links found give each set a label. Then, in every group
that holds several labels, each member without the group's commonest label is held against every
member of another label. A pair that shares a variant is thus compared unless its two sets are linked
already, so components are those of all such pairs, whatever the size of a group. Groups of more than
``FEW`` are compared in blocks inside the tasks, which return links only; no pairs of theirs are written
out. The time for a group of texts that share a variant and are not linked grows with its square.

All texts are shuffled once, into buckets of their row's number. Both rounds of verifying and the choice
of the rows that stay join on that number: numbers travel to the texts, and of these only the ones that are
compared move again.

Defined cases: a null text is one without words, and such texts are copies of each other; a text of
fewer words than a shingle is one shingle; rows without an id, or with a repeated one, are rows like
any other; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, placed, slices, written
from .simhash import _LOWER, _WORD, components

SEGMENTS, VALUES = 8, 5
_SEEDS = np.random.default_rng(42).integers(1, 2**63, (2, SEGMENTS * VALUES), np.uint64)
#: The most members of a group whose pairs are written out, and the members of a block of a larger one.
FEW, BLOCK = 32, 400
_NODES = "row long, digest binary, n long, keys array<long>"


def shingles(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = _WORD.findall((text or "").translate(_LOWER))
    k, h = words_per_shingle, xxhash.xxh64_intdigest
    return np.unique(np.array([h(" ".join(words[i : i + k])) for i in range(max(1, len(words) - k + 1))] if words else [], np.uint64))


def variants(hashes: np.ndarray) -> np.ndarray:
    """40 keys of a set: of each segment of minimum values, 5 with one value deleted."""
    least = np.full(SEGMENTS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):  # in blocks, so that a very long text takes little memory
        mixed = (hashes[at : at + 4096, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    out = [xxhash.xxh64_intdigest(np.delete(s, i).tobytes(), g * VALUES + i) for g, s in enumerate(least.reshape(SEGMENTS, VALUES)) for i in range(VALUES)]
    return np.array(out, np.uint64).view(np.int64)


def _similar(pairs: DataFrame, texts: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame:
    """The pairs a, b of nodes whose whole texts are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda text: shingles(text, words_per_shingle))
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = known(left), known(right)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b").select("a", "b", "left", "right")
    return wide.mapInArrow(run, "a long, b long")


def _near(an: Column, bn: Column, similarity: float) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(an, bn) >= F.lit(similarity) * F.greatest(an, bn) - 1e-9


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def groups(nodes: DataFrame) -> DataFrame:
    """key, node, n, centre, cn: the members of each variant that several sets of ``node, n, keys`` share."""
    index = nodes.select("node", "n", F.explode("keys").alias("key"))
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(index.join(counts.hint("merge"), "key"), "variants")
    weighed = shared.join(shared.groupBy("node").agg(F.sum("size").alias("weight")), "node")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("c"))
    return shared.join(centres, "key").select("key", "node", "n", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"))


def stars(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: each member of a group and its centre."""
    return members.filter((F.col("node") != F.col("centre")) & _near(F.col("n"), F.col("cn"), similarity)).select(*_ordered("node", "centre")).distinct()


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members but the centres, with label, commonest label and number, of the groups in which these have several labels."""
    member = members.filter("node <> centre").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    sizes = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("size").alias("size")).filter("labels > 1")
    return member.join(main.select("key", "main", "size"), "key")


def across(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs within a group of ``mixed`` whose labels differ."""
    few = members.filter("label <> main").select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"))
    every = members.select("key", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"), "main")
    # two without the commonest label meet twice, of which once counts
    once = (F.col("bl") == F.col("main")) | (F.col("a") < F.col("b"))
    return few.join(every, (few["key"] == every["key"]) & (F.col("al") != F.col("bl")) & once & _near(F.col("an"), F.col("bn"), similarity)).select(*_ordered("a", "b")).distinct()


def blocks(members: DataFrame, texts: DataFrame, words_per_shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b: links that join the labels within the groups of ``mixed``, every two blocks of a group in a call of their own."""

    def run(group: pa.Table) -> pa.Table:
        nodes, own, labels = (group.column(c).to_numpy().copy() for c in ("node", "own", "label"))
        sets = [shingles(t, words_per_shingle) for t in group.column("text").to_pylist()]
        n, found = np.array([len(s) for s in sets]), []
        left, right = (np.flatnonzero(own == group.column(c)[0].as_py()) for c in ("i", "j"))
        # which sets of the right block hold a shingle
        known, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(sets[r] for r in right)]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        holders, begins = np.repeat(np.arange(len(right)), n[right])[order], np.searchsorted(at[order], np.arange(len(known) + 1))
        for a in left:
            place = np.flatnonzero(np.isin(known, sets[a], assume_unique=True))
            both = np.bincount(np.concatenate([np.zeros(0, np.int64), *(holders[begins[p] : begins[p + 1]] for p in place)]), minlength=len(right))
            for b in right[both >= similarity * (n[a] + n[right] - both) - 1e-9]:
                if labels[a] != labels[b]:
                    found.append((nodes[a], nodes[b]))
                    labels[labels == labels[b]] = labels[a]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    parts = F.ceil(F.col("size") / block).cast("int")
    placed = members.select("key", "node", "label", F.pmod(F.xxhash64("node"), parts).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    placed = placed.select("key", "node", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return placed.join(texts.toDF("node", "text"), "node").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id, null ids last."""
    (row,) = free_name(docs, "row_")
    raw = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows", compression="zstd")
    rows = placed(raw, row, "rows", compression="zstd")
    discard(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words_per_shingle) for t in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([variants(s) for s in sets], pa.list_(pa.int64()))],
                ["row", "digest", "n", "keys"],
            )

    prints = rows.select(row, text_col).mapInArrow(run, _NODES)
    # rows in order: ids with nulls last, then the text, then the number of the row
    order = rows.select(F.col(row).alias("row"), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col(row).alias("row")).alias("low"))
    nodes = prints.join(order, "row").groupBy("digest").agg(F.min("row").alias("node"), F.min("low").alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(nodes.select("node", "low", "n", "keys"), "nodes")
    members = written(groups(nodes.filter("n > 0").select("node", "n", "keys")), "groups")
    texts = rows.select(F.col(row).alias("node"), F.col(text_col).alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted_texts = written(texts.join(wanted, "node"), "texts")
        found = written(_similar(pairs, wanted_texts, words_per_shingle, similarity), "similar")
        discard(wanted_texts)
        return found

    first = written(stars(members, similarity), "pairs")
    links = verified(first)
    rest = written(mixed(members, components(links)), "mixed")
    full = rest.filter(F.col("size") > FEW)
    second = written(across(rest.filter(F.col("size") <= FEW), similarity).join(first, ["a", "b"], "left_anti"), "pairs")
    full_texts = written(texts.join(full.select("node").distinct(), "node"), "texts")
    joined = written(blocks(full, full_texts, words_per_shingle, similarity), "similar")
    labels = components(links.union(verified(second)).union(joined))
    for used in (members, first, rest, second, full_texts, joined):
        discard(used)
    kept = nodes.select("node", "low").join(labels, "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min("low").alias("low")).select(F.col("low.row").alias(row))
    kept = written(kept, "kept")
    for used in (nodes, labels):
        discard(used)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
