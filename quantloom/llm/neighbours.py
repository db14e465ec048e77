"""Near-duplicate embeddings by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Equal vectors (of equal direction) are one node. Dense groups are gathered into balls: on ever finer
   cells of random hyperplanes, each member of a crowded cell is held against a few leaders of it and
   joins the nearest within half of the threshold's angle. Members of a ball link to each other by the
   triangle inequality, so a ball's links are known by its size and never listed. Leaders and nodes in
   no ball stay as points of the graph; a ball has a radius.
2. The graph starts from the leaves of a forest of random hyperplanes. In each round every point brings
   its neighbours together, both those it lists and those that list it; of each two of which one is
   new, the better replaces the worse on their lists. A list whose last entry may still link is
   saturated and doubles until it is not. Rounds end when one finds no further pair that may link.
3. An audit compares ``audit`` points (those with the least hashes) with all points and measures the
   recall of pairs that may link. Below ``recall`` the graph gets a new forest and more rounds; after
   ``forests`` of them all points are compared with all, in blocks.
4. Points whose angle is in reach of the threshold and both radii are settled: by the radii where these
   decide, else their balls' vectors are compared in blocks, in double precision. Only counts and
   whether two balls link come out; no group of pairs is written.

Nothing is collected but the audited points. Cosine is the product of the vectors scaled to length one.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, links
with nothing; vectors of different length do not link; rows with equal ids are vectors of their own;
a row without id counts as a neighbour and has a component, which takes the smallest id that is not
null; an empty table gives none; further columns are not used and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, written
from .simhash import components

#: What angles may be off by where points are compared in single precision.
SLACK = 5e-3
_LINK = "a long, b long, sim double, over boolean"


def unit(vector: list | np.ndarray | None) -> np.ndarray | None:
    """The vector at length one, in double precision; None if it has no direction."""
    if vector is None or len(vector) == 0:
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))  # an exact scaling, so that no square overflows
    return v / math.sqrt(v @ v) + 0.0


def _batch(columns: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], list(schema))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048):
        units = [unit(v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([None if u is None else xxhash.xxh3_128_digest(u.tobytes()) for u in units], pa.binary()),
                pa.array([None if u is None else u.tobytes() for u in units], pa.binary()),
                pa.array([None if u is None else u.astype(np.float32).tobytes() for u in units], pa.binary()),
            ],
            ["vec_id", "digest", "unit", "vec"],
        )


def _matrix(vectors: list[bytes], kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)


def _cells(trees: list[int], bits: int):
    """A task that adds ``keys``: a vector's cell of each tree, by its sides of ``bits`` hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            size = np.array([len(v) for v in vectors])
            keys = np.zeros((len(vectors), len(trees)), np.int64)
            for length in np.unique(size):
                x = _matrix([vectors[i] for i in np.flatnonzero(size == length)])
                for at, tree in enumerate(trees):
                    if (length, tree) not in planes:
                        planes[length, tree] = np.random.default_rng([tree, bits]).standard_normal((x.shape[1], bits)).astype(np.float32)
                    sides = (x @ planes[length, tree] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0
                    keys[size == length, at] = sides + (tree << 32) + (x.shape[1] << 44)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return run


def _in_cells(points: DataFrame, trees: list[int], bits: int) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(_cells(trees, bits), f"{kinds}, keys array<long>")


def _joins(tight: float):
    """A task that finds the leader of each row's cell whose ball it joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors, keys = (np.array(batch.column(i).to_pylist(), object) for i in range(3))
            found: dict[str, list] = {"node": [], "leader": [], "sim": []}
            first: dict[int, int] = {}
            for i, key in enumerate(keys):
                first.setdefault(key, i)
            for key, i in first.items():
                leaders = batch.column(3)[i].as_py()
                all_of = _matrix([x["vec"] for x in leaders])
                kept: list[int] = []  # a leader within another's ball gives way, unless it has one of its own
                for j, x in enumerate(leaders):
                    if x["leads"] or not kept or (all_of[kept] @ all_of[j]).max() < tight:
                        kept.append(j)
                rows = np.flatnonzero(keys == key)
                sims = _matrix(list(vectors[rows])) @ all_of[kept].T
                own = nodes[rows][:, None] == np.array([leaders[j]["node"] for j in kept])[None]
                best = sims.argmax(axis=1)
                near = (sims.max(axis=1) >= tight) & ~own.any(axis=1)
                found["node"] += list(nodes[rows[near]])
                found["leader"] += [leaders[kept[b]]["node"] for b in best[near]]
                found["sim"] += list(sims.max(axis=1)[near].astype(float))
            yield _batch(found, {"node": pa.int64(), "leader": pa.int64(), "sim": pa.float64()})

    return run


def _levels(points: int, leaf: int) -> list[int]:
    most = max(0, math.ceil(math.log2(max(points, 1) / leaf)))
    return [*range(0, most, 3), most]


def balls(nodes: DataFrame, similarity: float, points: int, leaf: int, leaders: int = 6, bound: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Of ``node, vec``: the points that stay (node, vec) and who joined whom (node, leader, sim)."""
    tight = math.cos(math.acos(similarity) / 2) + 1e-5
    longest, lengths = nodes.select(F.length("vec").alias("n")).agg(F.max("n"), F.count_distinct("n")).first()
    pool, joined = nodes.select("node", "vec", F.lit(False).alias("leads")), []
    for level, bits in enumerate(_levels(points, leaf)):
        cells = written(_in_cells(pool, [level], bits).select("node", "vec", "leads", F.col("keys")[0].alias("key")), "cells")
        lots = [F.min(F.struct((~F.col("leads")).alias("late"), F.xxhash64(F.lit(level * leaders + i), "node").alias("lot"), "node")) for i in range(leaders)]
        crowded = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.transform(F.array(*lots), lambda x: x["node"])).alias("chosen")).filter(F.col("n") > leaf)
        chosen = crowded.select(F.explode("chosen").alias("node")).join(cells, "node")
        chosen = written(chosen.groupBy("key").agg(F.collect_list(F.struct("node", "vec", "leads")).alias("leaders")), "leaders")
        # so many cells at most, with so many leaders of known length: a proven bound
        small = (1 << bits) * lengths * leaders * (longest or 0) <= bound
        found = cells.filter("not leads").join(F.broadcast(chosen) if small else chosen, "key").select("node", "vec", "key", "leaders")
        found = written(found.mapInArrow(_joins(tight), "node long, leader long, sim double"), "joined")
        joined.append(found)
        led = found.select(F.col("leader").alias("node")).distinct().withColumn("led", F.lit(True))
        rest = cells.join(found.select("node"), "node", "left_anti").join(led, "node", "left")
        pool = written(rest.select("node", "vec", (F.col("leads") | F.col("led").isNotNull()).alias("leads")), "pool")
        discard(cells)
        discard(chosen)
    return pool.select("node", "vec"), reduce(DataFrame.union, joined)


def _reach(sims: np.ndarray, radii: np.ndarray, others: np.ndarray, angle: float) -> np.ndarray:
    """Which similarities are in reach: balls of these radii may hold vectors that link."""
    return np.arccos(np.clip(sims, -1, 1)) <= angle + radii[:, None] + others[None] + SLACK


def _meet(angle: float, most: int | None):
    """A task over groups of points that compares all of a group; of each it gives those in reach and the ``most`` nearest, or those better than its worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"a": pa.int64(), "b": pa.int64(), "sim": pa.float64(), "over": pa.bool_()}
        for batch in slices(batches, 256):
            out: dict[str, list] = {k: [] for k in kinds}
            for group in batch.column(0):
                g = group.values
                x = _matrix(g.field("vec").to_pylist())
                nodes, radii, worst, new = (g.field(k).to_numpy(zero_copy_only=False) for k in ("node", "radius", "worst", "new"))
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                over = _reach(sims, radii, radii, angle)
                np.fill_diagonal(over, False)
                if most is None:
                    want = (over | (sims > worst[:, None])) & (new[:, None] | new[None])
                    np.fill_diagonal(want, False)
                else:
                    want = over.copy()
                    near = np.argsort(-sims, axis=1)[:, : min(most, len(nodes) - 1)]
                    np.put_along_axis(want, near, True, axis=1)
                i, j = np.nonzero(want)
                for k, v in (("a", nodes[i]), ("b", nodes[j]), ("sim", sims[i, j].astype(np.float64)), ("over", over[i, j])):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], kinds[k]) for k, v in out.items()], list(kinds))

    return run


_MEMBER = ("node", "vec", "radius", "worst", "new")


def _forest(points: DataFrame, trees: list[int], bits: int, angle: float, most: int, block: int) -> DataFrame:
    """Links (``_LINK``) among the points of each leaf of new trees; a leaf of many points is compared in blocks."""
    keyed = written(_in_cells(points, trees, bits).select("node", "vec", "radius", F.explode("keys").alias("key")), "leaves")
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    parts = F.pmod(F.xxhash64("key", "node"), F.coalesce(F.ceil(F.col("n") / block), F.lit(1)))
    members = keyed.join(full, "key", "left").select("key", parts.alias("part"), F.struct("node", "vec", "radius", F.lit(-2.0).alias("worst"), F.lit(True).alias("new")).alias("m"))
    groups = members.groupBy("key", "part").agg(F.collect_list("m").alias("g")).filter(F.size("g") > 1).select("g")
    return groups.mapInArrow(_meet(angle, most), _LINK)


def _lists(links: DataFrame, k: int) -> DataFrame:
    """The best links of each point. A list has ``k`` entries, or twice as many as often as all of them are in reach."""
    one = links.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("over").alias("over"), F.min("new").alias("new"))
    every = Window.partitionBy("a")
    over = F.sum(F.col("over").cast("long")).over(every)
    limit = F.lit(k) * F.pow(F.lit(2), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(over, F.lit(1)) / k)) + 1))
    rank = F.row_number().over(every.orderBy(F.desc("over"), F.desc("sim"), "b"))
    return one.select("*", rank.alias("rank"), limit.alias("limit")).filter("rank <= limit").drop("rank", "limit")


def _descend(points: DataFrame, lists: DataFrame, turn: int, angle: float, k: int, block: int) -> DataFrame:
    """One round: the neighbours of each point meet, and what they find goes on their lists."""
    worst = lists.groupBy(F.col("a").alias("node")).agg(F.min("sim").alias("worst"))
    who = points.join(worst, "node", "left").select("node", "vec", "radius", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    both = lists.select("a", "b", "new").union(lists.select("b", "a", "new")).toDF("centre", "node", "new").groupBy("centre", "node").agg(F.max("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("centre").orderBy(F.xxhash64(F.lit(turn), "node")))
    seats = both.select("centre", "node", "new", F.floor((place - 1) / block).alias("part"))
    members = seats.join(who, "node").select("centre", "part", F.struct(*_MEMBER).alias("m"))
    groups = members.groupBy("centre", "part").agg(F.collect_list("m").alias("g")).filter(F.exists("g", lambda m: m["new"]) & (F.size("g") > 1)).select("g")
    found = groups.mapInArrow(_meet(angle, None), _LINK).withColumn("new", F.lit(True))
    return _lists(lists.withColumn("new", F.lit(False)).unionByName(found), k)


def _held_against(sample: list, angle: float):
    """A task that gives the points in reach of the sampled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list] = {}
        for row in sample:
            by_length.setdefault(len(row[1]), []).append(row)
        for batch in slices(batches, 1024):
            nodes, vectors, radii = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for length, some in by_length.items():
                mine = [i for i, v in enumerate(vectors) if len(v) == length]
                if not mine:
                    continue
                sims = _matrix([s[1] for s in some]) @ _matrix([vectors[i] for i in mine]).T
                over = _reach(sims, np.array([s[2] for s in some]), np.array([radii[i] for i in mine]), angle)
                rows += [(some[i][0], nodes[mine[j]], float(sims[i, j]), True) for i, j in zip(*np.nonzero(over)) if some[i][0] != nodes[mine[j]]]
            a, b, sim, over = zip(*rows) if rows else ((),) * 4
            yield _batch({"a": a, "b": b, "sim": sim, "over": over}, {"a": pa.int64(), "b": pa.int64(), "sim": pa.float64(), "over": pa.bool_()})

    return run


def _all_in_reach(points: DataFrame, angle: float, number: int, block: int = 1024) -> DataFrame:
    """Every link in reach, found by comparing all points with all, a block of them with a block."""
    parts = max(1, -(-number // block))
    packed = points.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")).groupBy(F.length("vec").alias("length"), "part").agg(F.collect_list(F.struct("node", "vec", "radius")).alias("g"))
    left = packed.select("length", F.explode(F.sequence("part", F.lit(parts - 1))).alias("q"), F.col("g").alias("x"))
    right = packed.select("length", F.col("part").alias("q"), F.col("g").alias("y"))
    pairs = left.join(right, ["length", "q"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x, y = batch.column(0)[0].values, batch.column(1)[0].values
            nodes = [g.field("node").to_numpy() for g in (x, y)]
            radii = [g.field("radius").to_numpy() for g in (x, y)]
            sims = _matrix(x.field("vec").to_pylist()) @ _matrix(y.field("vec").to_pylist()).T
            over = _reach(sims, *radii, angle) & (nodes[0][:, None] != nodes[1][None])
            i, j = np.nonzero(over)
            a, b, sim = nodes[0][i], nodes[1][j], sims[i, j].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, b]), pa.array(np.r_[b, a]), pa.array(np.r_[sim, sim]), pa.array(np.ones(2 * len(a), bool))], ["a", "b", "sim", "over"])

    return pairs.mapInArrow(run, _LINK)


def graph(
    points: DataFrame, similarity: float, number: int, leaf: int = 64, k: int = 8, trees: int = 12, rounds: int = 6, forests: int = 4, audit: int = 2048, recall: float = 0.98
) -> tuple[DataFrame, float]:
    """a, b, sim of the points (node, vec, radius) in reach of each other, a < b; and the audited recall before what the audit added."""
    angle, bits, block = math.acos(similarity), _levels(number, leaf)[-1], 2 * leaf
    sample = [tuple(r) for r in points.orderBy(F.xxhash64("node"), "node").limit(audit).select("node", "vec", "radius").collect()]
    truth = written(points.select("node", "vec", "radius").mapInArrow(_held_against(sample, angle), _LINK), "audit")
    known, reached, lists = truth.count(), 1.0, None
    for forest in range(forests):
        seeds = [100 + forest * trees + t for t in range(trees if bits else 1)]
        links = _forest(points, seeds, bits, angle, max(2, k // 2), block).withColumn("new", F.lit(True))
        before, lists = lists, written(_lists(links if lists is None else lists.withColumn("new", F.lit(False)).unionByName(links), k), "lists")
        if before is not None:
            discard(before)
        for turn in range(rounds):
            if lists.filter("over and new").isEmpty():
                break
            after = written(_descend(points, lists, turn, angle, k, block), "lists")
            discard(lists)
            lists = after
        reached = 1 - truth.join(lists.filter("over"), ["a", "b"], "left_anti").count() / known if known else 1.0
        if reached >= recall or not bits:
            break
    found = lists.filter("over").select("a", "b", "sim").union(truth.select("a", "b", "sim"))
    if reached < recall:
        found = written(_all_in_reach(points, angle, number), "pairs").select("a", "b", "sim")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim")), reached


def _settle(similarity: float):
    """A task over pairs of blocks: how many vectors of the other block each vector links to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: dict[str, list] = {k: [] for k in ("a", "b", "node", "links")}
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = x.values, y.values
                linked = _matrix(x.field("unit").to_pylist(), np.float64) @ _matrix(y.field("unit").to_pylist(), np.float64).T >= similarity
                for own, other, which in ((x, y, linked), (y, x, linked.T)):
                    count = which @ other.field("copies").to_numpy()
                    some = np.flatnonzero(count)
                    out["node"].append(own.field("node").to_numpy()[some])
                    out["links"].append(count[some])
                    out["a"].append(np.full(len(some), a))
                    out["b"].append(np.full(len(some), b))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64) if v else [], pa.int64()) for v in out.values()], list(out))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = 0.9, leaf: int = 64, block: int = 256, **graph_options) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector, with links at a cosine of at least ``similarity``.

    ``graph_options``: see ``graph``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    rows = written(rows.mapInArrow(_units, "vec_id long, digest binary, unit binary, vec binary"), "vectors")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min("unit").alias("unit"), F.min("vec").alias("vec"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    number = nodes.count()
    points, joined = balls(nodes.select("node", "vec"), similarity, number, leaf)
    weights = nodes.select("node", "copies", "low")
    inner = weights.join(joined, "node", "left").select("node", "copies", "low", F.coalesce("leader", "node").alias("ball"), F.acos(F.least(F.coalesce("sim", F.lit(1.0)), F.lit(1.0))).alias("radius"))
    inner = written(inner, "members")
    size = written(inner.groupBy("ball").agg(F.sum("copies").alias("size"), F.count(F.lit(1)).alias("members"), F.max("radius").alias("radius"), F.min("low").alias("low")), "balls")
    points = written(points.join(size.select(F.col("ball").alias("node"), "radius"), "node"), "points")
    pairs, _ = graph(points, similarity, points.count(), leaf, **graph_options)

    of = lambda side: size.select(F.col("ball").alias(side), F.col("size").alias(f"{side}_size"), F.col("radius").alias(f"{side}_radius"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    sure = F.acos(F.least("sim", F.lit(1.0))) <= F.lit(math.acos(similarity) - SLACK) - F.col("a_radius") - F.col("b_radius")
    pairs = written(pairs.withColumn("sure", sure), "pairs")
    whole = pairs.filter("sure")
    of_ball = whole.select(F.col("a").alias("ball"), F.col("b_size").alias("more")).union(whole.select("b", "a_size")).groupBy("ball").agg(F.sum("more").alias("of_ball"))

    open_pairs = pairs.filter("not sure").select("a", "b")
    wanted = open_pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct().join(size.select("ball", "members"), "ball")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block))
    packed = inner.join(wanted, "ball").join(nodes.select("node", "unit"), "node").groupBy("ball", part.alias("part")).agg(F.collect_list(F.struct("node", "unit", "copies")).alias("g"))
    packed = written(packed.select("ball", "g"), "packed")
    blocks = open_pairs.join(packed.toDF("a", "x"), "a").join(packed.toDF("b", "y"), "b").select("a", "b", "x", "y")
    settled = written(blocks.mapInArrow(_settle(similarity), "a long, b long, node long, links long"), "settled")
    of_node = settled.groupBy("node").agg(F.sum("links").alias("of_node"))

    edges = whole.select("a", "b").union(settled.select("a", "b")).distinct()
    label = size.join(components(edges).withColumnRenamed("node", "ball"), "ball", "left").select("ball", "size", "low", F.coalesce("label", "ball").alias("label"))
    lowest = label.groupBy("label").agg(F.min("low").alias("component_id"))
    told = label.join(lowest, "label").join(of_ball, "ball", "left").select("ball", "component_id", (F.col("size") - 1 + F.coalesce("of_ball", F.lit(0))).alias("links"))
    told = inner.join(told, "ball").join(of_node, "node", "left").select("node", "component_id", (F.col("links") + F.coalesce("of_node", F.lit(0))).alias("n_links"))
    told = nodes.select("node", "digest").join(told, "node").select("digest", "component_id", "n_links")
    found = rows.select("vec_id", "digest").join(told, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
