"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>"


def all_pairs(rows, similarity=0.9):
    """vec_id, n_links, component_id, kept by comparing every pair."""
    units = [nb.unit(v) for _, v in rows]
    n, label, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for length in {len(u) for u in units if u is not None}:
        mine = [i for i, u in enumerate(units) if u is not None and len(u) == length]
        x = np.array([units[i] for i in mine])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= similarity, 1))):
            a, b = mine[a], mine[b]
            links[a] += 1
            links[b] += 1
            label[find(a)] = find(b)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((v, links[i], low.get(find(i)), v is not None and v == low.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr)


def told(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def spread(rng, centre, degrees, n):
    """Vectors at about so many degrees from a centre."""
    noise = rng.standard_normal((n, len(centre)))
    noise -= (noise @ centre)[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    angle = np.radians(degrees) * rng.uniform(0.8, 1.2, (n, 1))
    return np.cos(angle) * centre + np.sin(angle) * noise


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(1)
    unit = lambda: nb.unit(rng.standard_normal(32))
    parts = [rng.standard_normal((500, 32))]  # strangers
    parts += [spread(rng, unit(), 6, 400)]  # a dense group: one ball
    parts += [spread(rng, unit(), 18, 150)]  # a wide one, where links are a matter of each pair
    parts += [spread(rng, unit(), 12, 2) for _ in range(60)]  # pairs
    a, b = unit(), unit()
    b = nb.unit(b - (b @ a) * a)
    parts += [np.array([math.cos(t) * a + math.sin(t) * b for t in np.radians(np.arange(0, 80, 2.5))])]  # a chain
    x = np.concatenate(parts)
    return [(i, v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(len(x)).tolist(), x)]


def test_rows_equal_all_pairs(spark, groups):
    df = spark.createDataFrame(groups, SCHEMA)
    assert told(nb.near_vectors(df, leaf=16)) == all_pairs(groups)


def test_links_near_the_threshold_through_the_descent(spark):
    """Few trees find few of the pairs at 0.9 to 0.93; rounds and further forests find the others."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((300, 24)), *(spread(rng, nb.unit(rng.standard_normal(24)), 16, 6) for _ in range(100))])
    x = np.array([nb.unit(v) for v in x], np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(nb._units, "vec_id long, digest binary, unit binary, vec binary")
    points = nb.written(points.select(F.col("vec_id").alias("node"), "vec", F.lit(0.0).alias("radius")), "points")
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(x.astype(float) @ x.T.astype(float) >= 0.9, 1)))}
    start = {(r["a"], r["b"]) for r in nb._forest(points, [100, 101], 5, math.acos(0.9), 4, 128).filter("over and a < b").collect()}
    found, recall = nb.graph(points, 0.9, len(rows), leaf=16, trees=2, audit=900)
    got = {(r["a"], r["b"]) for r in found.filter("sim >= 0.9").collect()}
    assert len(start & true) < 0.8 * len(true) and recall >= 0.98 and len(got & true) >= 0.98 * len(true)


def test_all_points_are_compared_if_the_recall_stays_low(spark, groups):
    df = spark.createDataFrame(groups[:700], SCHEMA)
    assert told(nb.near_vectors(df, leaf=16, trees=1, rounds=0, forests=1, recall=1.1)) == all_pairs(groups[:700])


def test_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, same), (8, same), (8, same), (9, [2.0, 4.0, 6.0]), (10, same[:2]), (None, same), (None, [9.0]), (11, [3e38, 0.0, 0.0]), (12, [1e-38, 0.0, 0.0]), (13, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = all_pairs(rows)
    assert told(nb.near_vectors(df)) == want
    clashing = df.selectExpr("*", "1 AS node", "'x' AS Digest", "2 AS n_links")
    assert told(nb.near_vectors(clashing)) == want
    assert nb.near_vectors(df.limit(0)).count() == 0


def test_cosine_exactly_at_the_threshold(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 1.0])]  # cosines 0.6, 0.8 and 0
    assert told(nb.near_vectors(spark.createDataFrame(rows, SCHEMA), similarity=0.8)) == [(0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False)]
