"""Centroid clustering against a plain loop in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance double"


def _plain(rows, dim, k, rounds, scale=64):
    """(vec_id, cluster, distance) by Python's integers, and the centroids."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "g", v) for i, v in kept)
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept]
    return sorted(found, key=str), centres


def _both(spark, rows, dim, k, rounds=3):
    docs = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], SCHEMA).repartition(3)
    found, centres = clusters.kmeans(docs, dim=dim, k=k, rounds=rounds)
    want, plain = _plain(rows, dim, k, rounds)
    assert sorted([tuple(r) for r in found.collect()], key=str) == want
    assert centres.tolist() == plain


def test_rows_at_the_edge(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += rows[:5] + [(7, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, math.nan, 2.0]), (105, [math.inf, 0.0, 0.0])]
    _both(spark, rows, 3, 5)


def test_ties_and_equal_vectors(spark):
    """Equal centroids, points in the middle of two, and clusters that stay empty."""
    rows = [(i, [float(i % 3), 0.0]) for i in range(90)] + [(100 + i, [0.0, 0.0]) for i in range(40)]
    _both(spark, rows, 2, 8)


def test_huge_components(spark):
    rows = [(i, [1e30 if i % 3 == 0 else float(i), -3e7 * i]) for i in range(30)]
    docs = spark.createDataFrame([(i, v, "", 0.0) for i, v in rows], SCHEMA)
    found, centres = clusters.kmeans(docs, dim=2, k=4)
    assert found.count() == 30 and max(abs(x) for c in centres.tolist() for x in c) <= 10**18
    _both(spark, [(i, [float(i * 10**6), -float(i * 10**7)]) for i in range(40)], 2, 4)


def test_few_vectors_and_empty_table(spark):
    _both(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], 2, 16)
    found, centres = clusters.kmeans(spark.createDataFrame([], SCHEMA), dim=2)
    assert found.collect() == [] and len(centres) == 0
    with pytest.raises(ValueError, match="at most"):
        clusters.kmeans(spark.createDataFrame([], SCHEMA), dim=10**6, k=10)


def test_whole_nodes_are_assigned_and_none_wrongly():
    """Far groups go over as nodes; close ones agree with the distance to all."""
    rng = np.random.default_rng(2)
    for spread in (2, 40, 4000):
        points = (rng.integers(0, 6, (3000, 1)) * 5000 + rng.normal(size=(3000, 5)) * spread).astype(np.int64)
        centres = points[rng.choice(3000, 12, replace=False)]
        tree = clusters.build(points)
        cluster, counts, sums, by_node = clusters.assign(tree, centres)
        want = ((tree.points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        assert (cluster == want).all() and (counts == np.bincount(want, minlength=12)).all()
        assert all(sums[j].tolist() == tree.points[want == j].sum(0).tolist() for j in range(12))
        assert spread > 40 or by_node > 500
