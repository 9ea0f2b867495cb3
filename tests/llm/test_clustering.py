"""Clustering in whole numbers against brute force."""

import hashlib
import math

import numpy as np
import pytest

from graphweave.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q int"


def brute(rows, k, rounds):
    whole = lambda x: math.floor(1024 * x)
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(1024 * x) < 1 << 27 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return centroids, sorted(((i is None, i or 0), c, d) for (i, _), (d, c) in zip(kept, assign()))


def compare(spark, rows, k, rounds, partitions=3):
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(partitions)
    found = clustering.cluster(df, k, rounds)
    centroids, want = brute(rows, k, rounds)
    assert found.centroids.tolist() == centroids
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in found.assigned.collect()) == want
    assert sum(found.inertia) == sum(d for _, _, d in want)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 64))
    vectors = (centres[rng.integers(0, 5, 300)] + rng.normal(0, 0.3, (300, 64))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    # Equal vectors, repeated rows, repeated and null ids, and vectors that take no part.
    rows += [rows[0], (900, rows[1][1]), (7, rows[8][1]), (None, rows[9][1]), (901, None), (902, [1.0] * 63), (903, [float("nan"), *[0.0] * 63]), (904, [float("inf"), *[0.0] * 63]), (905, [None, *[0.0] * 63]), (906, [200000.0, *[0.0] * 63]), (907, [])]
    compare(spark, rows, 8, 4)


def test_clusters_of_ties_and_of_few(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    compare(spark, same, 8, 3)
    grid = [(i, [float(i % 2), float(i // 2 % 2), *[0.0] * 62]) for i in range(32)]
    compare(spark, grid, 8, 5)
    compare(spark, grid[:3], 8, 2)
    assert clustering.cluster(spark.createDataFrame([], SCHEMA)).assigned.count() == 0


@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_most_centroids_are_ruled_out_and_none_wrongly(scale):
    rng = np.random.default_rng(4)
    axes = rng.normal(0, 1, (64, 64)) * np.exp(-np.arange(64) / 8)[:, None]
    x = np.floor(1024 * scale * (rng.normal(0, 1, (4000, 64)) @ axes)).astype(np.int64)
    centroids = x[:64].copy()
    turned = clustering.fit_rotation(x, 16)
    near, best, measured = clustering.nearest(x, *turned.turn(x), centroids, turned.turn(centroids))
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (near == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.15 * exact.size
