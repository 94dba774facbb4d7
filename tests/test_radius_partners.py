"""Density topics join all partners within the radius, not only those among the k nearest."""

import numpy as np
import pytest

from steadymap.operators import topics


def plain(ids, v, epsilon, min_size, k):
    d = np.sqrt(np.square(v[:, None] - v[None]).sum(axis=2))
    core = np.sort(np.where(np.eye(len(v), dtype=bool), np.inf, d), axis=1)[:, k - 1]
    near = (d <= epsilon) & (core <= epsilon)[:, None] & (core <= epsilon)[None, :]
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.minimum(root, np.where(near, root[None, :], len(v)).min(axis=1))
    return {int(i): int(ids[r]) if (root == r).sum() >= min_size else -1 for i, r in zip(ids, root)}


def found(spark, ids, v, epsilon, min_size, k):
    points = spark.createDataFrame([("s", int(i), [float(x) for x in row]) for i, row in zip(ids, v)], "space string, id long, v array<double>")
    return {r["id"]: r["topic"] for r in topics.density_topics(points, epsilon, min_size, k).collect()}


def test_groups_fuller_than_k_stay_connected(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1e-3, (20, 2)), rng.normal(0, 1e-3, (20, 2)) + [1.0, 0.0], rng.normal(0, 1e-3, (20, 2)) + [9.0, 0.0]])
    got = found(spark, np.arange(60), v, 1.1, 5, 5)
    assert len({got[i] for i in range(40)}) == 1 and got[0] != got[59]
    assert got == plain(np.arange(60), v, 1.1, 5, 5)


@pytest.mark.parametrize("width", [2, 16])
def test_topics_are_the_components_of_all_pairs(spark, width):
    rng = np.random.default_rng(width)
    v = np.round(rng.normal(0, 1, (700, width)) * (rng.integers(0, 2, (700, 1)) * 0.9 + 0.1), 2)
    ids = rng.permutation(5000)[:700]
    order = np.argsort(ids)
    epsilon = 0.12 if width == 2 else 0.45
    assert found(spark, ids, v, epsilon, 4, 6) == plain(ids[order], v[order], epsilon, 4, 6)
