"""Ranks in layouts of the plane: cells and boxes give the rows of the block search, without a visit to every pair."""

import numpy as np
import pytest

from steadymap.operators import boxes, neighbours
from steadymap.operators.boxes import Boxes
from steadymap.operators.pivots import Index


def layouts(spark, n, digits, label=True):
    rng = np.random.default_rng(n)
    a = np.round(rng.normal(size=(n, 2)), digits)
    a[: n // 10] = a[0]  # many in one place
    b = np.round(a + 0.3 * rng.normal(size=(n, 2)), digits)
    ids = rng.permutation(10 * n)[:n]
    rows = [("ab"[k % 2], int(i), int(k % 3), x.tolist(), y.tolist()) for k, (i, x, y) in enumerate(zip(ids, a, b))]
    return spark.createDataFrame(rows, "space string, id long, label int, v1 array<double>, v2 array<double>")


@pytest.mark.parametrize("digits", [12, 1])
def test_rows_of_the_block_search(spark, monkeypatch, digits):
    points = layouts(spark, 700, digits)
    want = sorted(neighbours.neighbour_ranks(points, 7, block_rows=100).collect())
    monkeypatch.setattr(neighbours, "_top_k", None)  # blocks are not asked
    got = neighbours.neighbour_ranks(points, 7, index=Index(cell=32))
    assert sorted(got.select("space", "i", "j", "r1", "r2", "label_j").collect()) == want


def test_blocks_where_boxes_do_not_serve(spark, monkeypatch):
    points = layouts(spark, 60, 2).drop("label")
    want = sorted(neighbours.neighbour_ranks(points, 7).collect())
    monkeypatch.setattr(boxes, "MOST_POINTS", 5)
    assert sorted(neighbours.neighbour_ranks(points, 7, index=Index()).collect()) == want


@pytest.mark.parametrize("n", [2, 63, 1500])
def test_counts_of_closer_points(n):
    rng = np.random.default_rng(n)
    at = np.round(rng.normal(size=(n, 2)), 1)
    ids = np.arange(n) * 3
    got = Boxes(ids, at)
    centre, other = rng.integers(0, n, 200), rng.integers(0, n, 200)
    d = np.sqrt(np.square(at[centre][:, None] - at[None]).sum(-1))
    t = d[np.arange(200), other][:, None]
    before = (d < t) | ((d == t) & (np.arange(n)[None] < other[:, None]))
    before[np.arange(200), centre] = False
    assert (got.closer(centre, other) == before.sum(axis=1)).all()
