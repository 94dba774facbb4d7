"""What grows with a space: blocks, merged lists and the distances that are ordered."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadymap.functions.distance import BlockDistance, count_closer, nearest, others
from steadymap.operators.blocks import pair_blocks
from steadymap.operators.neighbours import merged


def test_a_point_is_sent_to_sixteen_blocks_at_most(spark):
    points = spark.range(40_960).select(F.lit("a").alias("space"), "id", F.array(F.rand(1), F.rand(2)).alias("v"))
    seen = lambda key, left, right, _: pd.DataFrame({"r": [key[1]], "c": [key[2]], "n": [len(left) * len(right)]})
    got = pair_blocks(points, seen, "r int, c int, n long").toPandas()
    assert len(got) == 256 and got["n"].sum() == 40_960**2  # blocks of 2,048 rows were 400 pairs


def test_long_lists_merge_in_order_without_comparing_all_entries(spark):
    rows = [("a", n, [int(j) for j in js], [float(j % 50) for j in js]) for n in range(3) for js in (range(9, 4000, 2), range(8, 4000, 2), range(8, 40, 2))]
    out = merged(spark.createDataFrame(rows, "space string, i long, js array<long>, ds array<double>"), 60)
    want = sorted((float(j % 50), j) for j in range(8, 4000))[:60]
    got = out.where("i = 1").orderBy("r").collect()
    assert [(r.d, r.j) for r in got] == want and [r.r for r in got] == list(range(1, 61))
    assert "array_distinct" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("width", [2, 12])
def test_nearest_against_a_whole_sort(width):
    rng = np.random.default_rng(width)
    b = np.round(rng.normal(size=(700, width)), 1)
    b[200:260] = b[0]  # copies
    b[5] = np.nan
    ids = np.arange(700) * 3
    for a, row_ids in ((b[100:300], ids[100:300]), (b[::7] + 0.05, np.arange(100) * 3 + 1)):
        dist = BlockDistance(a, b, "euclidean")
        full = dist.matrix() if width == 2 else np.sqrt(np.square(a[:, None] - b[None]).sum(-1))
        full[row_ids[:, None] == ids[None]] = np.inf
        rows, cols, d = nearest(dist, dist.matrix(), row_ids, ids, 9)
        exact = np.where(np.isnan(full), np.inf, full if width == 2 else np.round(full, 12))
        for r in range(len(a)):
            order = [c for c in np.lexsort((ids, exact[r])) if np.isfinite(exact[r, c])][:9]
            assert np.allclose(np.sort(d[rows == r]), exact[r, order]) and (width > 2 or cols[rows == r].tolist() == order)


@pytest.mark.parametrize("width", [2, 12])
def test_closer_points_are_counted_on_masked_distances(width):
    """Own points and points without a distance are taken out once for all look-ups; ties go to the smaller id."""
    rng = np.random.default_rng(width)
    a = np.round(rng.normal(size=(60, width)), 1)
    a[20:30] = a[0]
    a[7] = np.nan
    ids, rows = np.arange(60), np.repeat([0, 21, 40], 3)
    dist = BlockDistance(a, a, "euclidean")
    asked = np.tile([3, 25, 50], 3)
    targets = dist.exact(rows, asked)
    full = others(dist.matrix(), ids, ids)
    got = count_closer(dist, full, ids, rows, asked, targets)
    for r, j, t, n in zip(rows, asked, targets, got):
        d = dist.exact(np.full(60, r), ids)
        assert n == sum(1 for c in ids if c not in (r, 7) and (d[c], c) < (t, j))
