"""The pivot index gives the rows of the block search; the projection index gives most of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadymap.operators.lsh import approx_knn, recall
from steadymap.operators.neighbours import knn
from steadymap.operators.pivots import Index, visited
from tests.test_kernels import frame


def clouds(seed, n, width, groups):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 12
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, width))


def rows(df):
    return sorted((r.space, r.i, r.j, r.r, round(r.d, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "jensenshannon"])
def test_pivots_equal_blocks(spark, metric):
    data = np.abs(clouds(1, 500, 6, 9))
    data[100:220] = data[100]  # a hot cell of copies, and ties
    data[300] = 0
    points = frame(spark, data).unionByName(frame(spark, np.round(np.abs(clouds(2, 90, 6, 2)), 1), space="b")).unionByName(frame(spark, data[:3], space="few"))
    want = knn(points, 6, metric)
    for index in (Index(cell=25), Index(cell=200), Index(cell=3, pivots=40)):
        assert rows(knn(points, 6, metric, index=index)) == rows(want)


def test_labels_and_empty_input(spark):
    points = frame(spark, clouds(3, 120, 3, 4)).withColumn("label", F.col("id") % 3)
    got = knn(points, 4, index=Index(cell=20))
    assert all(r.label_j == r.j % 3 for r in got.collect())
    assert rows(got) == rows(knn(points, 4))
    assert knn(points.limit(0), 4, index=Index()).count() == 0


def test_too_many_pivots_fall_back_to_blocks(spark):
    points = frame(spark, clouds(4, 60, 3, 2))
    assert rows(knn(points, 3, index=Index(cell=5, cells=2))) == rows(knn(points, 3))


def test_share_of_visits_falls(spark):
    share = {}
    for n in (500, 4000):
        r = visited(frame(spark, clouds(5, n, 2, 40)), 7, index=Index(cell=64)).first()
        assert r.points == n and r.visited <= r.possible
        share[n] = r.visited / r.possible
    assert share[4000] < share[500] / 2 < 0.5


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_projection_buckets_find_most(spark, metric):
    points = frame(spark, clouds(6, 1500, 8, 30))
    exact = knn(points, 7, metric)
    found = approx_knn(points, 7, metric)
    assert recall(found, exact).first().recall >= 0.9
    # what was found carries its exact distance
    both = found.join(exact.select("i", "j", F.col("d").alias("e")), ["i", "j"])
    assert both.where("abs(d - e) > 1e-9").count() == 0 and found.groupBy("i").count().where("count > 7").count() == 0
