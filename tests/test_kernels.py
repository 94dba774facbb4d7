"""Block kernels against plain numpy, including ties, duplicates and several block sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadymap.operators import scores, shape
from steadymap.operators.local import local_measures
from steadymap.operators.neighbours import knn, neighbour_ranks
from steadymap.operators.order import number_rows
from steadymap.operators.pairs import pair_moments, pair_spearman


def frame(spark, matrix, name="v", space="a"):
    rows = [(space, int(n), [float(x) for x in row]) for n, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"space string, id long, {name} array<double>")


def distances(a, metric="euclidean"):
    if metric == "euclidean":
        return np.sqrt(np.square(a[:, None] - a[None]).sum(-1))
    norm = np.linalg.norm(a, axis=1)
    return 1 - a @ a.T / np.outer(norm, norm)


def order(d):
    """ranks[i, j] of j around i by (distance, id), the point itself excluded."""
    n = len(d)
    ranks = np.zeros((n, n), dtype=int)
    for i in range(n):
        others = [j for j in np.lexsort((np.arange(n), d[i])) if j != i]
        ranks[i, others] = np.arange(1, n)
    return ranks


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(7)
    high = rng.normal(size=(90, 12))
    high[30:60] = high[0]  # a third of all points are copies of one point
    low = np.round(rng.normal(size=(90, 2)), 1)  # many ties
    return high, low


@pytest.mark.parametrize("block_rows", [16, 512])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn(spark, clouds, metric, block_rows):
    d = distances(clouds[0], metric)
    if metric == "cosine":
        d = np.round(d, 12)
    ranks = order(np.where(d < 1e-9, 0, d))
    got = knn(frame(spark, clouds[0]), 5, metric, block_rows=block_rows).toPandas()
    assert len(got) == 90 * 5
    if metric == "euclidean":
        assert all(ranks[r.i, r.j] == r.r for r in got.itertuples())
    else:  # copies tie up to the last bit
        assert np.allclose(got["d"], [np.sort(np.delete(d[r.i], r.i))[r.r - 1] for r in got.itertuples()])


@pytest.mark.parametrize("block_rows", [16, 512])
def test_ranks_with_ties(spark, clouds, block_rows):
    high, low = clouds
    r1, r2 = order(distances(high)), order(distances(low))
    both = frame(spark, high, "v1").join(frame(spark, low, "v2"), ["space", "id"])
    got = neighbour_ranks(both, 5, block_rows=block_rows).toPandas()
    want = {(i, j) for i in range(90) for j in range(90) if i != j and (r1[i, j] <= 5 or r2[i, j] <= 5)}
    assert {(r.i, r.j) for r in got.itertuples()} == want
    assert all(r1[r.i, r.j] == r.r1 and r2[r.i, r.j] == r.r2 for r in got.itertuples())


@pytest.mark.parametrize("block_rows,per_bucket", [(16, 50), (512, 10**6)])
def test_pair_statistics(spark, clouds, block_rows, per_bucket):
    high, low = clouds
    up = np.triu_indices(90, 1)
    a, b = distances(high)[up], distances(low)[up]
    both = frame(spark, high, "v1").join(frame(spark, low, "v2"), ["space", "id"])
    got = pair_moments(both, block_rows=block_rows).first()
    assert got["pearson"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    assert got["stress"] == pytest.approx(((a - b) ** 2).sum() / (a**2).sum(), abs=1e-6)
    rank = lambda x: pd.Series(x).rank().to_numpy()
    rho = pair_spearman(both, block_rows=block_rows, pairs_per_bucket=per_bucket).first()["spearman"]
    assert rho == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1], abs=1e-9)


def test_spearman_is_exact_under_heavy_ties(spark):
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 3, (60, 2)).astype(float), rng.integers(0, 4, (60, 2)).astype(float)
    up = np.triu_indices(60, 1)
    rank = lambda m: pd.Series(distances(m)[up]).rank().to_numpy()
    both = frame(spark, one, "v1").join(frame(spark, two, "v2"), ["space", "id"])
    rho = pair_spearman(both, block_rows=8, pairs_per_bucket=40).first()["spearman"]
    assert rho == pytest.approx(np.corrcoef(rank(one), rank(two))[0, 1], abs=1e-12)


def test_sparse_equals_dense(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.4, (40, 30)) + np.eye(40, 30)
    rows = [("a", n, {"idx": [int(k) for k in np.flatnonzero(r)], "val": [float(x) for x in r[r != 0]]})
            for n, r in enumerate(counts)]
    sparse = spark.createDataFrame(rows, "space string, id long, v struct<idx:array<long>,val:array<double>>")
    for metric in ("cosine", "euclidean"):
        a = knn(sparse, 4, metric, block_rows=16).orderBy("i", "r").toPandas()
        b = knn(frame(spark, counts), 4, metric).orderBy("i", "r").toPandas()
        assert np.allclose(a["d"], b["d"])


def test_identical_layouts_are_perfect(spark, clouds):
    pts = frame(spark, clouds[0], "v1").withColumn("v2", F.col("v1"))
    row = local_measures(pts).first()
    assert row["trustworthiness"] == row["continuity"] == row["mrre_false"] == row["mrre_missing"] == 1.0


def test_rotation_is_recovered(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    t = np.radians(33)
    turned = x @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) * 2 + 5
    rows = [("a", n, *map(float, p), *map(float, q)) for n, (p, q) in enumerate(zip(x, turned))]
    pairs = spark.createDataFrame(rows, "space string, id long, x1 double, y1 double, x2 double, y2 double")
    got = shape.procrustes(pairs, "best").first()
    assert abs(got["rotation"]) == pytest.approx(33, abs=1e-6)
    assert got["residual"] == pytest.approx(0, abs=1e-9)
    assert got["scale"] == pytest.approx(0.5)


def test_published_golden_values(spark):
    from steadymap.catalog.common import layout_pairs

    row = scores.stability_rows(layout_pairs(spark, "/root/testdata/sf0.001")).first()
    want = {"spearman_correlation": 0.985696566, "pearson_correlation": 0.987252818,
            "trustworthiness": 0.991643003, "continuity": 0.991828221, "local_continuity": 0.543971944,
            "label_preservation": 0.675714286, "mrre_false": 0.988280021, "mrre_missing": 0.988342859,
            "distance_consistency": 0.008, "silhouette_coefficient": 0.001088252,
            "cluster_ordering": 0.980632411, "rotation": -0.065170390}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-8), name


def test_number_rows_equals_global_order(spark):
    rows = [(n, n // 700 if n % 3 else 0) for n in range(2000)]  # a third share one key
    df = spark.createDataFrame(rows, "id long, k long")
    got = number_rows(df, F.col("k"), ["id"], "pos").toPandas().sort_values("pos")
    assert got["id"].tolist() == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
