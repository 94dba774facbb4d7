"""Rank correlations of spaces with many pairs are ordered slice by slice, with the files of one slice on disk."""

import numpy as np
import pytest

from steadymap.functions.distance import BlockDistance, SparseBlock
from steadymap.operators import pairs


def ranks(x):
    values, place, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[place]


def plain(a, b, metric):
    one, two = (BlockDistance(v, v, m).stable()[np.triu_indices(len(v), 1)] for v, m in ((a, metric), (b, "euclidean")))
    fine = np.isfinite(one) & np.isfinite(two)
    return np.corrcoef(ranks(one[fine]), ranks(two[fine]))[0, 1]


def frame(spark, a, b, space="s"):
    rows = [(space, n, x.tolist(), y.tolist()) for n, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "space string, id long, v1 array<double>, v2 array<double>")


@pytest.mark.parametrize("width, metric, digits", [(2, "euclidean", 12), (2, "euclidean", 0), (2, "euclidean", 1), (20, "cosine", 12)])
def test_slices_give_the_whole_correlation(spark, monkeypatch, width, metric, digits):
    rng = np.random.default_rng(width)
    a = np.round(rng.normal(size=(260, width)), digits)
    b = np.round(a[:, :2] + rng.normal(size=(260, 2)), digits)
    if metric == "cosine":
        a[7] = 0  # no distance
    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", 5_000)
    monkeypatch.setattr(pairs, "PAIRS_A_SLICE", 9_000)
    calls, once = [], pairs._spearman_at_once
    monkeypatch.setattr(pairs, "_spearman_at_once", lambda *a: calls.append(1) or once(*a))
    points = frame(spark, a, b).unionByName(frame(spark, a[:60], b[:60], "t"))
    got = {r["space"]: r["spearman"] for r in pairs.pair_spearman(points, (metric, "euclidean"), block_rows=100).collect()}
    assert len(calls) == 1 + (digits == 1)  # the small space; and heavy ties a rounding error apart, which no bin tells apart
    assert got["s"] == pytest.approx(plain(a, b, metric), abs=1e-9) and got["t"] == pytest.approx(plain(a[:60], b[:60], metric), abs=1e-12)


def test_batches_of_spaces_leave_no_shuffle_files(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points, whole = None, {}
    for space in "stu":
        a = rng.normal(size=(90, 2))
        b = a + rng.normal(size=(90, 2))
        whole[space] = plain(a, b, "euclidean")
        some = frame(spark, a, b, space)
        points = some if points is None else points.unionByName(some)
    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", 5_000)
    monkeypatch.setattr(pairs, "share", None)  # a cached table would hold them
    keeps, once = [], pairs._spearman_at_once
    monkeypatch.setattr(pairs, "_spearman_at_once", lambda *a: keeps.append(a[5]) or once(*a))
    got = {r["space"]: r["spearman"] for r in pairs.pair_spearman(points, block_rows=50).collect()}
    assert keeps == [pairs.materialize] * 3 and got == pytest.approx(whole, abs=1e-12)


def test_bins_too_coarse_fall_back_to_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(150, 2)) * 1e-9
    a[0] = 1e6
    b = rng.normal(size=(150, 2))
    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", 5_000)
    got = pairs.pair_spearman(frame(spark, a, b)).first()["spearman"]
    assert got == pytest.approx(plain(a, b, "euclidean"), abs=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "jensenshannon"])
def test_chosen_distances_have_the_bits_of_all(metric):
    rng = np.random.default_rng(4)
    a, b = rng.random((30, 11)), rng.random((40, 11))
    r, c = rng.integers(0, 30, 200), rng.integers(0, 40, 200)
    dist = BlockDistance(a, b, metric)
    assert (dist.stable_at(r, c) == dist.stable()[r, c]).all()
    if metric != "jensenshannon":
        rows = lambda m: SparseBlock([np.flatnonzero(x > 0.5) for x in m], [x[x > 0.5] for x in m])
        dist = BlockDistance(rows(a), rows(b), metric)
        assert (dist.stable_at(r, c, dist.matrix()) == dist.stable()[r, c]).all()
