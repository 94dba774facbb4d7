"""Factor models as tables: against plain linear algebra."""

import numpy as np
import pytest

from steadymap.operators import topics


def corpus(spark, counts):
    rows = [(n, {"idx": [int(k) for k in np.flatnonzero(r)], "val": [float(x) for x in r[r != 0]]}) for n, r in enumerate(counts)]
    return spark.createDataFrame(rows, "doc_id long, v struct<idx:array<long>,val:array<double>>")


def test_lsi_equals_a_plain_decomposition(spark):
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.3, (60, 40)) * rng.integers(1, 5, 40) + 3 * np.outer(np.arange(60) % 3 == 0, np.arange(40) < 9)
    counts[7] = 0
    docs, terms, singular = topics.lsi_factors(corpus(spark, counts), 40, 4)
    u, s, v = np.linalg.svd(counts, full_matrices=False)
    assert np.allclose(singular, s[:4], atol=1e-6)
    got = terms.orderBy("term_id").toPandas().set_index("term_id").reindex(range(40)).fillna(0).to_numpy()
    signs = np.sign(v[np.arange(4), np.abs(v[:4]).argmax(axis=1)])
    assert np.allclose(got, v[:4].T * signs, atol=1e-5)
    table = docs.toPandas().set_index("doc_id").reindex(range(60)).fillna(0).to_numpy()
    assert np.allclose(table, counts @ (v[:4].T * signs), atol=1e-4)


def test_lsi_has_every_document_and_term(spark):
    counts = np.outer([3, 0, 1, 0, 2], [1, 2, 0, 1]) + np.outer([0, 0, 1, 5, 0], [0, 0, 4, 1])
    weights, long = topics.lsi(corpus(spark, counts), 4, 2)
    table = weights.toPandas().pivot(index="doc_id", columns="topic", values="p").to_numpy()
    basis = long.toPandas().pivot(index="term_id", columns="topic", values="weight").to_numpy()
    assert np.allclose(table @ basis.T, counts, atol=1e-6) and (table[1] == 0).all() and basis.shape == (4, 2)


def test_more_directions_than_there_are(spark):
    counts = np.outer([1, 2, 0, 3], [1, 0, 2])
    _, _, singular = topics.lsi_factors(corpus(spark, counts), 3, 3)
    assert singular[0] == pytest.approx(np.linalg.norm(counts)) and np.allclose(singular[1:], 0, atol=1e-4)


def test_nmf_error_is_the_distance_to_the_product(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(1.0, (30, 12)).astype(float)
    docs, terms, errors = topics.nmf(corpus(spark, counts), 12, 3, 12, tolerance=0)
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    w = docs.toPandas().pivot(index="doc_id", columns="topic", values="p").to_numpy()
    h = terms.toPandas().pivot(index="topic", columns="term_id", values="weight").to_numpy()
    # the last error was taken before the topics moved once more
    assert np.square(counts - w @ h).sum() <= errors[-1] + 1e-6
    assert (w >= 0).all() and (h >= 0).all()
