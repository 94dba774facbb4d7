import zlib

import numpy as np
import pytest

from steadymap.llm import quality as q
from steadymap.llm.queries import op4_quality


def test_sums_and_fit_equal_plain_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, q.DIM)), rng.integers(0, 2, 200)
    x[y == 1] *= 0.3
    table = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "x array<double>, y long").repartition(5)
    sums = q.class_sums(table)
    for c in (0, 1):
        assert sums[c][0] == (y == c).sum()
        assert sums[c][1] == pytest.approx(x[y == c].sum(0))
        assert sums[c][2] == pytest.approx(x[y == c].T @ x[y == c])
    s = q.Settings(shrinkage=0.2, ridge=0.1)
    model = q.fit(sums, s)
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (covs[0] * (y == 0).sum() + covs[1] * (y == 1).sum()) / len(y)
    logs = []
    for c in (0, 1):
        cov = 0.9 * (0.8 * covs[c] + 0.2 * pooled) + 0.1 * np.diag(np.diag(pooled) + 1e-4)
        d = x - x[y == c].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert model.margin(x) == pytest.approx(np.arcsinh(logs[1] - logs[0]))


def test_held_out_documents_are_separated(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op4_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in held) and sum(r.held_out for r in rows.values()) < 300
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "!!! ???", "é", "word " * 100_000, "word"] * 3
    docs = spark.createDataFrame([(n, t, 1.0) for n, t in enumerate(texts)] + [(0, None, 1.0), (None, "x", 1.0)],
                                 "doc_id long, text string, x double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = q.score(docs, labels).collect()
    assert len(rows) == 26 and len({r.score for r in rows}) == 1
    none = q.score(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert q.score(docs.limit(0), labels).collect() == []
    assert np.isfinite([q.statistics(t) for t in texts]).all()
