"""The terms of LDA's topics come from its matrix, without Spark's sorted objects on the driver."""

import tracemalloc

import numpy as np
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.linalg import Vectors

from steadymap.operators import topics


def test_terms_are_those_of_describe_topics(spark, monkeypatch):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (40, 12))
    data = spark.createDataFrame([(n, Vectors.dense(c.astype(float))) for n, c in enumerate(counts)], ["doc_id", "features"])
    fitted = LDA(k=3, maxIter=3, seed=1, optimizer="online").fit(data)
    want = {(r["topic"], t): w for r in fitted.describeTopics(12).collect() for t, w in zip(r["termIndices"], r["termWeights"])}
    got = topics._topic_terms(data, fitted.topicsMatrix().toArray()).collect()
    assert len(got) == len(want) == 36 and all(abs(want[r["topic"], r["term_id"]] - r["weight"]) < 1e-12 for r in got)
    rows = spark.createDataFrame([(n, (np.arange(12).tolist(), c.astype(float).tolist())) for n, c in enumerate(counts)],
                                 "doc_id long, v struct<idx: array<int>, val: array<double>>")
    for kind in (LDAModel, LocalLDAModel):
        monkeypatch.setattr(kind, "describeTopics", None)
    assert topics.lda(rows, 12, 3, iterations=2)[1].count() == 36


def test_log_gamma_makes_no_list():
    x = np.random.default_rng(2).random((100_000, 5)) + 0.1
    tracemalloc.start()
    got = topics._log_gamma(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == x.shape and peak < 2 * x.nbytes
