"""The bound of LDA per token is Spark's, without its work of documents x vocabulary."""

import inspect

import numpy as np
import pytest
from pyspark.ml.clustering import LDA

from steadymap.operators import topics


def test_bound_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    rows = [(999, ([], []))]  # a document without words
    for d in range(80):
        idx = np.sort(rng.choice(np.arange(60) + d % 4 * 20, rng.integers(3, 25), replace=False))
        rows.append((d, (idx.tolist(), rng.integers(1, 9, len(idx)).astype(float).tolist())))
    data = topics._features(spark.createDataFrame(rows, "doc_id long, v struct<idx: array<int>, val: array<double>>"), 120)
    for prior in ({"optimizeDocConcentration": True}, {"docConcentration": [0.4, 0.3, 0.2, 0.05, 0.05]}):
        fitted = LDA(k=5, maxIter=3, seed=1, optimizer="online", subsamplingRate=1.0, **prior).fit(data)
        assert topics.log_perplexity(fitted, data, 5) == pytest.approx(fitted.logPerplexity(data), rel=1e-5)
    assert ".logPerplexity(" not in inspect.getsource(topics.lda)
