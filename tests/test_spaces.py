"""Every named space gives a row for every document; combinations keep their geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadymap.operators import topics


@pytest.fixture(scope="module")
def lists(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(12)]
    rows = [(n, [str(w) for w in rng.choice(words[(n % 2) * 6 : (n % 2) * 6 + 7], 10)]) for n in range(16)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").cache()


QUICK = {"lda": {"iterations": 2}, "lsi": {"power_iters": 2}, "nmf": {"iterations": 2}}


@pytest.mark.parametrize("name", topics.SPACES)
def test_named_spaces(lists, name):
    got = topics.build_space(name, lists, 3, **QUICK.get(name.split("_")[0], {})).collect()
    assert sorted(r.doc_id for r in got) == list(range(16))
    if name not in ("bow", "tfidf"):
        assert all(len(r.v) == (64 if name == "bert" else 3) and np.isfinite(r.v).all() for r in got)
    if name == "tfidf":
        assert all(sum(x * x for x in r.v.val) == pytest.approx(1.0) for r in got)


def test_unknown_space(lists):
    with pytest.raises(ValueError):
        topics.build_space("lda2", lists)


def test_combined_space_has_the_whole_geometry(spark):
    rng = np.random.default_rng(2)
    p, w = rng.random((9, 4)), rng.random((4, 30)) * (rng.random((4, 30)) < 0.4)
    w[2] = 0
    docs = spark.createDataFrame([(d, t, float(p[d, t])) for d in range(9) for t in range(4)], "doc_id long, topic int, p double")
    terms = spark.createDataFrame([(t, n, float(w[t, n])) for t in range(4) for n in range(30) if w[t, n]], "topic int, term long, weight double")
    v = np.stack(topics.combined_space(docs, terms, 4).orderBy("doc_id").toPandas()["v"])
    assert np.allclose(v @ v.T, (p @ w) @ (p @ w).T)
