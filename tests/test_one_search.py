"""A query that needs the same neighbours twice searches them once."""

from steadymap.catalog import topics as queries
from steadymap.operators import topics


def test_density_topics_searches_once(spark, monkeypatch):
    calls, knn = [], topics.knn
    monkeypatch.setattr(topics, "knn", lambda *a, **b: calls.append(1) or knn(*a, **b))
    got = queries.density_topics(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and sum(r.documents for r in got) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
