"""Class-based weights from counts per class are those from counts per document."""

import pytest

from steadymap.catalog import text
from steadymap.operators import vectors
from steadymap.session import materialize


def test_counts_by_class(spark):
    docs = spark.createDataFrame([(n, "abc"[n % 3], [f"w{n * k % 7}" for k in range(1, 6)]) for n in range(20)], "doc_id long, topic string, tokens array<string>")
    pairs = vectors.ngrams(docs, 1, 2)
    by_document = vectors.class_tfidf(vectors.bow(pairs), docs.select("doc_id", "topic"), 20)
    by_class = vectors.class_tfidf(vectors.bow(pairs, "topic"), None, 20)
    key = lambda df: {(r.topic, r.term): pytest.approx(r.weight) for r in df.collect()}
    assert key(by_document) == key(by_class) and by_class.count() > 20


def test_ngrams_are_not_written_per_document(spark, monkeypatch):
    written = []
    monkeypatch.setattr(text, "materialize", lambda df: written.append(df) or materialize(df))
    text.ctfidf_ngrams(spark, "/root/testdata/sf0.001")
    lists, counts = written
    assert lists.where("exists(tokens, x -> x like '% %')").isEmpty() and set(counts.columns) == {"topic", "term", "tf"}
