"""LDA learns from every document."""

from pyspark.sql import functions as F

from steadymap.operators import topics, vectors


def test_every_document_is_read(spark):
    """Each document has words of its own, all equally frequent: a word of an unread document keeps its first, tiny weight."""
    docs = spark.createDataFrame([(n, ["shared"] + [f"own{n}"] * 200) for n in range(60)], "doc_id long, tokens array<string>")
    counts = vectors.bow(docs)
    terms = vectors.dictionary(counts)
    _, weights, _ = topics.lda(vectors.sparse_rows(counts, terms), 61, 2)
    best = weights.join(terms, "term_id").where("term <> 'shared'").groupBy("term").agg(F.max("weight").alias("w")).toPandas()["w"]
    assert len(best) == 60 and best.min() > 0.2 * best.max()
