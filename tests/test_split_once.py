"""A space by its name computes the caller's token lists once."""

from pyspark.sql import functions as F

from steadymap.operators import topics


def test_token_lists_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def split(text):
        seen.add(1)
        return text.split(" ")

    texts = spark.createDataFrame([(n, f"word{n} common shared{n % 3}") for n in range(30)], "doc_id long, text string")
    lists = texts.select("doc_id", F.udf(split, "array<string>")("text").alias("tokens"))
    rows = topics.build_space("tfidf", lists).collect()
    assert len(rows) == 30 and seen.value == 30
