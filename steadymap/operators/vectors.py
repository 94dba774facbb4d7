"""Vector spaces of token lists. Sparse matrices are long frames (doc_id, term, tf)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from steadymap.operators.order import number_rows
from steadymap.session import materialize


def bow(token_lists: DataFrame, by: str = "doc_id") -> DataFrame:
    """Term frequencies per document, or per value of ``by``; counted before the shuffle."""
    return token_lists.select(by, F.explode("tokens").alias("term")).groupBy(
        by, "term").agg(F.count("*").alias("tf"))


def ngrams(token_lists: DataFrame, shortest: int = 1, longest: int = 2) -> DataFrame:
    """Token lists whose tokens are all runs of ``shortest`` to ``longest`` tokens, joined by spaces; other columns stay.

    Shorter lists give fewer runs; a list shorter than ``shortest`` gives none.
    """
    if not 1 <= shortest <= longest:
        raise ValueError("need 1 <= shortest <= longest")
    tokens = F.col("tokens")
    runs = lambda n: F.when(F.size(tokens) >= n, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda at: F.array_join(F.slice(tokens, at, n), " "))).otherwise(F.array().cast("array<string>"))
    return token_lists.withColumn("tokens", F.concat(*[runs(n) if n > 1 else tokens for n in range(shortest, longest + 1)]))


def dictionary(counts: DataFrame) -> DataFrame:
    """(term, term_id, df, cf): ids by first document, then alphabetically."""
    terms = materialize(counts.groupBy("term").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("df"), F.sum("tf").alias("cf")))
    return number_rows(terms, F.col("first_doc"), ["term"], "term_id").select(
        "term", "term_id", "df", "cf")


def with_ids(counts: DataFrame, terms: DataFrame) -> DataFrame:
    return counts.join(terms.select("term", "term_id"), "term").select("doc_id", "term_id", "tf")


def density(counts: DataFrame, documents: int, min_density: float = 0.001) -> DataFrame:
    """(term, share, kept): share of the documents with a non-zero weight."""
    part = F.count_if(F.col("tf") != 0) / F.lit(documents)
    return counts.groupBy("term").agg(part.alias("share")).withColumn(
        "kept", F.col("share") >= min_density)


def keep_terms(matrix: DataFrame, terms: DataFrame) -> DataFrame:
    return matrix.join(terms.filter("kept").select("term"), "term", "left_semi")


def drop_terms(matrix: DataFrame, dropped: DataFrame) -> DataFrame:
    return matrix.join(dropped.select("term"), "term", "left_anti")


def tfidf(counts: DataFrame, documents: int) -> DataFrame:
    """tf · log2(N / df), rows scaled to unit length, zero weights dropped.

    One shuffle by term for the document frequency and one by document for the length;
    both groups are shared out by Spark's skew handling when a term is everywhere.
    """
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.join(df, "term").withColumn(
        "w", F.col("tf") * F.log2(F.lit(float(documents)) / F.col("df"))).filter(F.col("w") != 0)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("w"))


def class_tfidf(counts: DataFrame, topics: DataFrame | None, documents: int) -> DataFrame:
    """(topic, term, weight): count / topic total · ln(N / total count of the term).

    ``topics`` is (doc_id, topic). Documents of a topic are never concatenated; their counts
    are added. Without ``topics`` the counts are those of topics already: (topic, term, tf).
    """
    if topics is None:
        per_topic = counts.select("topic", "term", F.col("tf").alias("c"))
    else:
        per_topic = counts.join(topics, "doc_id").groupBy("topic", "term").agg(F.sum("tf").alias("c"))
    topic_total = per_topic.groupBy("topic").agg(F.sum("c").alias("topic_c"))
    # a term has a row per topic, so its total is a window, not another aggregate and a join
    term_total = F.sum("c").over(Window.partitionBy("term"))
    return per_topic.withColumn("term_c", term_total).join(topic_total, "topic").select(
        "topic", "term",
        (F.col("c") / F.col("topic_c") * F.log(F.lit(float(documents)) / F.col("term_c"))).alias("weight"))


def top_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, word, weight): the n heaviest words per topic.

    Weights equal to nine digits are ties, ordered by word.
    """
    order = Window.partitionBy("topic").orderBy(F.round("weight", 9).desc(), "term")
    return weights.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= n).select("topic", "rank", F.col("term").alias("word"), "weight")


def word_table(words: DataFrame, topics: list) -> DataFrame:
    """Wide form: one row per rank, one column per topic."""
    return words.groupBy("rank").pivot("topic", topics).agg(F.first("word"))


def linear_combination(doc_topics: DataFrame, topic_terms: DataFrame) -> DataFrame:
    """(doc_id, term, w): Σ over topics of p(topic | doc) · weight(topic, term)."""
    return doc_topics.join(topic_terms, "topic").groupBy("doc_id", "term").agg(
        F.sum(F.col("p") * F.col("weight")).alias("w"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """Documents, vocabulary size and exact median document length in one row."""
    lengths = counts.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    left = lengths.agg(F.count("*").alias("documents"), F.median("len").alias("median_length"))
    right = counts.agg(F.count_distinct("term").alias("vocabulary"))
    one = F.lit(1)
    return left.withColumn("_k", one).join(right.withColumn("_k", one), "_k").drop("_k")


def dense_rows(weights: DataFrame, topics: int) -> DataFrame:
    """(doc_id, v): topic weights as an array of fixed length, zeros filled in.

    For topic-wide rows only; vocabulary-wide rows stay sparse.
    """
    pairs = F.map_from_entries(F.collect_list(F.struct("topic", "p")))
    return weights.groupBy("doc_id").agg(pairs.alias("m")).select(
        "doc_id",
        F.transform(F.sequence(F.lit(0), F.lit(topics - 1)),
                    lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("v"))


def sparse_rows(counts: DataFrame, terms: DataFrame, weight: str = "tf") -> DataFrame:
    """(doc_id, v): one struct<idx, val> per document, indices ascending."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("term_id").alias("t"), F.col(weight).cast("double").alias("w"))))
    return counts.join(terms.select("term", "term_id"), "term").groupBy("doc_id").agg(
        pairs.alias("l")).select("doc_id", F.struct(F.col("l.t").alias("idx"), F.col("l.w").alias("val")).alias("v"))
