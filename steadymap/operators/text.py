"""From documents to token lists. Corpora are (doc_id, text, category) frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from steadymap.functions import words
from steadymap.operators.order import number_rows
from steadymap.session import share


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("tokens", words.tokens(F.col(text))).drop(text)


def preprocess(docs: DataFrame, min_length: int = 3, stop: list[str] | None = None,
               lemmas: DataFrame | None = None) -> DataFrame:
    """Tokens without stop words, lemmatised if a (form, lemma) table is given, longer than
    ``min_length``; documents left with at most one token are dropped."""
    out = tokenize(docs)
    out = out.withColumn(
        "tokens", words.without(F.col("tokens"), words.STOP_WORDS if stop is None else stop))
    if lemmas is not None:
        out = lemmatize(out, lemmas)
    out = out.withColumn("tokens", words.longer_than(F.col("tokens"), min_length))
    return drop_short(out)


def drop_short(docs: DataFrame) -> DataFrame:
    return docs.filter(F.size("tokens") > 1)


def lemmatize(docs: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace forms by lemmas; the order inside a document is kept."""
    long = docs.select("doc_id", F.posexplode("tokens").alias("pos", "form"))
    named = long.join(lemmas.select("form", "lemma"), "form", "left")
    lists = named.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "form").alias("t")))).alias("l"))
    return docs.join(lists, "doc_id", "left").withColumn(
        "tokens", F.coalesce(F.col("l.t"), F.array().cast("array<string>"))).drop("l")


def label_codes(docs: DataFrame, first_appearance: bool = False) -> DataFrame:
    """(category, y): codes in sorted order, or in the order of each category's first document.

    The window runs over the distinct categories only.
    """
    cats = docs.groupBy("category").agg(F.min("doc_id").alias("first"))
    order = ["first"] if first_appearance else ["category"]
    return cats.select("category", (F.row_number().over(Window.orderBy(*order)) - 1).alias("y"))


def encode_labels(docs: DataFrame, first_appearance: bool = False) -> DataFrame:
    return docs.join(label_codes(docs, first_appearance), "category")


def single_category(parts: DataFrame, key: str, category: str, text: str, order: str) -> DataFrame:
    """Documents made of parts: keep those with exactly one category, text joined in order."""
    grouped = parts.groupBy(key).agg(
        F.collect_set(category).alias("cats"),
        F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
    return grouped.filter(F.size("cats") == 1).select(
        F.col(key).alias("doc_id"), F.array_join(F.col(f"parts.{text}"), " ").alias("text"),
        F.col("cats")[0].alias("category"))


def largest_classes(docs: DataFrame, k: int, column: str = "category") -> DataFrame:
    """Documents of the k most frequent classes; equal counts by name."""
    sizes = docs.groupBy(column).agg(F.count("*").alias("_n"))
    keep = sizes.orderBy(F.desc("_n"), column).limit(k).select(column)
    return docs.join(F.broadcast(keep), column, "left_semi")  # k rows


def word_index(token_lists: DataFrame, min_count: int = 1) -> DataFrame:
    """(term, idx): terms numbered from 1 by falling frequency, then by term.

    Rare frequencies are shared by most terms, so the first two letters split them into ranges.
    """
    counts = token_lists.select(F.explode("tokens").alias("term")).groupBy("term").agg(
        F.count("*").alias("cf")).filter(F.col("cf") >= min_count)
    letters = F.ascii("term") * F.lit(2.0 ** 21) + F.ascii(F.substring("term", 2, 1))
    numbered = number_rows(share(counts), letters / F.lit(2.0 ** 42) - F.col("cf"), ["term"], "idx")
    return numbered.select("term", (F.col("idx") + 1).alias("idx"), "cf")


def encode(token_lists: DataFrame, index: DataFrame, offset: int = 3, unknown: int = 2) -> DataFrame:
    """Token lists as integer codes: index + offset, ``unknown`` for terms outside the index."""
    long = token_lists.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    code = F.coalesce(F.col("idx") + offset, F.lit(unknown))
    return long.join(index.select("term", "idx"), "term", "left").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", code.alias("c")))).alias("l")).select(
        "doc_id", F.col("l.c").alias("codes"))


def decode(encoded: DataFrame, index: DataFrame, offset: int = 3) -> DataFrame:
    """Integer codes back to text; codes without a word become '?'."""
    long = encoded.select("doc_id", F.posexplode("codes").alias("pos", "c")).withColumn(
        "idx", F.col("c") - offset)
    word = F.coalesce("term", F.lit("?"))
    return long.join(index.select("idx", "term"), "idx", "left").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))).alias("l")).select(
        "doc_id", F.array_join(F.col("l.w"), " ").alias("text"))
