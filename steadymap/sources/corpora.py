"""Text corpora as (doc_id, text, category) frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from steadymap.operators.text import single_category


def _numbered(rows: DataFrame, order: Column) -> DataFrame:
    """Stable ids: a hash of the row's place, equal for every run over the same files."""
    return rows.withColumn("doc_id", F.xxhash64(order))


def _placed(rows: DataFrame) -> DataFrame:
    """Ids from a row's file and its place in that file, so that equal rows stay different documents.

    Files with quoted line ends are read whole by one task, so the place does not depend on how files are packed.
    """
    seen = rows.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return _numbered(seen.withColumn("_place", place), F.concat_ws("|", "_file", "_place")).drop("_file", "_at", "_place")


def _decoded(files: DataFrame, charset: str) -> DataFrame:
    if charset.lower() in ("utf-8", "utf8"):
        return files.withColumn("text", F.decode("content", "UTF-8")).drop("content")

    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(charset, errors="replace"))

    return files.withColumn("text", F.pandas_udf(decode, "string")("content")).drop("content")


def directory_corpus(spark: SparkSession, root: str, charset: str = "windows-1252",
                     pattern: str = "*") -> DataFrame:
    """One file per document; the category is the first directory below the root.

    Works for one or two directory levels. Undecodable bytes are replaced, never dropped.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root).select("path", "content"))
    base = root.rstrip("/").split("/")[-1]
    below = F.regexp_extract("path", rf"/{base}/(.+)$", 1)
    named = files.withColumn("below", below).withColumn("category", F.split("below", "/")[0])
    named = named.filter(F.contains("below", F.lit("/")))
    return _numbered(_decoded(named, charset), F.col("below")).select("doc_id", "text", "category")


def _csv(spark, path, schema, header, sep=","):
    return (
        spark.read.schema(schema).option("header", header).option("sep", sep).option("quote", '"')
        .option("escape", '"').option("multiLine", "true").csv(path))


def ecommerce(spark: SparkSession, path: str) -> DataFrame:
    """No header; category, text, both trimmed."""
    rows = _csv(spark, path, "category string, text string", False)
    rows = rows.select(F.trim("category").alias("category"), F.trim("text").alias("text"))
    return _placed(rows).select("doc_id", "text", "category")


def titled_news(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """Tab-separated category, title, content; the text is title and content."""
    head = spark.read.option("header", True).option("sep", "\t").option("multiLine", "true").csv(path)
    rows = head.select(F.concat_ws(separator, "title", "content").alias("text"), "category")
    return _placed(rows).select("doc_id", "text", "category")


def lyrics(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, "lyrics string, genere string", True)
    rows = rows.select(F.col("lyrics").alias("text"), F.col("genere").alias("category"))
    return _placed(rows).select("doc_id", "text", "category")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header text, label."""
    rows = _csv(spark, path, "text string, label string", True)
    return _placed(rows).select(
        "doc_id", "text", F.col("label").alias("category"))


def without_footer(text: Column) -> Column:
    """The text up to its last line of nothing but dashes and white space; the whole text if there is none or it is the first."""
    lines = F.split(F.regexp_replace(text, r"\A\s+|\s+\z", ""), "\n", -1)
    from_end = F.array_position(F.reverse(F.transform(lines, lambda x: x.rlike(r"\A\s*-*\s*\z"))), True)
    at = F.size(lines) - from_end
    return F.when((from_end > 0) & (at > 0), F.array_join(F.slice(lines, F.lit(1), at.cast("int")), "\n")).otherwise(text)


def newsgroups(spark: SparkSession, path: str, bare: bool = False) -> DataFrame:
    """A landed table (doc_id, text, category); ``bare`` strips headers, footers and quoted lines."""
    rows = spark.read.parquet(path).select("doc_id", "text", "category")
    if not bare:
        return rows
    body = without_footer(F.regexp_replace("text", r"(?s)\A.*?\n\n", ""))
    body = F.regexp_replace(body, r"(?m)^(>|\|).*$\n?", "")
    return rows.withColumn("text", body)


def tagged_news(parts: DataFrame) -> DataFrame:
    """(file_id, category, pos, word) rows -> documents with exactly one category."""
    return single_category(parts, "file_id", "category", "word", "pos")


READERS = {
    "emails": directory_corpus,
    "seven_categories": lambda spark, path: directory_corpus(spark, path, "utf-8"),
    "ecommerce": ecommerce, "bbc_news": titled_news, "lyrics": lyrics, "ag_news": labelled_csv,
    "20_newsgroups": newsgroups,
}


def read_corpus(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"unknown dataset {name!r}")
    return READERS[name](spark, path)
