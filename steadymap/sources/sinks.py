"""Outputs. Tables are written by the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steadymap.plans.comparisons import unfinished
from steadymap.plans.grid import finished_runs, open_runs
from steadymap.session import work_folder


def write_layout_scores(scores: DataFrame, path: str) -> None:
    """One folder per dataset and run; rerunning a run replaces its folder only."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "dataset", "run_id").parquet(path)


def append_comparisons(batch: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows of a batch whose key is not stored yet; returns how many were new."""
    spark = batch.sparkSession
    if exists(spark, path):
        batch = unfinished(batch, spark.read.parquet(path), keys)
    batch = batch.persist()
    new = batch.count()
    if new:
        batch.write.mode("append").parquet(path)
    batch.unpersist()
    return new


def append_model_score(score: DataFrame, path: str) -> None:
    score.write.mode("append").parquet(path)


def write_topic_words(words: DataFrame, path: str) -> None:
    """Long form: topic, word, weight, strongest first."""
    words.orderBy("topic", "rank").select(
        F.col("topic").alias("topic_num"), "word", F.col("weight").alias("prob")).write.mode(
        "overwrite").option("header", True).csv(path)


def write_layout(layout: DataFrame, labels: DataFrame, path: str) -> None:
    """x, y, classes (and the rotated x_new, y_new when present) per point."""
    extra = [c for c in ("x_new", "y_new") if c in layout.columns]
    layout.join(labels, "point_id").orderBy("point_id").select(
        "x", "y", F.col("y_label").alias("classes"), *extra).write.mode("overwrite").option(
        "header", True).csv(path)


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", order: list[str] | None = None) -> None:
    """Final tables and coverage reports, sorted inside the files when asked for."""
    rows = rows.sortWithinPartitions(*order) if order else rows
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def emit_runs(runs: DataFrame, finished: DataFrame, todo: str, done: str) -> None:
    open_runs(runs, finished).write.mode("overwrite").parquet(todo)
    finished_runs(runs, finished).write.mode("overwrite").parquet(done)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached_tokens(docs: DataFrame, build, key: str, folder: str | None = None) -> DataFrame:
    """Token lists written once under the corpus fingerprint and read back afterwards."""
    spark = docs.sparkSession
    path = f"{folder or work_folder(spark)}/tokens-{key}"
    if not exists(spark, path + "/_SUCCESS"):
        build(docs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
