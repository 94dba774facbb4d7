"""Layouts, labels and metric tables on disk."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from steadymap.functions.naming import run_jitter, run_seed


def _files(spark, root, pattern):
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root))


def layout_paths(spark: SparkSession, root: str) -> DataFrame:
    """Array files that are not labels and whose picture exists next to them: (path, stem)."""
    arrays = _files(spark, root, "*.npy").select("path")
    arrays = arrays.filter(~F.endswith("path", F.lit("y.npy"))).withColumn(
        "stem", F.regexp_replace("path", r"\.npy$", ""))
    pictures = _files(spark, root, "*.png").select(F.regexp_replace("path", r"\.png$", "").alias("stem"))
    return arrays.join(pictures, "stem", "left_semi").select("path", "stem")


def _rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """One row per array row; every file is decoded inside its own task."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                values = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                values = values.reshape(len(values), -1)
                if values.shape[1] != len(columns):
                    raise ValueError(f"{path} has {values.shape[1]} columns, not {len(columns)}")
                out = pd.DataFrame(values.astype("float64"), columns=columns)
                out.insert(0, "point_id", np.arange(len(out)))
                out.insert(0, "path", path)
                yield out

    schema = "path string, point_id long, " + ", ".join(f"{c} double" for c in columns)
    return files.select("path", "content").mapInPandas(run, schema)


def read_layouts(spark: SparkSession, root: str) -> DataFrame:
    """(path, point_id, x, y, seed, jitter) of all layouts below a folder."""
    files = _files(spark, root, "*.npy").join(layout_paths(spark, root).select("path"), "path", "left_semi")
    return _rows(files, ["x", "y"]).withColumns(
        {"seed": run_seed(F.col("path")), "jitter": run_jitter(F.col("path"))})


def label_paths(spark: SparkSession, root: str, constant: bool = True) -> DataFrame:
    """Label files: ``y.npy`` itself or ``<stem>_y.npy`` with a table next to it; only the first
    when labels are constant."""
    files = _files(spark, root, "*y.npy").select("path")
    tables = _files(spark, root, "*.csv").select(F.regexp_replace("path", r"\.csv$", "").alias("stem"))
    own = files.filter(F.endswith("path", F.lit("/y.npy")))
    stem = files.withColumn("stem", F.regexp_replace("path", r"_y\.npy$", ""))
    paths = own.union(stem.join(tables, "stem", "left_semi").select("path")).distinct()
    return paths.orderBy("path").limit(1) if constant else paths


def read_labels(spark: SparkSession, root: str, constant: bool = True) -> DataFrame:
    files = _files(spark, root, "*y.npy").join(label_paths(spark, root, constant), "path", "left_semi")
    return _rows(files, ["y"]).select("path", "point_id", F.col("y").cast("int").alias("y"))


def read_metric_tables(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric CSVs of a folder with the file each row came from."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn("source_file", F.input_file_name())
