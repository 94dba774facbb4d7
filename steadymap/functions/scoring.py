"""Combined scores of a stability row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def alpha():
    local = F.col("trustworthiness") + F.col("continuity") + F.col("mrre_missing") + F.col("mrre_false")
    return (0.25 * local + F.col("label_preservation") + F.col("local_continuity")) / 3.0


def beta():
    unit = lambda c: 0.5 * (F.col(c) + 1)
    pair = 0.5 * (unit("pearson_correlation") + unit("spearman_correlation"))
    return 0.5 * (pair + unit("cluster_ordering"))


def gamma():
    return 1 - F.col("distance_consistency")


def combined_scores(rows: DataFrame) -> DataFrame:
    """Local structure (alpha), global structure (beta), class separation (gamma)."""
    return rows.withColumns({"alpha": alpha(), "beta": beta(), "gamma": gamma()})
