"""Neighbourhood measures of a pair of layouts, all read off the same rank table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steadymap.operators.blocks import space_sizes
from steadymap.operators.neighbours import knn, neighbour_ranks
from steadymap.operators.pivots import Index


def _mrre_norm(n: Column, k: int) -> Column:
    return sum((F.abs(n - 2 * i + 1) / i for i in range(1, k + 1)), F.lit(0.0))


def local_measures(points: DataFrame, k: int = 7, metrics=("euclidean", "euclidean"),
                   block_rows: int | None = None, index: Index | None = None) -> DataFrame:
    """One row per space: trustworthiness, continuity, local_continuity, both MRRE values
    and, when the points carry a label, label_preservation.

    Space 1 (``v1``) is the original, space 2 (``v2``) the projection. Every share starts
    from the points, so a point whose neighbours all changed still counts. An ``index`` is for layouts in the plane.
    """
    ranks = neighbour_ranks(points, k, metrics, block_rows=block_rows, index=index)
    r1, r2 = F.col("r1"), F.col("r2")
    near1, near2 = r1 <= k, r2 <= k
    labelled = "label" in points.columns
    keys = ["space", "i"] + (["label_j"] if labelled else [])
    per_label = ranks.groupBy(*keys).agg(
        F.count_if(near1).alias("c1"),
        F.count_if(near2).alias("c2"),
        F.count_if(near1 & near2).alias("both"),
        F.sum(F.when(near2 & ~near1, r1 - k).otherwise(0)).alias("intruders"),
        F.sum(F.when(near1 & ~near2, r2 - k).otherwise(0)).alias("lost"),
        F.sum(F.when(near2, F.abs(r1 - r2) / r2).otherwise(0.0)).alias("e_false"),
        F.sum(F.when(near1, F.abs(r1 - r2) / r1).otherwise(0.0)).alias("e_missing"),
    )
    total = per_label.groupBy("space").agg(
        F.sum(F.least("c1", "c2")).alias("labels"),
        *[F.sum(c).alias(c) for c in ["both", "intruders", "lost", "e_false", "e_missing"]],
    )
    n = F.col("n")
    scale = F.lit(2.0) / (n * k * (2 * n - 3 * k - 1))
    out = [
        (1 - scale * F.col("intruders")).alias("trustworthiness"),
        (1 - scale * F.col("lost")).alias("continuity"),
        ((F.col("both") - n * (k * k) / (n - 1)) / (n * k)).alias("local_continuity"),
        (1 - F.col("e_missing") / (n * _mrre_norm(n, k))).alias("mrre_missing"),
        (1 - F.col("e_false") / (n * _mrre_norm(n, k))).alias("mrre_false"),
    ]
    if labelled:
        # the point itself is in both neighbourhoods; the measure takes it out again
        out.append((F.col("labels") / (n * k)).alias("label_preservation"))
    return total.join(space_sizes(points), "space").select("space", *out)


def label_preservation(points: DataFrame, k: int = 7, metrics=("euclidean", "euclidean"),
                       block_rows: int | None = None, index: Index | None = None) -> DataFrame:
    """Overlap of the neighbours' labels alone; needs no ranks beyond k.

    With an ``index`` only cells that can hold a neighbour are searched, as layouts in the plane should be.
    """
    sides = [
        knn(points.select("space", "id", "label", F.col(v).alias("v")), k, m,
            block_rows=block_rows, index=index).withColumn("side", F.lit(s))
        for s, (v, m) in enumerate(zip(("v1", "v2"), metrics))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy("space", "i", "label_j").agg(
        F.count_if(F.col("side") == 0).alias("c1"), F.count_if(F.col("side") == 1).alias("c2"))
    total = counts.groupBy("space").agg(F.sum(F.least("c1", "c2")).alias("labels"))
    return total.join(space_sizes(points), "space").select(
        "space", (F.col("labels") / (F.col("n") * k)).alias("label_preservation"))


def neighborhood_hit(points: DataFrame, k: int = 7, metric: str = "euclidean",
                     vector: str = "v", block_rows: int | None = None, index: Index | None = None) -> DataFrame:
    """Share of the k nearest, the point itself included, that carry the point's label."""
    near = knn(points, k - 1, metric, vector, block_rows, index)
    own = points.select("space", F.col("id").alias("i"), "label")
    hits = (
        near.join(own, ["space", "i"])
        .groupBy("space")
        .agg(F.count_if(F.col("label") == F.col("label_j")).alias("hits"))
    )
    n = F.col("n")
    return hits.join(space_sizes(points), "space").select(
        "space", ((F.col("hits") + n) / (n * k)).alias("neighborhood_hit"))
