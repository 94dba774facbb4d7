"""Composite rows: the ten-value layout evaluation and the stability row of a layout pair."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from steadymap.operators import classes, shape
from steadymap.operators.local import label_preservation, local_measures, neighborhood_hit
from steadymap.operators.pairs import pair_moments, pair_spearman
from steadymap.operators.pivots import Index
from steadymap.session import materialize, share

Measure = Callable[[DataFrame], DataFrame]
#: Names of the columns of a comparison.
STABILITY_COLUMNS = [
    "spearman_correlation", "pearson_correlation", "cluster_ordering", "rotation",
    "distance_consistency", "silhouette_coefficient", "trustworthiness", "continuity",
    "local_continuity", "mrre_missing", "mrre_false", "label_preservation",
]


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Join the measures; each part has one row per space and is planned on its own."""
    return reduce(lambda a, b: a.join(b, "space", "left"), map(share, parts))


def as_points(pairs: DataFrame) -> DataFrame:
    """Two layouts side by side (x1, y1, x2, y2) as vector columns v1, v2."""
    return pairs.select("space", "id", "label", F.array("x1", "y1").alias("v1"),
                        F.array("x2", "y2").alias("v2"))


def side(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.select("space", "id", "label", F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"))


def cluster_ordering(pairs: DataFrame) -> DataFrame:
    """Spearman of the distances between class centroids in both layouts."""
    cents = classes.centroids(pairs, "x1", "y1", "x2", "y2").select(
        "space", F.col("label").cast("long").alias("id"),
        F.array("c_x1", "c_y1").alias("v1"), F.array("c_x2", "c_y2").alias("v2"))
    return pair_spearman(cents).withColumnRenamed("spearman", "cluster_ordering")


def registry(k: int = 7) -> dict[str, Measure]:
    """The measures by name; each takes points (space, id, label, v1, v2) and gives one row per space."""
    local = lambda name: lambda points: local_measures(points, k).select("space", name)
    moments = lambda column, name: lambda points: pair_moments(points).select("space", F.col(column).alias(name))
    low = lambda points: points.select("space", "id", "label", F.col("v2").alias("v"))
    return {
        **{name: local(name) for name in ("trustworthiness", "continuity", "local_continuity", "mrre_missing", "mrre_false")},
        "label_preservation": lambda points: label_preservation(points, k),
        "pearson": moments("pearson", "pearson"), "normalized_stress": moments("stress", "normalized_stress"),
        "spearman": pair_spearman,
        "neighborhood_hit": lambda points: neighborhood_hit(low(points), k),
        "silhouette": lambda points: classes.silhouette(low(points)),
    }


def run_measures(points: DataFrame, measures: list[str | tuple[str, Measure]], k: int = 7) -> DataFrame:
    """(space, one column per measure): names from the ``registry``, or (name, the caller's function).

    A caller's function gives a row per space with the value in a column of that name; spaces it leaves out are NULL.
    """
    known = registry(k)
    parts = [points.select("space").distinct()]
    for measure in measures:
        name, function = (measure, known.get(measure)) if isinstance(measure, str) else measure
        if function is None:
            raise ValueError(f"unknown measure {name!r}")
        parts.append(function(points).select("space", name))
    return _merge(parts)


def absolute_difference(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """|metric(layout 1) - metric(layout 2)| per space."""
    other = right.withColumnRenamed(name, "_other")
    return left.join(other, "space").select(
        "space", F.abs(F.col(name) - F.col("_other")).alias(name))


def signed_difference(high: DataFrame, low: DataFrame, name: str) -> DataFrame:
    """metric(source space) - metric(projection) per space."""
    other = low.withColumnRenamed(name, "_other")
    return high.join(other, "space").select("space", (F.col(name) - F.col("_other")).alias(name))


def silhouette_difference(pairs: DataFrame) -> DataFrame:
    both = classes.silhouette(as_points(pairs), (("v1", "euclidean"), ("v2", "euclidean")),
                              ("s1", "s2"))
    return both.select("space", F.abs(F.col("s1") - F.col("s2")).alias("silhouette_coefficient"))


def stability_rows(pairs: DataFrame, k: int = 7, rotation_mode: str | None = "best") -> DataFrame:
    """The twelve stability measures for every comparison (``space``) in one batch.

    ``rotation_mode=None`` leaves the rotation NULL.
    """
    points = as_points(pairs)
    local = local_measures(points, k, index=Index())
    parts = [
        pair_moments(points).select("space", F.col("pearson").alias("pearson_correlation")),
        pair_spearman(points).select("space", F.col("spearman").alias("spearman_correlation")),
        cluster_ordering(pairs),
        absolute_difference(*(classes.distance_consistency(side(pairs, n)) for n in (1, 2)),
                            "distance_consistency"),
        silhouette_difference(pairs),
        local,
    ]
    if rotation_mode:
        parts.append(shape.procrustes(pairs, rotation_mode).select("space", "rotation"))
    out = _merge(parts)
    if not rotation_mode:
        out = out.withColumn("rotation", F.lit(None).cast("double"))
    return out.select("space", *STABILITY_COLUMNS)


def layout_scores(points: DataFrame, high_metric: str = "cosine", k: int = 7) -> DataFrame:
    """Ten-value evaluation: frames with space, id, label, v1 (source) and v2 (layout, 2-D)."""
    flat = points.select("space", "id", "label", F.col("v2")[0].alias("x"), F.col("v2")[1].alias("y"))
    low = points.select("space", "id", "label", F.col("v2").alias("v"))
    metrics = (high_metric, "euclidean")
    moments = pair_moments(points, metrics)
    return _merge([
        local_measures(points.drop("label"), k, metrics).select(
            "space", "trustworthiness", "continuity"),
        pair_spearman(points, metrics).select("space", F.col("spearman").alias("shepard")),
        moments.select("space", F.col("stress").alias("normalized_stress")),
        neighborhood_hit(low, k),
        classes.calinski_harabasz(flat),
        classes.silhouette(low),
        classes.davies_bouldin(flat),
        classes.s_dbw(flat),
        classes.distance_consistency(flat),
    ])


def reconstruction_mse(pairs: DataFrame, original: str = "v1", rebuilt: str = "v2") -> DataFrame:
    """Mean squared error over all components of all vectors, folded per row before the shuffle."""
    error = F.aggregate(F.zip_with(original, rebuilt, lambda a, b: (a - b) * (a - b)),
                        F.lit(0.0), lambda s, e: s + e)
    sums = pairs.groupBy("space").agg(F.sum(error).alias("s"), F.sum(F.size(original)).alias("m"))
    return sums.select("space", (F.col("s") / F.col("m")).alias("mse"))


def backfill(results: DataFrame, recomputed: DataFrame, column: str, keys: list[str],
             missing: float = -1.0) -> DataFrame:
    """Fill a missing metric column from ``recomputed``; ``missing`` where nothing is known."""
    fresh = recomputed.select(*keys, F.col(column).alias("_fresh"))
    old = F.col(column) if column in results.columns else F.lit(None).cast("double")
    return (
        results.join(fresh, keys, "left")
        .withColumn(column, F.coalesce(old, F.col("_fresh"), F.lit(missing)))
        .drop("_fresh"))


def sparse_class_sums(points: DataFrame, vector: str) -> DataFrame:
    """Centroids of sparse vectors: (space, label, idx, c) with c the class mean."""
    sizes = points.groupBy("space", "label").agg(F.count("*").alias("size"))
    long = points.select("space", "label", F.explode(
        F.arrays_zip(F.col(f"{vector}.idx").alias("idx"), F.col(f"{vector}.val").alias("val"))).alias("e"))
    sums = long.groupBy("space", "label", "e.idx").agg(F.sum("e.val").alias("s"))
    return sums.join(sizes, ["space", "label"]).select(
        "space", "label", "idx", (F.col("s") / F.col("size")).alias("c"))


def sparse_distance_consistency(points: DataFrame, vector: str) -> DataFrame:
    """Distance consistency in a sparse space: |x|² + |c|² - 2·x·c per point and class.

    The products come from an equi-join on the term; classes sharing no term with a point
    keep a product of zero. The row count is points x classes.
    """
    cents = materialize(sparse_class_sums(points, vector))
    norms = cents.groupBy("space", "label").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    per_space = norms.groupBy("space").agg(
        F.collect_list(F.struct(F.col("label").alias("other"), "cc")).alias("classes"))
    length = F.aggregate(f"{vector}.val", F.lit(0.0), lambda a, x: a + x * x)
    base = points.select("space", "id", "label", length.alias("xx")).join(per_space, "space").select(
        "space", "id", "label", "xx", F.explode("classes").alias("k")).select(
        "space", "id", "label", "xx", "k.other", "k.cc")
    long = points.select("space", "id", F.explode(
        F.arrays_zip(F.col(f"{vector}.idx").alias("idx"), F.col(f"{vector}.val").alias("val"))).alias("e")
    ).select("space", "id", "e.idx", "e.val")
    dots = long.join(cents.withColumnRenamed("label", "other"), ["space", "idx"]).groupBy(
        "space", "id", "other").agg(F.sum(F.col("val") * F.col("c")).alias("xc"))
    gap = F.round(F.col("xx") + F.col("cc") - 2 * F.coalesce("xc", F.lit(0.0)), 9)
    nearest = base.join(dots, ["space", "id", "other"], "left").groupBy("space", "id").agg(
        F.min(F.struct(gap.alias("g"), "other")).alias("best"), F.first("label").alias("label"))
    return nearest.groupBy("space").agg(
        F.avg((F.col("label") == F.col("best.other")).cast("double")).alias("distance_consistency"))


def sparse_cluster_ordering(points: DataFrame) -> DataFrame:
    sides = []
    for n, vector in ((1, "v1"), (2, "v2")):
        packed = F.array_sort(F.collect_list(F.struct("idx", "c")))
        sides.append(sparse_class_sums(points, vector).groupBy("space", "label").agg(
            packed.alias("l")).select(
            "space", F.col("label").cast("long").alias("id"),
            F.struct(F.col("l.idx").alias("idx"), F.col("l.c").alias("val")).alias(f"v{n}")))
    cents = materialize(sides[0].join(sides[1], ["space", "id"]))
    return pair_spearman(cents).withColumnRenamed("spearman", "cluster_ordering")


def corpus_similarity(points: DataFrame, k: int = 7) -> DataFrame:
    """Stability row of two sparse spaces of the same documents (v1, v2: struct<idx, val>).

    Distances are cosine; label preservation, silhouette and the class measures stay
    euclidean; there is no rotation.
    """
    cosine = ("cosine", "cosine")
    both = classes.silhouette(points, (("v1", "euclidean"), ("v2", "euclidean")), ("s1", "s2"))
    out = _merge([
        pair_moments(points, cosine).select("space", F.col("pearson").alias("pearson_correlation")),
        pair_spearman(points, cosine).select("space", F.col("spearman").alias("spearman_correlation")),
        sparse_cluster_ordering(points),
        absolute_difference(*(sparse_distance_consistency(points, v) for v in ("v1", "v2")),
                            "distance_consistency"),
        both.select("space", F.abs(F.col("s1") - F.col("s2")).alias("silhouette_coefficient")),
        local_measures(points.drop("label"), k, cosine),
        label_preservation(points, k),
    ])
    out = out.withColumn("rotation", F.lit(None).cast("double"))
    return out.select("space", *STABILITY_COLUMNS)
