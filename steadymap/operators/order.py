"""Row numbers over a whole table without a single-partition window.

The order is cut into key ranges; rows are numbered inside a range and shifted by the
counts of the ranges before it. Only the range counts pass through one task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadymap.session import parallelism


def number_rows(df: DataFrame, key: Column, ties: list[str], out: str, within: list[str] = (),
                ranges: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position by (key, ties), inside ``within`` if given.

    ``key`` is numeric and should have many distinct values. ``df`` is read three times;
    share it first when it is costly.
    """
    ranges = ranges or min(4 * parallelism(df), 4096)
    keyed = df.withColumn("_key", key.cast("double"))
    probs = [n / ranges for n in range(1, ranges)]
    cuts = keyed.agg(F.percentile_approx("_key", probs, 10000).alias("c")).first()["c"] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    split = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(keyed)
    within = list(within)
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        split.groupBy(*within, "_range").agg(F.count("*").alias("_c"))
        .withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .drop("_c"))
    inside = Window.partitionBy(*within, "_range").orderBy("_key", *ties)
    return (
        split.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(starts, [*within, "_range"])
        .withColumn(out, (F.col("_start") + F.col("_pos")).cast("long"))
        .drop("_key", "_range", "_pos", "_start"))


def hash_key(*parts) -> Column:
    """A uniform number in [0, 2^48) from the md5 of the ':'-joined parts; seeds go in as parts."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """A uniform double in [0, 1) from the same hash."""
    return hash_key(*parts) / F.lit(float(1 << 48))
