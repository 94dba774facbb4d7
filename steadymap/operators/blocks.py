"""Pairwise work in square blocks.

Points are hashed into blocks of bounded size and every pair of blocks becomes one group
of a single shuffle, so one task never holds more than two blocks, whatever the size of
the largest space. Callers emit aggregates or the k best per row.

A points frame has ``space`` (any groupable key), ``id`` (long), vector columns
(``array<double>`` or ``struct<idx, val>``) and optional carried columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from steadymap.session import parallelism

SMALL_SPACE, SMALL_BLOCK, BLOCK = 8192, 512, 2048
WIDE_SPACE, VALUES = 16, 1 << 22  # blocks of a large space; numbers in a block of dense vectors
_ROW, _COL, _BOTH, _EXTRA = 0, 1, 2, 3
CELLS = 1 << 20  # distances held at once inside a block pair


def space_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("space").agg(F.count("*").alias("n"))


def _sizes(points: DataFrame, block_rows: int | None) -> DataFrame:
    """Blocks per space. Sixteen blocks of dense vectors are enough for a space of any size, as far as a block has at
    most ``VALUES`` numbers: a point is sent to every block, so more blocks would send more than the input grows."""
    if block_rows:
        return space_sizes(points).select("space", F.ceil(F.col("n") / block_rows).cast("int").alias("_nb"))
    kinds = [f.dataType.typeName() for f in points.schema.fields if f.name != "space"]
    dense = [f.name for f in points.schema.fields if f.dataType.simpleString() == "array<double>" and "__" not in f.name]
    sizes = points.groupBy("space").agg(F.count("*").alias("n"), F.max(sum((F.size(c) for c in dense), F.lit(0))).alias("_w"))
    largest = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("n") / WIDE_SPACE), F.floor(VALUES / F.greatest("_w", F.lit(1)))))
    if not dense or "struct" in kinds or any("__" in f.name for f in points.schema.fields):
        largest = F.lit(BLOCK)
    rows = F.when(F.col("n") <= SMALL_SPACE, SMALL_BLOCK).otherwise(largest)
    return sizes.select("space", F.ceil(F.col("n") / rows).cast("int").alias("_nb"))


def flat_vectors(points: DataFrame) -> DataFrame:
    """Sparse vectors travel as two array columns, which reach numpy without row objects."""
    out = []
    for f in points.schema.fields:
        if f.dataType.typeName() == "struct" and f.dataType.names == ["idx", "val"]:
            out += [F.col(f"{f.name}.{part}").alias(f"{f.name}__{part}") for part in ("idx", "val")]
        else:
            out.append(F.col(f.name))
    return points.select(*out)


def pair_blocks(
    points: DataFrame,
    fn,
    schema: str,
    half: bool = False,
    block_rows: int | None = None,
    per_space: DataFrame | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Run ``fn(space, left, right, extra)`` on every pair of blocks.

    ``half`` visits each unordered pair of blocks once. ``per_space`` is a frame with one
    row per space whose columns reach ``fn`` as ``extra``; it travels once per block pair.
    ``sized_by`` names the frame to count when ``points`` itself is costly to compute.
    """
    points = flat_vectors(points)
    sizes = _sizes(points if sized_by is None else sized_by, block_rows)
    hashed = F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int")
    blocked = points.join(sizes, "space").withColumn("_blk", hashed)
    blk, nb = F.col("_blk"), F.col("_nb")
    spread = F.sequence(blk if half else F.lit(0), nb - 1)
    as_row = F.transform(spread, lambda c: F.struct(
        blk.alias("_rb"), c.alias("_cb"), F.when(c == blk, _BOTH).otherwise(_ROW).alias("_role")))
    spread = F.filter(F.sequence(F.lit(0), blk if half else nb - 1), lambda r: r != blk)
    as_col = F.transform(spread, lambda r: F.struct(
        r.alias("_rb"), blk.alias("_cb"), F.lit(_COL).alias("_role")))
    sent = blocked.select(*points.columns, F.explode(F.concat(as_row, as_col)).alias("_p")).select(
        *points.columns, "_p.*")
    extras: list[str] = []
    if per_space is not None:
        extras = [c for c in per_space.columns if c != "space"]
        first = F.lit(0) if not half else F.col("_r")
        grid = (
            sizes.withColumn("_r", F.explode(F.sequence(F.lit(0), nb - 1)))
            .withColumn("_c", F.explode(F.sequence(first, nb - 1)))
        )
        marks = grid.select("space", F.col("_r").alias("_rb"), F.col("_c").alias("_cb"),
                            F.lit(_EXTRA).alias("_role")).join(per_space, "space")
        sent = sent.unionByName(marks, allowMissingColumns=True)

    keys = ["space", "_rb", "_cb"]

    def run(key, pdf):
        role = pdf["_role"].to_numpy()
        marks = pdf[role == _EXTRA]
        extra = marks.iloc[0] if len(marks) else None
        left = pdf[(role == _ROW) | (role == _BOTH)]
        right = pdf[(role == _COL) | (role == _BOTH)]
        if not len(left) or not len(right):
            return pd.DataFrame()
        left, right = (
            side.assign(id=side["id"].astype("int64")).sort_values("id", ignore_index=True)
            for side in (left, right)
        )
        return fn(key, left, right, extra)

    return sent.repartition(parallelism(points), *keys).groupBy(*keys).applyInPandas(run, schema)


def row_chunks(n_rows: int, n_cols: int):
    """Row ranges whose distances fit into ``CELLS``."""
    step = max(1, CELLS // max(n_cols, 1))
    for lo in range(0, n_rows, step):
        yield slice(lo, min(lo + step, n_rows))
