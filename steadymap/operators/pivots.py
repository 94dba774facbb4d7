"""Exact nearest neighbours through a pivot index.

Pivots are points far from each other; every point belongs to the cell of its nearest pivot, and a cell
knows its radius. Distances to pivots and to the points of the own block give every point a bound within which
its k neighbours lie. A cell is visited only by points for which the triangle inequality leaves room:
d(x, y) >= d(x, p) - radius and d(x, y) >= (d(x, p) - d(x, own pivot)) / 2 for every y in the cell of p.
Results are those of the block search, ties included; only cells that cannot hold a neighbour are left out.

Cosine distances go through the chord of the unit vectors, sqrt(2 d), for which the inequality holds.
Jensen-Shannon distances are roots of a divergence and obey it as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from steadymap.functions.distance import BlockDistance, SparseBlock, stack
from steadymap.operators.blocks import BLOCK, flat_vectors, row_chunks
from steadymap.session import materialize, parallelism


@dataclass(frozen=True)
class Index:
    """``cell``: points a cell should have; ``pivots``: at most so many a space; ``sample``: points that pivots are chosen from, per pivot;
    ``cells``: numbers the pivots of all spaces may have together, as they are broadcast."""

    cell: int = 512
    pivots: int = 1024
    sample: int = 8
    cells: int = 1 << 24


def _length(d: np.ndarray, metric: str) -> np.ndarray:
    """A distance for which the triangle inequality holds."""
    return np.sqrt(2.0 * np.maximum(d, 0.0)) if metric == "cosine" else d


def _slack(dist: BlockDistance, metric: str) -> float:
    """How far a computed length may be off: products are exact to ``tol``, and roots magnify that near zero."""
    return 2e-4 if metric == "cosine" else 2.0 * dist.tol + 1e-9


def _take(block, rows):
    return SparseBlock([block.idx[r] for r in rows], [block.val[r] for r in rows]) if isinstance(block, SparseBlock) else block[rows]


def spread_pivots(block, metric: str, count: int) -> list[int]:
    """Farthest-first: each next pivot is the row farthest from all before; rows without a finite distance are left out."""
    far, chosen = None, []
    with np.errstate(invalid="ignore"):
        fine = np.flatnonzero(np.isfinite(np.concatenate([BlockDistance(_take(block, [r]), _take(block, [r]), metric).matrix()[0] for r in range(len(block))])))
    if not len(fine):
        return []
    now = int(fine[0])
    while len(chosen) < min(count, len(fine)):
        chosen.append(now)
        d = BlockDistance(_take(block, [now]), block, metric).matrix()[0]
        far = d if far is None else np.minimum(far, d)
        now = int(fine[np.argmax(far[fine])])
        if far[now] <= 0:
            break
    return chosen


def choose(points: DataFrame, metric: str, vector: str, index: Index) -> pd.DataFrame | None:
    """space, pivot and its vector columns; None if they would be too many to broadcast."""
    flat = flat_vectors(points)
    sizes = points.groupBy("space").agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(index.pivots), F.ceil(F.col("n") / index.cell)).cast("int").alias("wanted")
    vectors = [c for c in flat.columns if c == vector or c.startswith(f"{vector}__")]
    sized = flat.join(sizes.select("space", "n", wanted), "space")
    every = F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("wanted") * index.sample)))
    # a hashed sample of about ``sample`` points a pivot
    some = sized.where(F.pmod(F.xxhash64(F.lit("pivot"), "id"), every) == 0).select("space", "id", "wanted", *vectors)
    kinds = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in vectors)

    def run(key, pdf):
        pdf = pdf.sort_values("id", ignore_index=True)
        chosen = spread_pivots(stack(pdf, vector), metric, int(pdf["wanted"].iloc[0]))
        out = pdf.iloc[chosen][vectors].reset_index(drop=True)
        return out.assign(space=[key[0]] * len(chosen), pivot=np.arange(len(chosen)))[["space", "pivot", *vectors]]

    picked = some.groupBy("space").applyInPandas(run, f"space {points.schema['space'].dataType.simpleString()}, pivot int, {kinds}")
    picked = materialize(picked)
    width = sum((F.size(c) for c in vectors), F.lit(0))
    if (picked.agg(F.sum(width)).first()[0] or 0) > index.cells:
        return None
    return picked.orderBy("space", "pivot").toPandas()


def _by_space(pivots: pd.DataFrame, vector: str) -> dict:
    return {s: stack(g.reset_index(drop=True), vector) for s, g in pivots.groupby("space", sort=False)}


def _cells(points: DataFrame, pivots, metric: str, vector: str) -> DataFrame:
    """Points with their cell and their length to its pivot; points without a finite distance have no cell and go."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields) + ", cell int, reach double"

    def run(batches):
        known = _by_space(pivots.value, vector)
        for pdf in batches:
            for space, part in pdf.groupby("space", sort=False):
                part = part.reset_index(drop=True)
                block = stack(part, vector)
                cell, reach = np.zeros(len(part), "int32"), np.full(len(part), np.inf)
                for rows in row_chunks(len(part), len(known[space]) if space in known else 1):
                    if space not in known:
                        continue
                    d = _length(BlockDistance(_take(block, range(*rows.indices(len(part)))), known[space], metric).matrix(), metric)
                    d = np.where(np.isnan(d), np.inf, d)
                    cell[rows], reach[rows] = d.argmin(axis=1), d.min(axis=1)
                fine = np.isfinite(reach)
                yield part.assign(cell=cell, reach=reach)[fine]

    return points.mapInPandas(run, schema)


def search(points: DataFrame, k: int, metric: str = "euclidean", vector: str = "v", index: Index = Index()):
    """((space, i, js, ds[, ls]) lists to be merged, visits) or None if the pivots are too many to broadcast.

    ``visits``: space, points, cells, visited (point and cell pairs), possible (all such pairs).
    """
    from steadymap.operators.neighbours import best_lists

    spark, labelled = points.sparkSession, "label" in points.columns
    chosen = choose(points, metric, vector, index)
    if chosen is None:
        return None
    pivots = spark.sparkContext.broadcast(chosen)
    flat = flat_vectors(points.select("space", "id", vector, *(["label"] if labelled else [])))
    placed = materialize(_cells(flat, pivots, metric, vector))
    stats = placed.groupBy("space", "cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # one row a pivot, as bounded as the pivots are
    cells = spark.sparkContext.broadcast(stats.toPandas())
    space = points.schema["space"].dataType.simpleString()
    label = points.schema["label"].dataType.simpleString() if labelled else None
    lists = "js array<long>, ds array<double>" + (f", ls array<{label}>" if labelled else "")
    own = placed.join(stats.select("space", "cell", "blocks"), ["space", "cell"]).withColumn(
        "blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def at_home(key, pdf):
        """Neighbours in the own block, the bound they and the pivots give, and the cells inside it."""
        pdf = pdf.sort_values("id", ignore_index=True)
        block, ids = stack(pdf, vector), pdf["id"].to_numpy()
        known, stat = _by_space(pivots.value, vector)[key[0]], cells.value
        stat = stat[stat["space"] == key[0]]
        radius = np.full(len(known), -np.inf)
        radius[stat["cell"]] = stat["radius"]
        out = []
        for rows in row_chunks(len(pdf), max(len(pdf), len(known))):
            part = _take(block, range(*rows.indices(len(pdf))))
            dist = BlockDistance(part, block, metric)
            got = best_lists(dist, ids[rows], ids, k, pdf["label"].to_numpy() if labelled else None)
            bound = np.array([_length(d[k - 1], metric) if len(d) >= k else np.inf for d in got["ds"]])
            to = BlockDistance(part, known, metric)
            d = _length(to.matrix(), metric)
            # pivots are points of other cells or of the own one: k + 1 of them, one may be the point itself, bound as well
            if len(known) > k + 1:
                bound = np.minimum(bound, np.partition(d, k + 1, axis=1)[:, k + 1])
            mine = d[:, int(key[1])][:, None]
            room = np.maximum(d - radius[None, :], (d - mine) / 2.0) <= bound[:, None] + 2.0 * _slack(to, metric)
            room &= np.isfinite(radius)[None, :]
            out.append(pd.DataFrame({"space": [key[0]] * len(ids[rows]), "id": ids[rows], "own": int(key[1]), "blk": int(key[2]), "bound": bound,
                                     "visits": [np.flatnonzero(x) for x in room], **got}))
        return pd.concat(out)

    asked = materialize(own.groupBy("space", "cell", "blk").applyInPandas(
        at_home, f"space {space}, id long, own int, blk int, bound double, visits array<int>, {lists}"))
    each = asked.select("space", "id", "own", F.col("blk").alias("home"), "bound", F.explode("visits").alias("cell"))
    # a cell with many visitors meets them in groups, one with many points in blocks
    groups = each.groupBy("space", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups")).join(
        stats.select("space", "cell", "blocks"), ["space", "cell"])
    seek = each.join(groups, ["space", "cell"]).select(
        "space", "id", "cell", F.pmod(F.xxhash64("id", F.lit(1)), "groups").cast("int").alias("grp"),
        F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: ~((F.col("cell") == F.col("own")) & (b == F.col("home"))))).alias("blk"))
    vectors = [c for c in flat.columns if c == vector or c.startswith(f"{vector}__")]
    kept = vectors + (["label"] if labelled else [])
    visitors = seek.join(placed.select("space", "id", *kept), ["space", "id"]).withColumn("visitor", F.lit(True))
    members = own.join(groups.select("space", "cell", "groups"), ["space", "cell"]).select(
        "space", "id", "cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "blk", *kept, F.lit(False).alias("visitor"))

    def away(key, pdf):
        come, there = pdf[pdf["visitor"]], pdf[~pdf["visitor"]].sort_values("id", ignore_index=True)
        if not len(come) or not len(there):
            return pd.DataFrame()
        come = come.reset_index(drop=True)
        a, b, ids = stack(come, vector), stack(there, vector), come["id"].to_numpy()
        out = []
        for rows in row_chunks(len(come), len(there)):
            dist = BlockDistance(_take(a, range(*rows.indices(len(come)))), b, metric)
            got = best_lists(dist, ids[rows], there["id"].to_numpy(), k, there["label"].to_numpy() if labelled else None)
            out.append(pd.DataFrame({"space": [key[0]] * len(ids[rows]), "i": ids[rows], **got}))
        return pd.concat(out)

    keys = ["space", "cell", "grp", "blk"]
    found = visitors.unionByName(members).repartition(parallelism(points), *keys).groupBy(*keys).applyInPandas(
        away, f"space {space}, i long, {lists}")
    names = ["js", "ds"] + (["ls"] if labelled else [])
    both = asked.select("space", F.col("id").alias("i"), *names).unionByName(found)
    count = asked.groupBy("space").agg(F.count("*").alias("points"), F.sum(F.size("visits")).alias("visited"))
    visits = count.join(stats.groupBy("space").agg(F.count("*").alias("cells")), "space").select(
        "space", "points", "cells", "visited", (F.col("points") * F.col("cells")).alias("possible"))
    return both, visits


def pivot_knn(points: DataFrame, k: int = 7, metric: str = "euclidean", vector: str = "v", index: Index = Index()) -> DataFrame | None:
    """(space, i, j, d, r): the k nearest other points of every point, as ``neighbours.knn`` has them."""
    from steadymap.operators.neighbours import merged

    got = search(points, k, metric, vector, index)
    return None if got is None else merged(got[0], k, "label" in points.columns)


def visited(points: DataFrame, k: int = 7, metric: str = "euclidean", vector: str = "v", index: Index = Index()) -> DataFrame:
    """space, points, cells, visited and possible pairs of points and cells."""
    return search(points, k, metric, vector, index)[1]
