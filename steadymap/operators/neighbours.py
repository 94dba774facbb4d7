"""Exact k-nearest neighbours and exact neighbour ranks, ordered by (distance, id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from steadymap.functions.distance import BlockDistance, SparseBlock, count_closer, nearest, others, stack
from steadymap.operators import boxes, pivots
from steadymap.operators.blocks import pair_blocks, row_chunks
from steadymap.operators.boxes import Boxes
from steadymap.operators.pivots import Index
from steadymap.session import materialize, parallelism


def _part(block, rows: slice):
    return block.slice(rows.start, rows.stop) if isinstance(block, SparseBlock) else block[rows]


def distances(left, right, vectors):
    """Yield (row slice, [BlockDistance per vector column]) over row chunks of a block pair."""
    sides = [(stack(left, c), stack(right, c), m) for c, m in vectors]
    for rows in row_chunks(len(left), len(right)):
        yield rows, [BlockDistance(_part(a, rows), b, m) for a, b, m in sides]


def _candidates(points, vectors, k, block_rows):
    """k best per row, block pair and vector column, with the distances in every column."""
    labelled = "label" in points.columns

    def run(key, left, right, _):
        col_ids = right["id"].to_numpy()
        out = []
        for rows, dists in distances(left, right, vectors):
            row_ids = left["id"].to_numpy()[rows]
            full = [dist.matrix() for dist in dists]
            for side, dist in enumerate(dists):
                r, c, d = nearest(dist, full[side], row_ids, col_ids, k)
                part = {"space": key[0], "i": row_ids[r], "side": side, "j": col_ids[c]}
                for other, o in enumerate(dists):
                    there = o.exact if o.tol else lambda r, c, m=full[other]: m[r, c]
                    part[f"d{other}"] = d if other == side else there(r, c)
                if labelled:
                    part["label_j"] = right["label"].to_numpy()[c]
                out.append(pd.DataFrame(part))
        return pd.concat(out)

    schema = f"space {points.schema['space'].dataType.simpleString()}, i long, side int, j long"
    schema += "".join(f", d{s} double" for s in range(len(vectors)))
    if labelled:
        schema += f", label_j {points.schema['label'].dataType.simpleString()}"
    return pair_blocks(points, run, schema, block_rows=block_rows)


def best_lists(dist: BlockDistance, row_ids, col_ids, k: int, labels=None) -> dict:
    """Per row the ids, distances and labels of its k nearest columns, nearest first."""
    r, c, d = nearest(dist, dist.matrix(), row_ids, col_ids, k)
    ends = np.searchsorted(r, np.arange(len(row_ids) + 1))
    cut = lambda values: [values[a:b] for a, b in zip(ends, ends[1:])]
    out = {"js": cut(col_ids[c]), "ds": cut(d)}
    return out if labels is None else {**out, "ls": cut(labels[c])}


def merged(lists: DataFrame, k: int, labelled: bool = False) -> DataFrame:
    """(space, i, j, d, r) of the k best in all lists of a point; a neighbour that several lists have counts once."""
    fields = [F.col("ds").alias("d"), F.col("js").alias("j")] + ([F.col("ls").alias("label_j")] if labelled else [])
    entry = F.arrays_zip(*fields)
    best = lists.select("space", "i", entry.alias("e")).groupBy("space", "i").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    # in order, what is listed twice stands side by side; array_distinct compares every entry with every other
    once = F.filter("e", lambda x, n: (n == 0) | ~x.eqNullSafe(F.get("e", n - 1)))
    best = best.select("space", "i", F.slice(once, 1, k).alias("e"))
    return best.select("space", "i", F.posexplode("e").alias("r", "e")).select(
        "space", "i", "e.j", "e.d", (F.col("r") + 1).alias("r"), *(["e.label_j"] if labelled else []))


def _top_k(points, vectors, k, block_rows):
    cand = _candidates(points, vectors, k, block_rows)
    own = F.element_at(
        F.array(*[F.col(f"d{s}") for s in range(len(vectors))]), F.col("side") + 1
    )
    order = Window.partitionBy("space", "i", "side").orderBy("_d", "j")
    return (
        cand.withColumn("_d", own)
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= k)
        .drop("_d")
    )


def knn(points: DataFrame, k: int = 7, metric: str = "euclidean", vector: str = "v",
        block_rows: int | None = None, index: Index | None = None) -> DataFrame:
    """(space, i, j, d, r): the k nearest other points of every point.

    With an ``index`` (``pivots.Index``) only cells that can hold a neighbour are searched, which pays where points
    lie in few dimensions or in groups; the rows are the same. Its pivots have to fit into a broadcast of a
    checked size, else all blocks are searched.
    """
    near = pivots.pivot_knn(points, k, metric, vector, index) if index is not None else None
    if near is not None:
        return near
    labelled = "label" in points.columns
    label = points.schema["label"].dataType.simpleString() if labelled else None

    def run(key, left, right, _):
        # a point leaves a block pair as one row, its k best as arrays
        labels = right["label"].to_numpy() if labelled else None
        out = []
        for rows, (dist,) in distances(left, right, [(vector, metric)]):
            ids = left["id"].to_numpy()[rows]
            lists = best_lists(dist, ids, right["id"].to_numpy(), k, labels)
            out.append(pd.DataFrame({"space": [key[0]] * len(ids), "i": ids, **lists}))
        return pd.concat(out)

    schema = f"space {points.schema['space'].dataType.simpleString()}, i long, js array<long>, ds array<double>"
    lists = pair_blocks(points, run, schema + (f", ls array<{label}>" if labelled else ""), block_rows=block_rows)
    return merged(lists, k, labelled)


def _plane_ranks(points: DataFrame, k: int, vectors, index: Index) -> DataFrame | None:
    """``neighbour_ranks`` of layouts in the plane: neighbours by cells, other ranks by boxes of a broadcast layout.

    None where vectors are not all two finite numbers or there are too many points to broadcast.
    """
    fine = lambda c: (F.size(c) == 2) & F.forall(c, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    seen = points.agg(F.count("*").alias("n"), F.count_if(F.coalesce(fine(vectors[0]) & fine(vectors[1]), F.lit(False))).alias("fine")).first()
    if not 0 < seen["n"] <= boxes.MOST_POINTS or seen["fine"] < seen["n"]:
        return None
    points = materialize(points.select("space", "id", *vectors, *(["label"] if "label" in points.columns else [])))
    sides = []
    for side, vector in enumerate(vectors, start=1):
        near = knn(points.select("space", "id", F.col(vector).alias("v"), *points.columns[4:]), k, index=index)
        sides.append(near.select("space", "i", "j", *[(F.col("r") if n == side else F.lit(None)).cast("long").alias(f"r{n}") for n in (1, 2)],
                                 *near.columns[5:]))
    label = [F.first("label_j").alias("label_j")] if "label" in points.columns else []
    both = materialize(sides[0].unionByName(sides[1]).groupBy("space", "i", "j").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"), *label))
    place = lambda v: [F.col(v)[a].alias(f"{v}_{a}") for a in (0, 1)]
    whole = points.select("space", "id", *place(vectors[0]), *place(vectors[1])).toArrow().to_pandas()
    spaces = {s: [Boxes(g["id"].to_numpy("int64"), g[[f"{v}_0", f"{v}_1"]].to_numpy("float64")) for v in vectors]
              for s, g in whole.groupby("space", sort=False)}
    shared = points.sparkSession.sparkContext.broadcast(spaces)

    def run(batches):
        for pdf in batches:
            for space, rows in pdf.groupby("space", sort=False).indices.items():
                some = pdf.iloc[rows].reset_index(drop=True)
                i, j = (np.searchsorted(shared.value[space][0].ids, some[c].to_numpy()) for c in ("i", "j"))
                for n, layout in enumerate(shared.value[space], start=1):
                    open_ = some[f"r{n}"].isna().to_numpy()
                    rank = some[f"r{n}"].fillna(0).to_numpy("int64").copy()
                    rank[open_] = layout.closer(i[open_], j[open_]) + 1
                    some[f"r{n}"] = rank
                yield some

    rows = both.repartition(parallelism(points) * 4, "space", "i")
    return rows.mapInPandas(run, both.schema)


def neighbour_ranks(points: DataFrame, k: int = 7, metrics=("euclidean", "euclidean"),
                    vectors=("v1", "v2"), block_rows: int | None = None, index: Index | None = None) -> DataFrame:
    """(space, i, j, r1, r2, label_j) for every j among the k nearest in either space.

    Ranks up to k come from the neighbour search; only the pairs missing from one side
    are counted, in a second pass that moves one number per look-up and block. With an ``index``, euclidean layouts
    in the plane are searched by cells and counted by boxes; the rows are the same.
    """
    if index is not None and tuple(metrics) == ("euclidean", "euclidean"):
        found = _plane_ranks(points, k, vectors, index)
        if found is not None:
            return found
    cols = list(zip(vectors, metrics))
    labelled = "label" in points.columns
    rank = lambda side: F.max(F.when(F.col("side") == side, F.col("r")))
    near = _top_k(points, cols, k, block_rows).groupBy("space", "i", "j").agg(
        F.coalesce(rank(0), F.lit(0)).alias("r1"), F.coalesce(rank(1), F.lit(0)).alias("r2"),
        F.max("d0").alias("d1"), F.max("d1").alias("d2"),
        *([F.max("label_j").alias("label_j")] if labelled else []),
    )
    fields = ["j", "r1", "r2", "d1", "d2"] + (["label_j"] if labelled else [])
    asks = near.groupBy("space", F.col("i").alias("id")).agg(
        *[F.collect_list(c).alias(f"ask_{c}") for c in fields])
    asked = points.drop("label").join(asks, ["space", "id"])
    asked_label = near.schema["label_j"].dataType.simpleString() if labelled else None

    def run(key, left, right, _):
        col_ids = right["id"].to_numpy()
        home = key[1] == key[2]
        out = []
        for rows, dists in distances(left, right, cols):
            part = left.iloc[rows]
            row_ids = part["id"].to_numpy()
            line = np.repeat(np.arange(len(part)), part["ask_j"].map(len).to_numpy())
            ask = {c: np.concatenate(part[f"ask_{c}"].to_list()) for c in fields}
            closer = []
            for s, dist in enumerate(dists, start=1):
                n = np.zeros(len(line), dtype="int64")
                open_ = np.flatnonzero(ask[f"r{s}"] == 0)
                full = others(dist.matrix(), row_ids, col_ids) if len(open_) else None
                for lo in range(0, len(open_), len(part)):
                    pick = open_[lo : lo + len(part)]
                    n[pick] = count_closer(dist, full, col_ids, line[pick], ask["j"][pick], ask[f"d{s}"][pick])
                closer.append(n)
            # known ranks leave once, from the diagonal block of the point
            frame = {"space": key[0], "i": row_ids[line], "j": ask["j"]}
            for s, n in enumerate(closer, start=1):
                known = ask[f"r{s}"] > 0
                frame[f"r{s}"] = np.where(known, ask[f"r{s}"] if home else 0, n + int(home))
            if labelled:
                frame["label_j"] = ask["label_j"]
            out.append(pd.DataFrame(frame))
        return pd.concat(out)

    schema = (f"space {points.schema['space'].dataType.simpleString()}, "
              "i long, j long, r1 long, r2 long")
    if labelled:
        schema += f", label_j {asked_label}"
    label = [F.max("label_j").alias("label_j")] if labelled else []
    return pair_blocks(asked, run, schema, block_rows=block_rows, sized_by=points).groupBy(
        "space", "i", "j").agg(F.sum("r1").alias("r1"), F.sum("r2").alias("r2"), *label)
