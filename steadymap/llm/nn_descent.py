"""Near-duplicate vectors by NN-descent.

Equal vectors of a label collapse to one node first. A neighbour graph starts from random hyperplane
buckets (several tables, oversized buckets split) and is refined through neighbours of neighbours: every
node hands its list to one task, which compares all members with each other. Lists hold the best
``neighbours`` members; a list that only holds links is saturated, and is enlarged until it is not, so
dense groups end with all their links. When links stop growing, a sample of nodes is compared with every
node of its label by brute force; if too few of its links were found, more tables are added and the
descent goes on, a few times. An exact pass closes: nodes go to the cell of their nearest pivot, and to every
other cell that a link of theirs can lie in by the triangle inequality of angles, so no link is given up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage
from steadymap.llm.components import components
from steadymap.llm.vectors import dimension, usable

EDGES = "u long, v long, cos double"


@dataclass(frozen=True)
class Settings:
    """``sample``: members of a list one task compares in a round, drawn anew every round.

    ``cell``: nodes of a cell of the exact pass.
    """

    threshold: float = 0.98
    neighbours: int = 16
    tables: int = 8
    bucket: int = 256
    sample: int = 64
    growth: float = 0.001
    audit: int = 200
    recall: float = 0.98
    audits: int = 4
    cell: int = 8192
    seed: int = 5


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    unit = [x / np.sqrt((x * x).sum(1))[:, None] for x in (a / np.abs(a).max(1)[:, None], b / np.abs(b).max(1)[:, None])]
    return unit[0] @ unit[1].T


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _best(ids: np.ndarray, cos: np.ndarray, k: int, threshold: float) -> pd.DataFrame:
    """The best k members of a bucket for each of them, and every link."""
    np.fill_diagonal(cos, -2)
    n = min(k, len(ids) - 1)
    floor = np.partition(cos, len(ids) - n, axis=1)[:, len(ids) - n]
    row, col = np.nonzero(cos >= np.minimum(floor, threshold)[:, None])
    keep = cos[row, col] > -2
    return pd.DataFrame({"u": ids[row[keep]], "v": ids[col[keep]], "cos": cos[row[keep], col[keep]]})


def start(nodes: DataFrame, dim: int, settings: Settings, batch: int) -> DataFrame:
    """Best neighbours within the buckets of ``tables`` random hyperplane tables; ``batch`` numbers the tables."""
    planes = np.random.default_rng([settings.seed, batch]).normal(size=(settings.tables, 62, dim))
    bucket, k = settings.bucket, settings.neighbours

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(62, dtype=np.int64)
        for b in frames:
            e = b.column("e").flatten().to_numpy().reshape(b.num_rows, dim)
            bits = np.array([math.ceil(math.log2(max(1, n / bucket))) for n in b.column("size").to_pylist()])
            for t in range(settings.tables):
                code = ((e @ planes[t].T > 0) * weights).sum(1) & ((1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(np.full(len(e), t, np.int32)), pa.array(code),
                                                  b.column("node"), b.column("e")], names=["label", "t", "code", "node", "e"])

    sizes = nodes.groupBy("label").agg(F.count("*").alias("size"))
    placed = nodes.select("label", "node", "e").join(sizes, "label").mapInArrow(
        sign, "label long, t int, code long, node long, e array<double>")
    counts = placed.groupBy("label", "t", "code").agg(F.ceil(F.count("*") / bucket).alias("parts"))
    split = placed.join(counts, ["label", "t", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < 2:
            return pd.DataFrame({"u": [], "v": [], "cos": []})
        e = _stack(group["e"])
        return _best(group["node"].to_numpy(), cosines(e, e), k, settings.threshold)

    return split.groupBy("label", "t", "code", "part").applyInPandas(compare, EDGES)


def trim(edges: DataFrame, settings: Settings) -> DataFrame:
    """One row per pair, and the best of every list: ``neighbours``, or four times its links if that is more."""
    pairs = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    links = pairs.groupBy("u").agg(F.count(F.when(F.col("cos") >= settings.threshold, 1)).alias("links"))
    rank = F.expr("row_number() over (partition by u order by cos desc, v)")
    return pairs.join(links, "u").withColumn("rank", rank).where(
        F.col("rank") <= F.greatest(F.lit(settings.neighbours), 4 * F.col("links"))).select("u", "v", "cos")


def refine(edges: DataFrame, nodes: DataFrame, settings: Settings, step: int) -> DataFrame:
    """Links among the members of every list that has a neighbour near enough to lead to a link.

    Two links span at most twice the threshold's angle, so lists without a neighbour within it are left out.
    """
    wide = math.cos(2 * math.acos(settings.threshold))
    both = edges.where(F.col("cos") >= wide).select(F.col("u").alias("w"), F.col("v").alias("x")).unionByName(
        edges.where(F.col("cos") >= wide).select(F.col("v").alias("w"), F.col("u").alias("x"))).distinct()
    drawn = both.withColumn("rank", F.expr(f"row_number() over (partition by w order by xxhash64(w, x, {step}))")).where(
        F.col("rank") <= settings.sample).select("w", "x")
    lists = drawn.unionByName(drawn.select("w", F.col("w").alias("x")).distinct())
    held = lists.join(nodes.select(F.col("node").alias("x"), "e"), "x")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        e, ids = _stack(group["e"]), group["x"].to_numpy()
        cos = cosines(e, e)
        np.fill_diagonal(cos, -2)
        row, col = np.nonzero(cos >= settings.threshold)
        return pd.DataFrame({"u": ids[row], "v": ids[col], "cos": cos[row, col]})

    return held.groupBy("w").applyInPandas(compare, EDGES)


def audit(nodes: DataFrame, edges: DataFrame, settings: Settings, batch: int) -> float:
    """Share of the links of at most ``audit`` sampled nodes that the graph holds; every node is compared with them."""
    picked = nodes.orderBy(F.xxhash64("node", F.lit(batch)), "node").limit(settings.audit).toPandas()
    q, labels, ids = _stack(picked["e"]), picked["label"].to_numpy(), picked["node"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["node"].to_numpy()
            cos = cosines(q, _stack(f["e"]))
            hit = (cos >= settings.threshold) & (labels[:, None] == f["label"].to_numpy()) & (ids[:, None] != n)
            row, col = np.nonzero(hit)
            yield pd.DataFrame({"u": ids[row], "v": n[col]})

    true = nodes.select("label", "node", "e").mapInPandas(run, "u long, v long")
    seen = edges.where(F.col("cos") >= settings.threshold).select("u", "v", F.lit(1).alias("seen"))
    want, got = true.join(seen, ["u", "v"], "left").agg(F.count("*"), F.count("seen")).first()
    return got / want if want else 1.0


def closing(nodes: DataFrame, settings: Settings, stage: Stage) -> DataFrame:
    """All links ``u``, ``v`` within the labels, each at least once, from whole comparisons.

    Cells of more than ``cell`` nodes are split at random. A pair of nodes is compared in the earlier one of
    their two cells; only cells whose every node is too far away in angle for a link are left out.
    """
    spark, reach = nodes.sparkSession, math.acos(settings.threshold) + 1e-6
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / settings.cell).alias("cells"))
    order = F.expr(f"row_number() over (partition by label order by xxhash64(node, {settings.seed}), node)")
    drawn = nodes.join(sizes.where("cells > 1"), "label").select("label", "e", "cells", order.alias("pivot")).where("pivot <= cells")
    found = drawn.select("label", "e").toPandas()
    pivots = spark.sparkContext.broadcast({k: _stack(f["e"]) for k, f in found.groupby("label")})

    def angles(e: np.ndarray, label: int) -> np.ndarray:
        if label not in pivots.value:
            return np.zeros((len(e), 1))
        return np.arccos(np.clip(cosines(e, pivots.value[label]), -1, 1))

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for label, g in f.groupby("label"):
                a = angles(_stack(g["e"]), label)
                yield g.assign(pivot=a.argmin(1), angle=a.min(1))

    placed = stage.save(nodes.select("label", "node", "e").mapInPandas(home, "label long, node long, e array<double>, pivot int, angle double"), "placed")
    cells = placed.groupBy("label", "pivot").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / settings.cell).alias("pieces")).toPandas()
    layout = spark.sparkContext.broadcast({k: f.sort_values("pivot") for k, f in cells.groupby("label")})

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for label, g in f.groupby("label"):
                plan, e, node = layout.value[label], _stack(g["e"]), g["node"].to_numpy()
                pivot, pieces = plan["pivot"].to_numpy(), plan["pieces"].to_numpy()
                first = np.cumsum(pieces) - pieces
                at = np.searchsorted(pivot, g["pivot"].to_numpy())
                own = first[at] + (node * 0x9E3779B1 >> 7) % pieces[at]
                near = angles(e, label)[:, pivot] <= plan["radius"].to_numpy() + reach
                for c in range(len(pivot)):
                    for cell in range(first[c], first[c] + pieces[c]):
                        here = np.nonzero((own == cell) | (near[:, c] & (cell < own)))[0]
                        yield pd.DataFrame({"label": label, "cell": cell, "home": own[here] == cell, "node": node[here], "e": g["e"].to_numpy()[here]})

    met = placed.select("label", "node", "e", "pivot").mapInPandas(spread, "label long, cell long, home boolean, node long, e array<double>")
    met = stage.save(met, "met")
    parts = met.groupBy("label", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.when(~F.col("home"), 1)) / settings.cell)).alias("parts"))
    # visitors meet the cell's own nodes in parts, own nodes are compared with each other in the first
    own = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))
    ready = stage.again("met", met).join(parts, ["label", "cell"]).select("label", "cell", "home", "node", "e", F.explode(own).alias("part"))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        at_home = group["home"].to_numpy()
        e, ids = _stack(group["e"]), group["node"].to_numpy()
        others = np.ones(len(ids), bool) if key[2] == 0 else ~at_home
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if others.any() and at_home.any():
            there, mine = ids[others], ids[at_home]
            for k in range(0, len(mine), 1024):
                row, col = np.nonzero(cosines(e[at_home][k : k + 1024], e[others]) >= settings.threshold)
                a, b = mine[k + row], there[col]
                u.append(a[a != b])
                v.append(b[a != b])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    return ready.groupBy("label", "cell", "part").applyInPandas(compare, "u long, v long")


def links(nodes: DataFrame, dim: int, settings: Settings, stage: Stage) -> DataFrame:
    """All links among ``nodes`` (label, node, e), both ways."""
    graph, step, batch, found = None, 0, 0, -1

    def keep(edges: DataFrame) -> tuple[DataFrame, int]:
        nonlocal step
        step += 1
        kept = stage.save(trim(edges, settings), f"graph-{step}")
        if step > 1:
            stage.drop(f"graph-{step - 1}")
        return kept, kept.where(F.col("cos") >= settings.threshold).count()

    while True:
        fresh = start(nodes, dim, settings, batch)
        graph, now = keep(fresh if graph is None else graph.unionByName(fresh))
        while now > found + settings.growth * max(found, 0):
            found = now
            linked = refine(graph, nodes, settings, step)
            graph, now = keep(graph.unionByName(linked).unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos")))
        found, batch = max(found, now), batch + 1
        if batch == settings.audits or audit(nodes, graph, settings, batch) >= settings.recall:
            linked = graph.where(F.col("cos") >= settings.threshold).select("u", "v").unionByName(closing(nodes, settings, stage))
            return linked.select("u", "v").unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def groups(table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``table`` (vec_id, embedding, label).

    Vectors are compared within a label. Rows with a null label, a null vec_id, or a vector that is null,
    all zero, of another length than most, or with null or non-finite components link with nothing: no
    links, their own component. Equal vectors of a label are linked without being compared in pairs and
    count one by one in ``n_links``; a vec_id that comes twice counts as two vectors. An empty table gives
    no rows; further columns are ignored.
    """
    spark = table.sparkSession
    stage, dim = Stage(spark, "nn-descent"), dimension(table, "embedding")
    good = usable("embedding", dim) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = stage.save(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                   F.col("embedding").cast("array<double>").alias("e"), good.alias("good")), "rows")
    nodes = stage.save(rows.where("good").groupBy("label", "e").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes")
    others = stage.again("nodes", nodes)
    if nodes.isEmpty():
        pairs = spark.createDataFrame([], "u long, v long")
    else:
        pairs = stage.save(links(others, dim, settings, stage), "links")
    near = pairs.join(nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("linked"))
    roots = components(pairs.where("u > v").select(F.col("u").alias("a"), F.col("v").alias("b")), stage)
    named = nodes.join(near, "node", "left").join(roots, "node", "left").select(
        "label", "e", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root"))
    named = stage.save(named, "named")
    linked = stage.again("rows", rows).where("good").join(named, ["label", "e"]).select(
        "vec_id", F.col("n").cast("long").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
