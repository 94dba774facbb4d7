"""Nearest neighbours by largest inner product with an inverted multi-index.

Both halves of the vectors are quantised by their own k-means, fitted on a bounded sample; every row is
indexed under its pair of centroids. A query walks the pairs by summed centroid score with a heap: first
until a share ``first`` of the rows is seen, which gives it a floor for its k-th best score, then until the
pairs not visited are expected to hold at most ``miss`` times k rows above that floor, taking what
quantisation loses as normal noise. Entries of visited pairs are reranked by their exact inner product.

Rows are split into parts of about ``part_rows``, queries into parts of about ``part_queries``; one task
scores one part of a first-half centroid against one part of the queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage
from steadymap.llm.vectors import dimension, usable

HITS = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Settings:
    k: int = 20
    centroids: int = 16
    sample_rows: int = 20_000
    first: float = 0.1
    miss: float = 0.1
    part_rows: int = 2048
    part_queries: int = 2048
    seed: int = 11


@dataclass(frozen=True)
class Index:
    halves: tuple[np.ndarray, np.ndarray]
    loss: np.ndarray  # per pair: variance of a component that quantisation loses
    counts: np.ndarray  # rows per pair

    def pairs(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each half."""
        h = self.halves[0].shape[1]
        return tuple(((x @ c.T) - 0.5 * (c * c).sum(1)).argmax(1) for x, c in zip((e[:, :h], e[:, h:]), self.halves))

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Pairs that hold rows, by falling summed score: one heap over two sorted lists of centroids."""
        h = self.halves[0].shape[1]
        a, b = self.halves[0] @ q[:h], self.halves[1] @ q[h:]
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, pushed = [(-(a[oa[0]] + b[ob[0]]), 0, 0)], {(0, 0)}
        while heap:
            s, i, j = heapq.heappop(heap)
            if self.counts[oa[i], ob[j]]:
                yield -s, int(oa[i]), int(ob[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(oa) and y < len(ob) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (-(a[oa[x]] + b[ob[y]]), x, y))


def _expected(index: Index, path: list[tuple[float, int, int]], q: np.ndarray, floor: float | None) -> np.ndarray:
    """Rows above ``floor`` to be expected from each step of a walk on; without a floor there is no end to them."""
    if floor is None or math.isnan(floor):
        return np.full(len(path), np.inf)
    norm = math.sqrt((q * q).sum())
    rows = []
    for s, f, h in path:
        noise = norm * math.sqrt(2 * index.loss[f, h]) or 1e-300
        rows.append(index.counts[f, h] * 0.5 * math.erfc(max(-26.0, min(26.0, (floor - s) / noise))))
    return np.cumsum(rows[::-1])[::-1]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; empty centroids stay where they are."""
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], minlength=len(c)) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed from the first component to the last.

    One order for every pair: equal vectors get equal scores wherever they are.
    """
    out, part = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    for d in range(q.shape[1]):
        np.multiply(q[:, d, None], x[None, :, d], out=part)
        out += part
    return out


def _stack(column: pd.Series | pa.Array) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(float)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """The k best rows in visited pairs for every query of one part, ties to the smaller id."""
    rows = rows.sort_values("vec_id", kind="stable")
    q, x, ids = _stack(queries["e"]), _stack(rows["e"]), rows["vec_id"].to_numpy()
    mask = np.frombuffer(b"".join(queries["visits"]), np.uint8).reshape(len(queries), width).astype(bool)
    scores = np.full((len(q), len(x)), -np.inf)
    second = rows["second"].to_numpy()
    for s in np.unique(second):
        at, asked = np.flatnonzero(second == s), np.flatnonzero(mask[:, s])
        scores[np.ix_(asked, at)] = inner_products(q[asked], x[at])
    scores[queries["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
    floor = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    s = scores[row, col]
    order = np.lexsort((ids[col], -s, row))
    row, col, s = row[order], col[order], s[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row[keep]], "vec_id": ids[col[keep]], "score": s[keep]})


def fit(rows: DataFrame, dim: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves from a sample of at most ``sample_rows`` rows, chosen by the hash of their id."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample_rows).select("e").toPandas()
    x, rng = _stack(sample["e"]), np.random.default_rng(settings.seed)
    half = (dim + 1) // 2
    return tuple(kmeans(part, settings.centroids, rng) if part.shape[1] else np.zeros((1, 0)) for part in (x[:, :half], x[:, half:]))


def search(table: DataFrame, is_query: str, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, nearest first.

    ``table`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``. Vectors that
    are null, all zero, of another length than most, or hold null or non-finite components take no part,
    nor do rows without id. An id that comes more than once stands for its smallest vector. Equal scores
    go to the smaller id. Fewer rows than k give fewer neighbours; an empty table gives none. Further
    columns are ignored.
    """
    spark, k = table.sparkSession, settings.k
    stage = Stage(spark, "multi-index")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dimension(table, "embedding")
    if not dim:
        return empty
    rows = table.where(usable("embedding", dim) & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(F.col("embedding").cast("array<double>")).alias("e"))
    rows = stage.save(rows, "rows")
    if rows.isEmpty():
        return empty
    halves = fit(rows, dim, settings)
    width = len(halves[1])
    plain = Index(halves, np.zeros(0), np.zeros(0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = _stack(b.column("e"))
            first, second = plain.pairs(e)
            rest = e - np.concatenate([halves[0][first], halves[1][second]], 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("e"), pa.array(first.astype(np.int32)),
                                              pa.array(second.astype(np.int32)), pa.array((rest * rest).sum(1) / dim)],
                                             names=["vec_id", "e", "first", "second", "lost"])

    indexed = stage.save(rows.mapInArrow(assign, "vec_id long, e array<double>, first int, second int, lost double"), "index")
    counts, loss = np.zeros((len(halves[0]), width), np.int64), np.zeros((len(halves[0]), width))
    for f, s, n, lost in indexed.groupBy("first", "second").agg(F.count("*"), F.avg("lost")).collect():
        counts[f, s], loss[f, s] = n, lost
    index = Index(halves, loss, counts)
    total, parts = int(counts.sum()), np.maximum(1, -(-counts.sum(1) // settings.part_rows))
    asked = stage.again("index", indexed).where(is_query)
    query_parts = max(1, -(-asked.count() // settings.part_queries))
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("first") + 1)).cast("int")
    # every part of the rows meets every part of the queries once
    entries = indexed.withColumn("part", part).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))

    def visits(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, floors = _stack(b.column("e")), b.column("floor").to_pylist()
            out: list[tuple] = []
            for q, query, query_part, floor in zip(e, b.column("query_id").to_pylist(), b.column("query_part").to_pylist(), floors):
                chosen, seen, early = np.zeros(counts.shape, np.uint8), 0, max(settings.first * total, 2 * k)
                path = list(index.walk(q))
                left = _expected(index, path, q, floor) if again else None
                for n, (_, f, h) in enumerate(path):
                    opening, seen = seen < early, seen + counts[f, h]
                    if not opening and (not again or left[n] <= settings.miss * k):
                        break
                    chosen[f, h] = opening != again
                for f in np.flatnonzero(chosen.any(1)):
                    out += [(int(f), p, query_part, query, q, chosen[f].tobytes()) for p in range(parts[f])]
            for at in range(0, len(out), 5000):
                f, p, qp, query, q, mask = zip(*out[at : at + 5000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f, pa.int32()), pa.array(p, pa.int32()), pa.array(qp, pa.int32()), pa.array(query, pa.int64()),
                     pa.array(list(q), pa.list_(pa.float64())), pa.array(mask, pa.binary())],
                    names=["first", "part", "query_part", "query_id", "e", "visits"])

    keys = ("first", "part", "query_part")

    def rerank(queries: DataFrame, again: bool) -> DataFrame:
        placed = queries.mapInArrow(lambda batches: visits(batches, again),
                                    "first int, part int, query_part int, query_id long, e array<double>, visits binary")

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return _best(left, right, k, width)

        return placed.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(score, HITS)

    def top(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)")).where(
            F.col("rank") <= k)

    queries = stage.save(asked.select(F.col("vec_id").alias("query_id"), "e", F.pmod(F.xxhash64("vec_id"), F.lit(query_parts)).cast(
        "int").alias("query_part"), F.lit(None).cast("double").alias("floor")), "queries")
    found = stage.save(top(rerank(queries, False)), "found")
    floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        "query_id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    more = stage.save(rerank(queries.drop("floor").join(floors, "query_id", "left"), True), "more")
    return top(stage.again("found", found).select("query_id", "vec_id", "score").unionByName(more)).select("query_id", "rank", "vec_id", "score")


def recall(table: DataFrame, found: DataFrame, is_query: str, k: int = 20, sample: int = 200) -> float:
    """Share of the true k best scores found, over at most ``sample`` queries against all rows by brute force."""
    dim = dimension(table, "embedding")
    rows = table.where(usable("embedding", dim) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    picked = rows.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(picked):
        return 1.0
    q = picked.rename(columns={"vec_id": "query_id"}).assign(visits=[b"\x01"] * len(picked))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 4096):
                yield _best(q, f.iloc[at : at + 4096].assign(second=0), k, 1)

    true = rows.mapInPandas(run, HITS).withColumn(
        "rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    hit = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / true.count()
