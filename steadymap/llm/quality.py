"""Text quality by regularised quadratic discriminant analysis.

Each text becomes a fixed vector of transformed statistics (shares as arcsine square roots, sizes as
logarithms). Spark sums counts, vectors and outer products per class over all labelled training rows;
the driver turns these fixed-size sums into means and shrunk covariances, keeps their Cholesky factors
and broadcasts them. A score is the difference of the two classes' log densities, calibrated to a
probability by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage, id_fold

_CLASSES = np.zeros((256, 7))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!", b"\n")):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[[c for c in range(33, 127) if not _CLASSES[c].any()], 6] = 1  # other symbols
NAMES = ("words", "mean_length", "upper", "digits", "sentence_marks", "exclamations", "lines", "symbols", "other_letters",
         "distinct_words", "top_word", "short_words", "repeated_lines", "bare_words", "length_spread")
DIM = len(NAMES)


def statistics(text: str | None) -> np.ndarray:
    """The vector of one whole text; a null, empty or blank text is all zeros."""
    out = np.zeros(DIM)
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, marks, bangs, lines, symbols = counts @ _CLASSES
    other = counts[0xC0:].sum()
    n, letters, visible = len(words), upper + lower + other, len(raw) - counts[9:14].sum() - counts[32]
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    cut = [x for x in text.split("\n") if x.strip()]
    bare = sum(c for w, c in seen.items() if not (w.isalnum() or any(b > 191 or chr(b).isalpha() for b in w)))
    share = np.array([upper / max(letters, 1), digits / visible, marks / visible, bangs / visible, lines / (n + lines),
                      symbols / visible, other / max(letters, 1), len(seen) / n, max(seen.values()) / n,
                      (lengths <= 3).mean(), 1 - len(set(cut)) / max(len(cut), 1), bare / n])
    out[:2] = np.log(n), np.log(lengths.mean())
    out[2:14] = np.arcsin(np.sqrt(np.clip(share, 0, 1)))
    out[14] = np.log1p(lengths.std())
    return out


@dataclass(frozen=True)
class Settings:
    """``shrinkage`` towards the pooled covariance, ``ridge`` towards its diagonal; ``calibration_rows`` bounds the curve's sample."""

    folds: int = 5
    threshold: float = 0.3
    shrinkage: float = 0.3
    ridge: float = 0.05
    calibration_rows: int = 20_000


@dataclass(frozen=True)
class Model:
    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverse Cholesky factors of class 0 and 1
    logdets: np.ndarray | None = None
    curve: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log density under class 1 minus that under class 0, compressed by asinh."""
        parts = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets):
            z = (x - mean) @ inverse.T
            parts.append(-0.5 * ((z * z).sum(1) + logdet))
        return np.arcsinh(parts[1] - parts[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], settings: Settings) -> Model:
    """``sums``: class -> count, sum of vectors, sum of outer products."""
    n = {c: sums[c][0] if c in sums else 0 for c in (0, 1)}
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    if min(n.values()) < 2:
        return Model(prior)
    means = np.stack([sums[c][1] / n[c] for c in (0, 1)])
    covs = [sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    floor = np.diag(np.diag(pooled) + 1e-4)
    factors, logdets = [], []
    for cov in covs:
        s = (1 - settings.shrinkage) * cov + settings.shrinkage * pooled
        lower = np.linalg.cholesky((1 - settings.ridge) * s + settings.ridge * floor)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    return Model(prior, means, np.stack(factors), np.array(logdets))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """A logistic curve over the margin by Newton steps, with a small prior on its slope."""
    if model.means is None or not len(y):
        return model
    m, w = np.stack([model.margin(x), np.ones(len(y))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -500, 500)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2), m.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.prior, model.means, model.factors, model.logdets, (float(w[0]), float(w[1])))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics ``x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, x array<double>")


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class the count, sum and outer products: every task sums its rows, Spark adds the tasks."""
    size = 1 + DIM + DIM * DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, DIM)
            y = batch.column(1).to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size)), pa.array(np.tile(np.arange(size), 2)),
                                          pa.array(total.ravel())], names=["y", "k", "v"])

    out = {c: np.zeros(size) for c in (0, 1)}
    for y, k, v in labelled.mapInArrow(run, "y long, k long, v double").groupBy("y", "k").agg(F.sum("v")).collect():
        out[y][k] = v
    return {c: (v[0], v[1 : 1 + DIM], v[1 + DIM :].reshape(DIM, DIM)) for c, v in out.items()}


def learn(table: DataFrame, labels: DataFrame, stage: Stage, settings: Settings = Settings()) -> Model:
    """Fit and calibrate on the labelled rows of ``table`` (doc_id, x) outside fold 0."""
    outside = id_fold("doc_id", settings.folds) != 0
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("y")).where("y in (0, 1)")
    labelled = stage.save(table.where(outside).join(known.where(outside), "doc_id").select("x", "y", "doc_id"), "labelled")
    model = fit(class_sums(labelled.select("x", "y")), settings)
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.calibration_rows).select("x", "y").toPandas()
    return calibrate(model, np.stack(sample["x"]), sample["y"].to_numpy(float)) if len(sample) else model


def keep(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all their columns.

    Rows are judged as ``score`` judges them, one by one, so repeated rows stay or go together.
    """
    stage = Stage(docs.sparkSession, "quality")
    model = learn(stage.save(vectors(docs), "vectors"), labels, stage, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([statistics(t.as_py()) for t in batch.column("text")])
                yield batch.filter(pa.array(model.score(x) >= settings.threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every document.

    Learns from labelled rows outside fold 0 (crc32 of the id mod ``folds``); rows whose quality is
    null or neither 0 nor 1 are no labels, and a document labelled twice counts twice. Repeated rows
    are scored once each. Empty texts get a score from their all-zero vector. Without two labelled rows
    of either class every score is the smoothed share of label 1, 0.5 without labels. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "quality")
    table = stage.save(vectors(docs), "vectors")
    model = learn(table, labels, stage, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column("x").flatten().to_numpy().reshape(-1, DIM))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)],
                                             names=["doc_id", "held_out", "score"])

    scored = table.withColumn("held_out", id_fold("doc_id", settings.folds) == 0).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
