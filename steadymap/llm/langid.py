"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed character trigrams; a linear layer and a softmax
give the languages. Stochastic gradient descent in numpy fits embeddings and layer on a bounded sample of
labelled texts (``sample`` per language, fewer with very many languages). A held-back part of the sample
calibrates the softmax's temperature and the score below which a prediction is rejected. Averaging and
the layer are linear, so prediction needs one table of a row of logits per trigram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import id_fold

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
SALTS = 64


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` texts of a language and about ``sample_all`` in all are learned from."""

    folds: int = 5
    sample: int = 500
    sample_all: int = 20_000
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    held_back: float = 0.2
    keep: float = 0.99
    seed: int = 3


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logits: np.ndarray | None = None  # buckets x languages
    bias: np.ndarray | None = None
    scale: float = 1.0
    floor: float = 0.0


def trigrams(text: str, buckets: int) -> np.ndarray:
    """Hashed trigrams of the lower-cased text; ASCII characters that are no letters all count as one."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where((cp < 97) | ((cp > 122) & (cp < 128)), 32, cp).astype(np.uint32)
    cp = np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]])
    mid = np.flatnonzero(cp[1:-1] != 32) + 1
    h = (cp[mid - 1] * np.uint32(0x9E3779B1)) ^ (cp[mid] * np.uint32(0x85EBCA77)) ^ (cp[mid + 1] * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], settings: Settings) -> Model:
    """``texts``: distinct buckets, their counts and the language's place in ``langs``, in a fixed order."""
    if not texts:
        return Model(langs)
    rng, n = np.random.default_rng(settings.seed), len(langs)
    embed, out, bias = rng.normal(0, 0.1, (settings.buckets, settings.dim)), rng.normal(0, 0.1, (settings.dim, n)), np.zeros(n)
    order = rng.permutation(len(texts))
    cut = int(len(texts) * settings.held_back)
    checked, learned = order[:cut], order[cut:]
    steps, step = settings.epochs * len(learned), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(learned):
            at, count, lang = texts[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            share = (count / count.sum())[:, None]
            mean = (embed[at] * share).sum(0)
            error = _softmax(mean @ out + bias)
            error[lang] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # an average of many parts moves little, so its parts take longer steps
            embed[at] -= 20 * rate * share * back
    logits = embed @ out
    raw = np.array([(logits[at] * (count / count.sum())[:, None]).sum(0) + bias for at, count, _ in (texts[i] for i in checked)])
    if not len(raw):
        return Model(langs, logits, bias)
    truth = np.array([texts[i][2] for i in checked])
    scales = np.geomspace(0.1, 10, 41)
    loss = [-np.log(_softmax(s * raw)[np.arange(len(raw)), truth] + 1e-12).mean() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = _softmax(scale * raw)
    right = p.max(1)[p.argmax(1) == truth]
    return Model(langs, logits, bias, scale, float(np.quantile(right, 1 - settings.keep)) if len(right) else 0.0)


def predict(text: str | None, model: Model) -> tuple[str, float, bool]:
    if not text or model.logits is None or not LETTER.search(text):
        return UNKNOWN, 0.0, True
    h = trigrams(text, len(model.logits))
    if not len(h):
        z = model.bias
    elif len(h) > len(model.logits):
        z = np.bincount(h, minlength=len(model.logits)) @ model.logits / len(h) + model.bias
    else:
        z = model.logits[h].sum(0) / len(h) + model.bias
    p = _softmax(model.scale * z)
    best = int(p.argmax())
    return model.langs[best], float(p[best]), bool(p[best] < model.floor)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from rows with a language outside fold 0; texts without letters teach nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_fold("doc_id", settings.folds) != 0))
    sizes = rows.groupBy("lang").count()
    languages = sizes.count()
    bound = min(settings.sample, max(1, settings.sample_all // max(1, languages)))
    # a hash decides who is in the sample: no sort and no window over a large language
    chance = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(1 << 30)) / float(1 << 30)
    if languages <= settings.sample_all:  # one small row a language: texts stay where they are
        counted = rows.join(F.broadcast(sizes), "lang")
    else:  # a language's texts meet its count in SALTS places
        counted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(
            sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])
    picked = counted.where(chance < bound / F.col("count")).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for doc, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                if LETTER.search(text):
                    at, count = np.unique(trigrams(text, settings.buckets), return_counts=True)
                    if len(at):
                        kept.append((doc, lang, at.astype(np.int32), count.astype(np.int32)))
            doc, lang, at, count = zip(*kept) if kept else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lang, pa.string()), pa.array(at, pa.list_(pa.int32())),
                                              pa.array(count, pa.list_(pa.int32()))], names=["doc_id", "lang", "at", "n"])

    sample = picked.mapInArrow(run, "doc_id long, lang string, at array<int>, n array<int>").toPandas()
    sample = sample.sort_values(["doc_id", "lang"], kind="stable")
    langs = sorted(set(sample["lang"]))
    place = {x: k for k, x in enumerate(langs)}
    return train([(np.asarray(a), np.asarray(n, float), place[x]) for a, n, x in zip(sample["at"], sample["n"], sample["lang"])], langs, settings)


def identify(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every whole text.

    A null text, one without a letter, and any text if nothing was learned, is ``und`` with score 0 and
    rejected. ``rejected`` marks scores below what ``keep`` of the right predictions on held-back texts
    reach. Repeated rows are predicted once each; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [predict(t.as_py(), model) for t in b.column(2)]
            lang, score, rejected = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_fold("doc_id", settings.folds) == 0).alias("held_out"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
