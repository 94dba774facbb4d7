"""Topic models and their quality on bag-of-words corpora."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F

from steadymap.operators.blocks import pair_blocks
from steadymap.operators.neighbours import distances, knn
from steadymap.operators.order import hash_unit
from steadymap.session import materialize, parallelism

EPS = 1e-12
MAX_TOP_WORDS = 100_000


def window_counts(token_lists: DataFrame, topic_words: DataFrame, size: int | None) -> DataFrame:
    """(topic, w1, w2, n): windows that contain both top words of a topic; w1 = w2 counts a word.

    A window is ``size`` consecutive tokens, or the whole document. Every task adds up its own
    documents, so the rows that move depend on the topics only. A last row with NULL words
    carries the number of windows.
    """
    words = topic_words.select("topic", "word").limit(MAX_TOP_WORDS + 1).collect()
    if len(words) > MAX_TOP_WORDS:
        raise ValueError("too many top words")
    by_topic: dict = {}
    for r in words:
        by_topic.setdefault(r["topic"], []).append(r["word"])
    listed = sorted({r["word"] for r in words})
    index = {w: n for n, w in enumerate(listed)}
    groups = [(t, np.array(sorted(index[w] for w in ws))) for t, ws in by_topic.items()]
    topic_type = topic_words.schema["topic"].dataType.simpleString()

    def run(batches):
        lookup = pd.Index(listed)
        sums = [np.zeros((len(g), len(g)), dtype="int64") for _, g in groups]
        windows = 0
        for pdf in batches:
            for tokens in pdf["tokens"]:
                span = len(tokens) if size is None else min(size, len(tokens))
                starts = len(tokens) - span + 1
                windows += starts
                code = lookup.get_indexer(np.asarray(tokens, dtype=object))
                at = np.flatnonzero(code >= 0)
                if not len(at):
                    continue
                present, slot = np.unique(code[at], return_inverse=True)
                # occurrences open and close the range of window starts that cover them
                marks = np.zeros((len(present), starts + 1), dtype="int32")
                np.add.at(marks, (slot, np.maximum(0, at - span + 1)), 1)
                np.add.at(marks, (slot, np.minimum(at, starts - 1) + 1), -1)
                seen = (np.cumsum(marks[:, :-1], axis=1) > 0).astype("float64")
                both = (seen @ seen.T).astype("int64")
                for total, (_, g) in zip(sums, groups):
                    mine = np.flatnonzero(np.isin(present, g))
                    if len(mine):
                        pos = np.searchsorted(g, present[mine])
                        total[np.ix_(pos, pos)] += both[np.ix_(mine, mine)]
        rows = [(None, None, None, windows)]
        for total, (topic, g) in zip(sums, groups):
            for a, b in zip(*np.nonzero(total)):
                rows.append((topic, listed[g[a]], listed[g[b]], int(total[a, b])))
        yield pd.DataFrame(rows, columns=["topic", "w1", "w2", "n"])

    partial = token_lists.select("tokens").mapInPandas(
        run, f"topic {topic_type}, w1 string, w2 string, n long")
    return partial.groupBy("topic", "w1", "w2").agg(F.sum("n").alias("n"))


def _pairs(token_lists, topic_words, size):
    """Ordered word pairs of a topic with their counts n1, n2, n12 and the number of windows."""
    counts = materialize(window_counts(token_lists, topic_words, size))
    total = counts.filter(F.col("w1").isNull()).agg(F.sum("n")).first()[0] or 0
    single = counts.filter(F.col("w1") == F.col("w2")).select("topic", F.col("w1").alias("word"), "n")
    ranked = topic_words.select("topic", "word", "rank").join(single, ["topic", "word"], "left").select(
        "topic", "word", "rank", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = materialize(ranked)
    a = ranked.select("topic", F.col("word").alias("w1"), F.col("rank").alias("k1"), F.col("n").alias("n1"))
    b = ranked.select("topic", F.col("word").alias("w2"), F.col("rank").alias("k2"), F.col("n").alias("n2"))
    both = counts.filter(F.col("w1") != F.col("w2")).select("topic", "w1", "w2", F.col("n").alias("n12"))
    pairs = a.join(b, "topic").join(both, ["topic", "w1", "w2"], "left")
    return pairs.withColumns({"n12": F.when(F.col("w1") == F.col("w2"), F.col("n1")).otherwise(
        F.coalesce("n12", F.lit(0))), "n": F.lit(float(total))})


def _log_ratio(normalised: bool):
    n = F.col("n")
    joint = F.col("n12") / n + EPS
    value = F.log(joint / ((F.col("n1") / n) * (F.col("n2") / n)))
    if normalised:
        value = value / -F.log(joint)
    return F.when((F.col("n1") > 0) & (F.col("n2") > 0), value).otherwise(0.0)


def coherence_umass(token_lists: DataFrame, topic_words: DataFrame) -> DataFrame:
    """Per topic: mean over words and the words ranked before them of ln((D12/N + ε)/(D2/N))."""
    pairs = _pairs(token_lists, topic_words, None).filter("k1 > k2")
    n = F.col("n")
    value = F.when(F.col("n2") > 0, F.log((F.col("n12") / n + EPS) / (F.col("n2") / n))).otherwise(0.0)
    return pairs.groupBy("topic").agg(F.avg(value).alias("coherence"))


def coherence_uci(token_lists: DataFrame, topic_words: DataFrame, window: int = 10, pairs: DataFrame | None = None) -> DataFrame:
    return (_pairs(token_lists, topic_words, window) if pairs is None else pairs).filter("w1 <> w2").groupBy("topic").agg(
        F.avg(_log_ratio(False)).alias("coherence"))


def coherence_npmi(token_lists: DataFrame, topic_words: DataFrame, window: int = 10, pairs: DataFrame | None = None) -> DataFrame:
    return (_pairs(token_lists, topic_words, window) if pairs is None else pairs).filter("w1 <> w2").groupBy("topic").agg(
        F.avg(_log_ratio(True)).alias("coherence"))


def coherence_cv(token_lists: DataFrame, topic_words: DataFrame, window: int = 110) -> DataFrame:
    """Per topic: mean cosine of every word's NPMI vector to the summed vector of the topic."""
    cells = materialize(_pairs(token_lists, topic_words, window).select(
        "topic", "w1", "w2", _log_ratio(True).alias("m")))
    total = cells.groupBy("topic", "w2").agg(F.sum("m").alias("s"))
    cos = F.sum(F.col("m") * F.col("s")) / F.sqrt(F.sum(F.col("m") * F.col("m")) * F.sum(F.col("s") * F.col("s")))
    per_word = cells.join(total, ["topic", "w2"]).groupBy("topic", "w1").agg(cos.alias("c"))
    return per_word.groupBy("topic").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("coherence"))


def _features(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, features) from struct<idx, val> rows."""
    make = F.udf(lambda i, v: SparseVector(width, i, v), VectorUDT())
    return rows.select("doc_id", make("v.idx", "v.val").alias("features"))


def lda(rows: DataFrame, width: int, k: int, alpha: str = "auto", iterations: int = 20, seed: int = 42):
    """(doc_topics, topic_terms, perplexity): all k topics are kept for every document.

    A round draws as many documents as there are, with replacement, so 20 rounds read each about 20 times.
    """
    data = materialize(_features(rows, width))
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0,
                optimizeDocConcentration=alpha == "auto")
    if alpha == "asymmetric":
        prior = [1.0 / (n + np.sqrt(k)) for n in range(k)]
        model = model.setDocConcentration(list(np.array(prior) / sum(prior)))
    fitted = model.fit(data)
    docs = fitted.transform(data).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "p"))
    weights = fitted.topicsMatrix().toArray()
    return docs, _topic_terms(data, weights), 2.0 ** log_perplexity(fitted, data, k, weights)


def _topic_terms(data: DataFrame, weights: np.ndarray) -> DataFrame:
    """(topic, term_id, weight): the topics' shares of all terms, as ``describeTopics`` has them.

    Spark's own sorts the whole vocabulary as objects on the driver, once per topic.
    """
    spark, (width, k) = data.sparkSession, weights.shape
    shared = spark.sparkContext.broadcast((weights, weights.sum(axis=0)))

    def run(batches):
        for pdf in batches:
            term, (table, total) = pdf["id"].to_numpy(), shared.value
            yield pd.DataFrame({"topic": np.tile(np.arange(k, dtype="int32"), len(term)), "term_id": np.repeat(term, k),
                                "weight": (table[term] / total).ravel()})

    return spark.range(width).mapInPandas(run, "topic int, term_id long, weight double")


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: shifted above six, then its asymptotic series."""
    x = np.array(x, dtype="float64")
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * (691 / 32760 - y / 12))))))
    return out + np.log(x) - 0.5 / x - series


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, np.ravel(x)), "float64", np.size(x)).reshape(np.shape(x))


def log_perplexity(fitted, data: DataFrame, k: int, weights: np.ndarray | None = None) -> float:
    """The variational bound per token with its sign turned, as Spark's ``logPerplexity`` defines it.

    Spark's own takes exponentials of the whole term table for every document and counts tokens on dense vectors, which
    is documents x vocabulary. Here a document reads its own terms only: its posterior is its topic distribution times
    the prior's sum and its tokens.
    """
    weights = fitted.topicsMatrix().toArray() if weights is None else weights
    prior, eta = np.asarray(fitted.estimatedDocConcentration().toArray()), 1.0 / k
    total = weights.sum(axis=0)
    log_terms = _digamma(weights) - _digamma(total)
    shared = data.sparkSession.sparkContext.broadcast(log_terms)

    def run(batches):
        bound, tokens = 0.0, 0.0
        for pdf in batches:
            for idx, val, share in zip(pdf["idx"], pdf["val"], pdf["share"]):
                posterior = share * (prior.sum() + val.sum())
                log_share = _digamma(posterior) - _digamma(posterior.sum())
                joint = shared.value[idx] + log_share
                top = joint.max(axis=1)
                bound += (val * (top + np.log(np.exp(joint - top[:, None]).sum(axis=1)))).sum()
                bound += ((prior - posterior) * log_share + _log_gamma(posterior) - _log_gamma(prior)).sum()
                bound += math.lgamma(prior.sum()) - math.lgamma(posterior.sum())
                tokens += val.sum()
        yield pd.DataFrame({"bound": [bound], "tokens": [tokens]})

    parts = F.udf(lambda v: (v.indices.tolist(), v.values.tolist()), "struct<idx: array<int>, val: array<double>>")
    rows = fitted.transform(data).select(parts("features").alias("v"), vector_to_array("topicDistribution").alias("share")).select("v.idx", "v.val", "share")
    sums = rows.where(F.exists("val", lambda x: x != 0)).mapInPandas(run, "bound double, tokens double").agg(F.sum("bound"), F.sum("tokens")).first()
    shared.unpersist()
    topics = ((eta - weights) * log_terms + _log_gamma(weights) - math.lgamma(eta)).sum() + (
        math.lgamma(eta * len(weights)) - _log_gamma(total)).sum()
    return -(sums[0] + topics) / sums[1]


def _entries(rows: DataFrame) -> DataFrame:
    """(doc_id, term_id, val) of struct<idx, val> rows."""
    return rows.select("doc_id", F.explode(F.arrays_zip(F.col("v.idx").alias("term_id"), F.col("v.val").alias("val"))).alias("e")).select(
        "doc_id", F.col("e.term_id").cast("long").alias("term_id"), F.col("e.val").cast("double").alias("val"))


def _times(entries: DataFrame, factors: DataFrame, by: str, to: str, k: int) -> DataFrame:
    """(to, f0 ... ): the sparse table times a factor table keyed by ``by``, as a join and sums."""
    return entries.join(factors, by).groupBy(to).agg(*[F.sum(F.col("val") * F.col(f"f{t}")).alias(f"f{t}") for t in range(k)])


def _gram(factors: DataFrame, k: int, other: str = "f") -> np.ndarray:
    """k x k sums of products of a factor table's columns: all that reaches the driver."""
    left, right = [f"f{i}" for i in range(k)], [f"{other}{i}" for i in range(k)]
    i, j = (x.ravel() for x in np.indices((k, k)))

    def run(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            total += pdf[left].to_numpy().T @ pdf[right].to_numpy()
        yield pd.DataFrame({"i": i, "j": j, "x": total.ravel()})

    parts = factors.select(*dict.fromkeys(left + right)).mapInPandas(run, "i int, j int, x double")
    got, out = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas(), np.zeros((k, k))
    out[got["i"], got["j"]] = got["x"]
    return out


def _mapped(factors: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Every row's factors times a small matrix; numbers in the plan would be compiled anew every round."""
    k, to = matrix.shape
    names = [f"f{j}" for j in range(to)]

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame(pdf[[f"f{i}" for i in range(k)]].to_numpy() @ matrix, columns=names)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = factors.schema[key].dataType.simpleString()
    return factors.mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def _orthonormal(factors: DataFrame, key: str, k: int) -> DataFrame:
    """The tall table with orthonormal columns, by two rounds of Cholesky QR; directions without length become zero."""
    for _ in range(2):
        gram = _gram(factors, k)
        values, vectors = np.linalg.eigh(gram)
        fine = values > max(values.max(), 0.0) * 1e-14
        scale = np.where(fine, 1.0 / np.sqrt(np.where(fine, values, 1.0)), 0.0)
        factors = _mapped(factors, key, vectors * scale)
    return materialize(factors)


def lsi(rows: DataFrame, width: int, k: int, power_iters: int = 20, extra_samples: int = 10, seed: int = 42, tolerance: float = 1e-9):
    """(doc_topics, topic_terms): projections on the k leading term directions.

    A randomised range finder: the table times ``k + extra_samples`` seeded sign vectors, then power rounds until the
    k squared singular values move by less than ``tolerance`` of themselves, at most ``power_iters``. Factors are tables
    keyed by document or term, products are joins and sums; only small square matrices reach the driver. The sign of a
    direction makes its largest entry positive.
    """
    docs, terms, _ = lsi_factors(rows, width, k, power_iters, extra_samples, seed, tolerance)
    long = lambda df, key, name: df.select(key, F.posexplode(F.array(*[f"f{t}" for t in range(k)])).alias("topic", name))
    every = rows.select("doc_id").distinct().join(docs, "doc_id", "left").fillna(0.0)
    return long(every, "doc_id", "p"), long(terms, "term_id", "weight").select("topic", "term_id", "weight")


def lsi_factors(rows: DataFrame, width: int, k: int, power_iters: int = 20, extra_samples: int = 10, seed: int = 42, tolerance: float = 1e-9):
    """(documents, terms, singular values): tables of factors f0 ... per doc_id and term_id."""
    size = min(k + extra_samples, width)
    entries = materialize(_entries(rows))
    sign = lambda t: F.when(F.xxhash64("term_id", F.lit(t), F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0).alias(f"f{t}")
    start = entries.select("term_id").distinct().select("term_id", *[sign(t) for t in range(size)])
    tall = materialize(_times(entries, start, "term_id", "doc_id", size))
    before = None
    for _ in range(max(1, power_iters)):
        tall = _orthonormal(tall, "doc_id", size)
        short = materialize(_times(entries, tall, "doc_id", "term_id", size))
        values, vectors = np.linalg.eigh(_gram(short, size))
        values, vectors = values[::-1], vectors[:, ::-1]
        if before is not None and np.all(np.abs(values[:k] - before) <= tolerance * np.maximum(values[0], 1e-300)):
            break
        before = values[:k]
        tall = materialize(_times(entries, short, "term_id", "doc_id", size))
    singular = np.sqrt(np.maximum(values[:k], 0.0))
    inverse = np.where(singular > singular.max(initial=0.0) * 1e-7, 1.0 / np.where(singular > 0, singular, 1.0), 0.0)
    terms = materialize(_mapped(short, "term_id", vectors[:, :k] * inverse))
    heads = terms.agg(*[F.max_by(f"f{t}", F.struct(F.abs(f"f{t}"), -F.col("term_id"))) for t in range(k)]).first()
    signs = np.array([-1.0 if h is not None and h < 0 else 1.0 for h in heads])
    terms = _mapped(terms, "term_id", np.diag(signs))
    return _times(entries, terms, "term_id", "doc_id", k), terms, singular


def nmf(rows: DataFrame, width: int, k: int, iterations: int = 200, seed: int = 42, tolerance: float = 1e-3):
    """(doc_topics, topic_terms, errors): multiplicative updates.

    Rounds end when the error falls by less than ``tolerance`` of itself, or after ``iterations``. Both factors are
    tables, keyed by document and by term and rewritten per round; their products with the corpus are joins and
    sums, and only k x k matrices are on the driver, so vocabulary and corpus may have any size.
    """
    entries = materialize(_entries(rows))
    whole = entries.agg(F.sum(F.col("val") * F.col("val"))).first()[0] or 0.0

    def first(table, key):
        return materialize(table.select(key).distinct().select(key, *[
            (hash_unit(F.col(key).cast("string"), key, str(t + 1), seed) + 0.1).alias(f"f{t}") for t in range(k)]))

    def update(factors, key, pulled, gram):
        """factors * pulled / (factors x gram)"""
        drawn = [f"p{t}" for t in range(k)]

        def run(batches):
            for pdf in batches:
                f, p = pdf[names].to_numpy(), pdf[drawn].to_numpy()
                pdf[names] = f * p / (f @ gram + EPS)
                yield pdf

        met = factors.join(pulled.withColumnsRenamed(dict(zip(names, drawn))), key, "left").fillna(0.0)
        return materialize(met.mapInPandas(run, met.schema))

    names = [f"f{t}" for t in range(k)]
    weights, topics, errors = first(rows, "doc_id"), first(entries, "term_id"), []
    topic_gram = _gram(topics, k)
    for _ in range(iterations):
        weights = update(weights, "doc_id", _times(entries, topics, "term_id", "doc_id", k), topic_gram)
        gram, cross = _gram(weights, k), float(np.trace(_gram(weights, k, "p")))
        errors.append(whole - 2.0 * cross + float((gram * topic_gram).sum()))
        if len(errors) > 1 and errors[-2] - errors[-1] < tolerance * errors[-2]:
            break
        weights = weights.select("doc_id", *names)
        topics = update(topics, "term_id", _times(entries, weights, "doc_id", "term_id", k), gram).select("term_id", *names)
        topic_gram = _gram(topics, k)
    docs = weights.select("doc_id", F.posexplode(F.array(*names)).alias("topic", "p"))
    return docs, topics.select("term_id", F.posexplode(F.array(*names)).alias("topic", "weight")).select("topic", "term_id", "weight"), errors


def word2vec(token_lists: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(doc_id, v): averaged word vectors, standing in for paragraph vectors."""
    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="tokens", outputCol="_v",
                     numPartitions=parallelism(token_lists)).fit(token_lists)
    return model.transform(token_lists).select("doc_id", vector_to_array("_v").alias("v"))


def hashed_ngrams(texts: list[str], size: int = 64) -> np.ndarray:
    """Default batch encoder: signed counts of hashed character trigrams, unit length."""
    import zlib

    out = np.zeros((len(texts), size))
    for row, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "ignore")
        codes = np.array([zlib.crc32(raw[n : n + 3]) for n in range(max(1, len(raw) - 2))])
        np.add.at(out[row], codes % size, np.where(codes >> 31, 1.0, -1.0))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1.0, norm)


def embed(docs: DataFrame, encoder=hashed_ngrams, text: str = "text") -> DataFrame:
    """(doc_id, v) from a caller-supplied batch encoder ``list[str] -> matrix``."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "v": list(encoder(pdf[text].tolist()))})

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, v array<double>")


def connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(space, id, root): smallest id reachable over the edges (space, i, j).

    Each round every node takes the smallest label among its neighbours and the label of its
    own label, so chains halve per round; labels are written between rounds.
    """
    both = materialize(edges.select("space", "i", "j").union(edges.select("space", "j", "i")).distinct())
    labels = materialize(nodes.select("space", "id", F.col("id").alias("root")))
    for _ in range(max_rounds):
        seen = both.join(labels, (both.space == labels.space) & (both.j == labels.id)).groupBy(
            both.space, both.i.alias("id")).agg(F.min("root").alias("_near"))
        step = labels.join(seen, ["space", "id"], "left").withColumn(
            "_new", F.least("root", F.coalesce("_near", "root")))
        jump = labels.select("space", F.col("id").alias("_new"), F.col("root").alias("_jump"))
        out = step.join(jump, ["space", "_new"], "left").select(
            "space", "id", F.least("_new", F.coalesce("_jump", "_new")).alias("_root"), F.col("root").alias("_old"))
        out = materialize(out)
        labels = out.select("space", "id", F.col("_root").alias("root"))
        if out.filter(F.col("_root") != F.col("_old")).isEmpty():
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest member per node) after joining the components of a[n] and b[n]."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def radius_forest(points: DataFrame, epsilon: float, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """(space, i, j): pairs within ``epsilon`` that connect what all pairs within ``epsilon`` connect.

    A block pair looks at all its pairs and keeps a star per component, so rows grow with points and blocks, however
    many pairs a dense group has.
    """

    def run(key, left, right, _):
        rows, cols = left["id"].to_numpy(), right["id"].to_numpy()
        ids = np.unique(np.concatenate([rows, cols]))
        row_at, col_at, root = np.searchsorted(ids, rows), np.searchsorted(ids, cols), np.arange(len(ids))
        for part, (dist,) in distances(left, right, [("v", metric)]):
            full = dist.matrix()
            r, c = np.nonzero(full <= epsilon + 2.0 * dist.tol)
            if dist.tol:
                border = np.flatnonzero(full[r, c] >= epsilon - 2.0 * dist.tol)
                far = border[~(dist.exact(r[border], c[border]) <= epsilon)]
                r, c = np.delete(r, far), np.delete(c, far)
            root = _united(root, row_at[part][r], col_at[c])
        held = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"space": [key[0]] * len(held), "i": ids[root[held]], "j": ids[held]})

    kind = points.schema["space"].dataType.simpleString()
    return pair_blocks(points.select("space", "id", "v"), run, f"space {kind}, i long, j long", half=True, block_rows=block_rows)


def density_topics(points: DataFrame, epsilon: float, min_size: int = 15, k: int = 15,
                   metric: str = "euclidean", near: DataFrame | None = None) -> DataFrame:
    """(space, id, topic): components of mutual reachability at most ``epsilon``.

    The core distance is the distance to the k-th neighbour; all pairs of such dense points within ``epsilon`` are
    partners, not only the k nearest. Components under ``min_size`` become noise (-1). A fixed-radius variant of
    hierarchical density clustering. ``near`` is the table of ``knn`` for this k and metric, where the caller has
    searched it already.
    """
    if near is None:
        near = materialize(knn(points.select("space", "id", "v"), k, metric))
    core = near.filter(F.col("r") == k).select("space", F.col("i").alias("id"), F.col("d").alias("core"))
    dense = points.select("space", "id", "v").join(core.filter(F.col("core") <= epsilon).select("space", "id"), ["space", "id"], "left_semi")
    roots = connected(points, radius_forest(materialize(dense), epsilon, metric))
    sizes = roots.groupBy("space", "root").agg(F.count("*").alias("_n"))
    return roots.join(sizes, ["space", "root"]).select(
        "space", "id", F.when(F.col("_n") >= min_size, F.col("root")).otherwise(-1).alias("topic"))


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "topic")


def extreme_topics(priors: DataFrame, n: int) -> DataFrame:
    """Topics with the n smallest and n largest priors (frame: topic, alpha)."""
    low = priors.orderBy("alpha", "topic").limit(n)
    high = priors.orderBy(F.desc("alpha"), "topic").limit(n)
    return low.union(high).distinct()


def combined_space(doc_topics: DataFrame, topic_terms: DataFrame, k: int) -> DataFrame:
    """(doc_id, v): k numbers a document whose lengths, products and distances are those of the linear combinations.

    A linear combination has a weight for every term of the vocabulary, Σ p(topic | doc) · weight(topic, term). All
    of them lie in the space the k topics span, so documents x vocabulary is never formed: with R Rᵀ the products of
    the topics over the whole vocabulary, p · R has the same geometry. No term is left out.
    """
    from steadymap.operators.vectors import dense_rows

    one = lambda t: F.sum(F.when(F.col("topic") == t, F.col("weight")).otherwise(0.0)).alias(f"f{t}")
    gram = _gram(topic_terms.groupBy("term").agg(*[one(t) for t in range(k)]), k)
    values, vectors = np.linalg.eigh(gram)
    root = vectors * np.sqrt(np.maximum(values, 0.0))
    rows = dense_rows(doc_topics.select("doc_id", F.col("topic").cast("int").alias("topic"), "p"), k)
    axis = lambda j: sum((F.col("v")[t] * float(root[t, j]) for t in range(k)), F.lit(0.0))
    return rows.select("doc_id", F.array(*[axis(j) for j in range(k)]).alias("v"))


#: Names of the spaces of the study.
SPACES = ("bow", "tfidf", "lda", "lda_linear_combined", "lsi", "lsi_linear_combined", "lsi_tfidf", "lsi_linear_combined_tfidf", "nmf",
          "nmf_linear_combined", "nmf_tfidf", "nmf_linear_combined_tfidf", "bert", "doc2vec")


def build_space(name: str, token_lists: DataFrame, k: int = 5, encoder=hashed_ngrams, **params) -> DataFrame:
    """(doc_id, v) of a named space: sparse rows for ``bow`` and ``tfidf``, k numbers otherwise.

    ``tfidf`` in the name of a topic model trains it on weighted rows. ``linear_combined`` gives ``combined_space``,
    the geometry of the whole combination. ``bert`` encodes texts by the caller's encoder (hashed n-grams by
    default). ``params`` go to the topic model.
    """
    from steadymap.operators import vectors

    if name not in SPACES:
        raise ValueError(f"unknown space {name!r}")
    if name == "doc2vec":
        return word2vec(token_lists, k, **params)
    if name == "bert":
        return embed(token_lists.select("doc_id", F.array_join("tokens", " ").alias("text")), encoder)
    token_lists = materialize(token_lists.select("doc_id", "tokens"))  # texts are split once, not again for the number of documents
    counts = materialize(vectors.bow(token_lists))
    terms = materialize(vectors.dictionary(counts))
    if "tfidf" in name:
        weighted = vectors.tfidf(counts, token_lists.select("doc_id").distinct().count())
        rows = vectors.sparse_rows(weighted, terms, "w")
    else:
        rows = vectors.sparse_rows(counts, terms)
    if name in ("bow", "tfidf"):
        return rows
    rows = materialize(rows)
    train = {"lda": lda, "lsi": lsi, "nmf": nmf}[name.split("_")[0]]
    doc_topics, topic_terms = train(rows, terms.count(), k, **params)[:2]
    if "linear_combined" not in name:
        return vectors.dense_rows(doc_topics.select("doc_id", F.col("topic").cast("int").alias("topic"), "p"), k)
    return combined_space(doc_topics, topic_terms.select("topic", F.col("term_id").alias("term"), "weight"), k)


def evaluate(token_lists: DataFrame, topic_words: DataFrame, model_type: str, n_topics: int, alpha: str = "",
             perplexity: float = -1.0) -> DataFrame:
    """The quality row of a topic model: four coherences, each the mean over its topics, and the perplexity (-1: none)."""
    row = token_lists.sparkSession.createDataFrame([(model_type, n_topics, alpha)], "model_type string, n_topics int, alpha_lda string")
    near = _pairs(token_lists, topic_words, 10)  # two coherences have the same windows
    for name, of, known in (("u_mass", coherence_umass, {}), ("c_v", coherence_cv, {}), ("c_uci", coherence_uci, {"pairs": near}),
                            ("c_npmi", coherence_npmi, {"pairs": near})):
        # one row each
        row = row.join(F.broadcast(of(token_lists, topic_words, **known).agg(F.avg("coherence").alias(f"coherence_{name}"))))
    return row.withColumn("perplexity", F.lit(float(perplexity)))
