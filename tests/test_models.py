"""Properties of iterative models: objectives fall, results repeat, structure is found."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadymap.operators import projection, text, topics, vectors


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    groups = [["apple", "pear", "plum", "grape"], ["train", "plane", "truck", "ship"]]
    rows = [(n, [str(w) for w in rng.choice(groups[n % 2], 12)]) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    counts = vectors.bow(docs)
    terms = vectors.dictionary(counts)
    return docs, vectors.sparse_rows(counts, terms), terms, 8


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(c, 0.3, (30, 5)) for c in (0, 4, 8)])
    return spark.createDataFrame([("a", int(n), [float(x) for x in r]) for n, r in enumerate(v)],
                                 "space string, id long, v array<double>")


def test_dictionary_by_hand(spark):
    docs = spark.createDataFrame([(2, ["b", "a"]), (1, ["c", "b", "b"])], "doc_id long, tokens array<string>")
    got = {r["term"]: (r["term_id"], r["df"], r["cf"]) for r in vectors.dictionary(vectors.bow(docs)).collect()}
    assert got == {"b": (0, 2, 3), "c": (1, 1, 1), "a": (2, 1, 1)}


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c", "c"]), (4, ["a", "c"])],
                                 "doc_id long, tokens array<string>")
    got = {(r["doc_id"], r["term"]): r["w"] for r in vectors.tfidf(vectors.bow(docs), 4).collect()}
    a, b = np.log2(4 / 3), 2.0
    assert got[(1, "a")] == pytest.approx(a / np.hypot(a, b))
    assert got[(2, "a")] == pytest.approx(1.0)


def test_nmf_error_never_rises(corpus):
    _, rows, _, width = corpus
    docs, terms, errors = topics.nmf(rows, width, 2, 6)
    assert all(b <= a + 1e-6 for a, b in zip(errors, errors[1:]))
    assert docs.filter("p < 0").isEmpty() and terms.filter("weight < 0").isEmpty()


def test_topic_models_separate_the_groups(corpus):
    _, rows, terms, width = corpus
    for docs in (topics.lda(rows, width, 2)[0], topics.nmf(rows, width, 2, 15)[0]):
        best = docs.groupBy("doc_id").agg(F.max_by("topic", "p").alias("t")).toPandas()
        sides = best.groupby(best["doc_id"] % 2)["t"].nunique()
        assert sides.tolist() == [1, 1]


def test_lsi_keeps_the_leading_energy(corpus):
    _, rows, _, width = corpus
    dense = np.zeros((40, width))
    for r in rows.collect():
        dense[r["doc_id"], r["v"]["idx"]] = r["v"]["val"]
    docs, _ = topics.lsi(rows, width, 2)
    energy = docs.agg(F.sum(F.col("p") ** 2)).first()[0]
    assert energy == pytest.approx((np.linalg.svd(dense, compute_uv=False)[:2] ** 2).sum(), rel=1e-6)


def test_window_counts_against_brute_force(spark):
    tokens = ["a", "x", "b", "a", "c", "x", "b"]
    docs = spark.createDataFrame([(1, tokens), (2, ["a"])], "doc_id long, tokens array<string>")
    top = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "topic int, word string, rank int")
    got = {(r["w1"], r["w2"]): r["n"] for r in topics.window_counts(docs, top, 3).collect()}
    windows = [set(tokens[s : s + 3]) for s in range(5)] + [{"a"}]
    assert got[(None, None)] == len(windows)
    for p in "abc":
        for q in "abc":
            assert got.get((p, q), 0) == sum(p in w and q in w for w in windows)


def test_components_cross_long_chains(spark):
    nodes = spark.createDataFrame([("a", n) for n in range(70)], "space string, id long")
    edges = spark.createDataFrame([("a", n, n + 1) for n in range(64)], "space string, i long, j long")
    got = topics.connected(nodes, edges).toPandas().set_index("id")["root"].sort_index()
    assert (got[:65] == 0).all() and got[65:].tolist() == list(range(65, 70))


def test_density_topics_find_blobs(blobs):
    got = topics.density_topics(blobs, 1.2, min_size=10, k=5).toPandas()
    found = got[got["topic"] >= 0]
    assert found["topic"].nunique() == 3
    assert found.groupby(found["id"] // 30)["topic"].nunique().tolist() == [1, 1, 1]


def test_mds_stress_falls(blobs):
    _, stress = projection.mds(blobs, iterations=5, block_rows=32)
    assert all(b <= a + 1e-9 for a, b in zip(stress, stress[1:]))


def test_som_error_falls_and_units_fit(blobs):
    layout, errors = projection.som(blobs, 4, 4, 5)
    assert errors[-1] < errors[1] and layout.count() == 90


def _separates(layout):
    pdf = layout.toPandas().sort_values("id")
    xy, label = pdf[["x", "y"]].to_numpy(), pdf["id"].to_numpy() // 30
    d = np.square(xy[:, None] - xy[None]).sum(-1)
    np.fill_diagonal(d, np.inf)
    return (label[d.argmin(axis=1)] == label).mean()


def test_tsne_and_umap_keep_blobs_together(blobs):
    near = projection.tsne(blobs, 8.0, iterations=24, learning_rate=100.0, exaggeration=4.0, exaggerated=24)
    assert _separates(near) > 0.85
    assert _separates(projection.umap(blobs, 8, epochs=16)) > 0.7  # a third by chance


def test_seeded_layouts_repeat_for_any_blocking(blobs):
    a, b = (projection.mds(blobs, iterations=2, block_rows=n)[0].orderBy("id").toPandas() for n in (16, 512))
    assert np.allclose(a[["x", "y"]], b[["x", "y"]])


def test_pca_is_centred_and_keeps_the_variance(blobs):
    rows, _ = projection.pca(blobs)
    got = np.stack(rows.orderBy("id").toPandas()["v"])
    v = np.stack(blobs.orderBy("id").toPandas()["v"])
    s = np.linalg.svd(v - v.mean(0), compute_uv=False)
    assert np.allclose(got.mean(0), 0, atol=1e-9) and np.allclose(np.square(got).sum(0), s[:2] ** 2)


def test_nmf_stops_when_it_has_converged(corpus):
    _, rows, _, width = corpus
    errors = topics.nmf(rows, width, 2, 100, tolerance=0.01)[2]
    assert len(errors) < 100 and errors[-2] - errors[-1] < 0.01 * errors[-2]


def test_pca_share(blobs):
    assert projection.pca_for_share(blobs, 5, 0.9).first()["v"].__len__() == 1


def test_lemma_table_keeps_order(spark):
    docs = spark.createDataFrame([(1, ["cats", "see", "dogs"])], "doc_id long, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    assert text.lemmatize(docs, lemmas).first()["tokens"] == ["cat", "see", "dog"]


def test_word_index_by_frequency_then_term(spark):
    terms = ["b", "ba", "bb", "é", "a", "ab", "aa", "𝄞", "z", "日本"]
    docs = spark.createDataFrame([(1, terms), (2, terms[:3]), (3, terms[2:5])], "doc_id long, tokens array<string>")
    count = {t: terms.count(t) + terms[:3].count(t) + terms[2:5].count(t) for t in terms}
    want = sorted(terms, key=lambda t: (-count[t], t))
    got = {r["term"]: r["idx"] for r in text.word_index(docs).collect()}
    assert got == {t: n + 1 for n, t in enumerate(want)}
