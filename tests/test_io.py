"""Readers and writers on small folders made by the tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadymap.plans import results
from steadymap.sources import corpora, layouts, sinks


def test_directory_corpus_keeps_every_character(spark, tmp_path):
    (tmp_path / "mail" / "work").mkdir(parents=True)
    (tmp_path / "mail" / "home" / "deep").mkdir(parents=True)
    (tmp_path / "mail" / "work" / "a.txt").write_bytes("café 5 €".encode("windows-1252"))
    (tmp_path / "mail" / "home" / "deep" / "b.txt").write_bytes(b"plain")
    rows = corpora.directory_corpus(spark, str(tmp_path / "mail")).collect()
    assert {(r["text"], r["category"]) for r in rows} == {("café 5 €", "work"), ("plain", "home")}


def test_csv_corpora(spark, tmp_path):
    (tmp_path / "e.csv").write_text(' Books ,"a ""quoted"" text\nover two lines "\n')
    assert corpora.read_corpus(spark, "ecommerce", str(tmp_path / "e.csv")).select("text", "category").collect() == [
        ('a "quoted" text\nover two lines', "Books")]
    (tmp_path / "b.tsv").write_text("category\ttitle\tcontent\nsport\tGoal\tIt was one\n")
    assert corpora.titled_news(spark, str(tmp_path / "b.tsv")).select("text", "category").collect() == [
        ("Goal It was one", "sport")]
    (tmp_path / "l.csv").write_text('lyrics,genere\n"la la",Pop\n')
    assert corpora.lyrics(spark, str(tmp_path / "l.csv")).select("text", "category").collect() == [("la la", "Pop")]
    (tmp_path / "n.csv").write_text("text,label\nnews,3\n")
    assert corpora.labelled_csv(spark, str(tmp_path / "n.csv")).select("text", "category").collect() == [("news", "3")]
    with pytest.raises(ValueError):
        corpora.read_corpus(spark, "nothing", "x")


def test_bare_newsgroups(spark, tmp_path):
    path = str(tmp_path / "news")
    spark.createDataFrame([(1, "From: a\nTo: b\n\n> old\nnew\n", "x")], "doc_id long, text string, category string"
                          ).write.parquet(path)
    assert corpora.newsgroups(spark, path, bare=True).first()["text"] == "new\n"


def test_layouts_and_labels(spark, tmp_path):
    run = tmp_path / "random_seed_7" / "jitter_amount_0.25"
    run.mkdir(parents=True)
    np.save(run / "with.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    (run / "with.png").write_bytes(b"picture")
    np.save(run / "without.npy", np.zeros((2, 2)))
    np.save(run / "y.npy", np.array([0, 1]))
    got = layouts.read_layouts(spark, str(tmp_path)).orderBy("point_id").select("point_id", "x", "y", "seed", "jitter")
    assert got.collect() == [(0, 1.0, 2.0, 7, 0.25), (1, 3.0, 4.0, 7, 0.25)]
    assert [r["y"] for r in layouts.read_labels(spark, str(tmp_path)).orderBy("point_id").collect()] == [0, 1]
    np.save(run / "with.npy", np.zeros((2, 3)))
    with pytest.raises(Exception, match="3 columns, not 2"):
        layouts.read_layouts(spark, str(tmp_path)).collect()


def test_append_skips_stored_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, i % 2, 0.5) for i in ids], "a long, b long, m double")
    assert sinks.append_comparisons(rows(1, 2), path, ["a", "b"]) == 2
    assert sinks.append_comparisons(rows(2, 3), path, ["a", "b"]) == 1
    assert spark.read.parquet(path).count() == 3


def test_scores_replace_one_run_only(spark, tmp_path):
    path = str(tmp_path / "scores")
    row = lambda run, v: spark.createDataFrame([("d", run, v)], "dataset string, run_id string, m double")
    sinks.write_layout_scores(row("a", 1.0).union(row("b", 2.0)), path)
    sinks.write_layout_scores(row("a", 3.0), path)
    assert {(r["run_id"], r["m"]) for r in spark.read.parquet(path).collect()} == {("a", 3.0), ("b", 2.0)}


def test_tables_and_words(spark, tmp_path):
    words = spark.createDataFrame([(0, 2, "b", 0.1), (0, 1, "a", 0.9)], "topic int, rank int, word string, weight double")
    sinks.write_topic_words(words, str(tmp_path / "w"))
    back = layouts.read_metric_tables(spark, str(tmp_path / "w"), "topic_num int, word string, prob double")
    assert {(r["word"], r["prob"]) for r in back.collect()} == {("a", 0.9), ("b", 0.1)}
    layout = spark.createDataFrame([(0, 1.0, 2.0)], "point_id long, x double, y double")
    sinks.write_layout(layout, spark.createDataFrame([(0, 5)], "point_id long, y_label int"), str(tmp_path / "l"))
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).first().asDict() == {"x": "1.0", "y": "2.0", "classes": "5"}


def test_cached_tokens_are_built_once(spark, tmp_path):
    calls = []

    def build(docs):
        calls.append(1)
        return docs.select("id", F.array(F.lit("t")).alias("tokens"))

    docs = spark.range(2)
    for _ in range(2):
        assert sinks.cached_tokens(docs, build, "k", str(tmp_path)).count() == 2
    assert len(calls) == 1


def test_cleaning_on_five_rows(spark):
    rows = [(1, "lyrics/som_bow_1", "lyrics/som_bow_2"), (2, "lyrics/som_bow_2", "lyrics/som_bow_1"),
            (3, "lyrics/som_bow_2", "lyrics/som_bow_1"), (4, "lyrics/som_bow_3", "lyrics/som_bow_3"),
            (5, "file_name_1", "file_name_2")]
    raw = spark.createDataFrame([(p, "lyrics", a, b) for p, a, b in rows],
                                "pos long, dataset string, file_name_1 string, file_name_2 string")
    got = results.clean_seed(raw).collect()
    assert [(r["pos"], r["config"], r["TM"]) for r in got] == [(2, "som", "bow")]


def test_binomial_tail():
    import pandas as pd

    got = results.binomial_tail(pd.Series([0, 3, 5]), pd.Series([5, 5, 5]))
    assert got.tolist() == pytest.approx([1.0, 0.5, 1 / 32])
    import math

    for n in (1, 2, 7, 60, 421, 1500):
        ks = sorted({0, 1, n // 3, n // 2, n // 2 + 1, 2 * n // 3, n - 1, n, n + 1})
        want = [sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n for k in ks]
        assert results.binomial_tail(pd.Series(ks), pd.Series([n] * len(ks))).tolist() == want
    assert 0 < results.binomial_tail(pd.Series([5100]), pd.Series([10_000]))[0] < 0.05


def test_equal_rows_stay_different_documents(spark, tmp_path):
    from steadymap.sources import corpora

    (tmp_path / "a.csv").write_text('lyrics,genere\n"la la",x\n"la la",x\n"lo",y\n')
    rows = corpora.lyrics(spark, str(tmp_path / "a.csv")).collect()
    assert len({r.doc_id for r in rows}) == 3 and [r.text for r in rows].count("la la") == 2


def test_footers(spark):
    from steadymap.sources.corpora import without_footer

    texts = ["body\nmore\n--\nname\nplace", "body\n\nsigned", "no footer\n", "--\nall", "", "a\n - \nb", "a\n---\nb\n \n", "\n\nx\n\ny\n\nz"]

    def plain(text):
        lines = text.strip().split("\n")
        for at in range(len(lines) - 1, -1, -1):
            if lines[at].strip().strip("-") == "":
                return "\n".join(lines[:at]) if at > 0 else text
        return text

    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = {r.n: r.t for r in rows.select("n", without_footer(rows.text).alias("t")).collect()}
    assert [got[n] for n in range(len(texts))] == [plain(t) for t in texts]


def test_ids_do_not_depend_on_how_files_are_packed(spark, tmp_path):
    from steadymap.sources import corpora

    for k in range(6):
        (tmp_path / f"{k}.csv").write_text("text,label\n" + "".join(f"same {n % 2},l\n" for n in range(4)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = []
    for cost in ("1b", "100m"):
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        found.append(sorted((r.doc_id, r.text) for r in corpora.labelled_csv(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert found[0] == found[1] and len({i for i, _ in found[0]}) == 24
