"""From raw comparison tables to cleaned tables, coverage, scores and sign tests."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadymap.functions.naming import family, jitter_pair, model_reduction, relative_path
from steadymap.functions.scoring import combined_scores

HEADER = "file_name_1"


def drop_headers(rows: DataFrame) -> DataFrame:
    """Repeated header rows of concatenated files."""
    return rows.filter(F.col("file_name_1") != HEADER)


def valid_distance(path: Column) -> Column:
    """LDA layouts need their own distance (and no fixed prior), NMF layouts the cosine, and
    nothing else the LDA distance."""
    has = lambda *names: reduce(lambda a, b: a | b, [F.contains(path, F.lit(n)) for n in names])
    reduced = has("umap_", "tsne_", "mds_")
    return (
        F.when(has("lda") & has("symmetric", "asymmetric"), False)
        .when(has("lda") & reduced, has("jensenshannon"))
        .when(has("nmf") & reduced, has("cosine"))
        .otherwise(~has("jensenshannon")))


def relative_names(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: relative_path(F.col(c), F.col("dataset"))
                             for c in ("file_name_1", "file_name_2")})


def keep_first(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """One row per key, the first by ``order``; folded before the shuffle, so repeats are cheap."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("_f"))
    return first.select(*keys, "_f.*").select(*rows.columns)


def drop_mirrored(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Drop self-pairs and every row whose mirror image comes later.

    Both directions of a pair share one key, so one window over it replaces the search for
    partners. Rows must be distinct, which bounds every group.
    """
    low, high = F.least("file_name_1", "file_name_2"), F.greatest("file_name_1", "file_name_2")
    keyed = rows.withColumns({"_a": low, "_b": high, "_fwd": F.col("file_name_1") == low})
    pair = Window.partitionBy("dataset", "_a", "_b")
    last = lambda fwd: F.max(F.when(F.col("_fwd") == fwd, F.col(order))).over(pair)
    opposite = F.when(F.col("_fwd"), F.col("_last_b")).otherwise(F.col("_last_f"))
    return (
        keyed.withColumns({"_last_f": last(True), "_last_b": last(False)})
        .filter((F.col("_a") != F.col("_b")) & (opposite.isNull() | (opposite < F.col(order))))
        .drop("_a", "_b", "_fwd", "_last_f", "_last_b"))


def parse_runs(rows: DataFrame) -> DataFrame:
    """Add config and TM; keep rows whose two files name the same reduction and model."""
    dr1, tm1 = model_reduction(F.col("file_name_1"))
    dr2, tm2 = model_reduction(F.col("file_name_2"))
    named = rows.withColumns({"config": dr1, "TM": tm1, "_d": dr2, "_t": tm2})
    same = (F.col("config") == F.col("_d")) & (F.col("TM") == F.col("_t"))
    return named.filter(same & (F.col("config") != "") & (F.col("TM") != "")).drop("_d", "_t")


def matching_config(config: Column, model: Column) -> Column:
    """Both names contain the reduction and the lower-cased model; BOW rows may name tf-idf."""
    dr = F.translate(config, "012", "")
    both = lambda t: F.contains("file_name_1", t) & F.contains("file_name_2", t)
    tm = F.lower(model)
    return both(dr) & (both(tm) | ((tm == "bow") & both(F.lit("tfidf"))))


def clean_hyperparameter(rows: DataFrame) -> DataFrame:
    """Rows: pos, dataset, config, short_tm_name, file_name_1, file_name_2, metrics."""
    rows = relative_names(rows.filter(valid_distance(F.col("file_name_1"))))
    rows = keep_first(rows, ["dataset", "config", "short_tm_name", "file_name_1", "file_name_2"])
    return drop_mirrored(rows).filter(matching_config(F.col("config"), F.col("short_tm_name")))


def clean_seed(rows: DataFrame) -> DataFrame:
    rows = parse_runs(drop_headers(rows)).filter(valid_distance(F.col("file_name_1")))
    rows = keep_first(relative_names(rows), ["dataset", "file_name_1", "file_name_2"])
    return drop_mirrored(rows)


def undesired_jitter(low: float = 0.1, high: float = 0.25) -> Column:
    pair = jitter_pair(F.col("jitter_1"), F.col("jitter_2"))
    return F.coalesce((pair["low"] == low) & (pair["high"] == high), F.lit(False))


def clean_jitter(rows: DataFrame) -> DataFrame:
    return clean_seed(drop_headers(rows).filter(~undesired_jitter()))


def unify(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Result tables of several folders as one, without those already post-processed."""
    raw = [t for t in tables if not ("TM" in t.columns or
                                     ("config" in t.columns and "short_tm_name" not in t.columns))]
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), raw), keys)


# Comparisons possible per config, and models per family.
EXPECTED_2 = {"mds": 4, "som0": 30, "som1": 30, "umap0": 35, "umap1": 36, "tsne0": 100,
              "tsne1": 96, "tsne2": 90}
FAMILY_FACTOR = {"LDA": 2, "LSI": 4, "NMF": 4, "bert_all_distilroberta_v1": 1,
                 "bert_all_mpnet_base_v2": 1, "BOW": 2, "doc2vec": 1}
EXPECTED_3 = {"mds": 5, "som": 36, "umap": 42, "tsne": 144}
EXPECTED_4 = {c: 2 * n for c, n in EXPECTED_3.items()}


def expected_counts(spark, configs: dict[str, int], models: dict[str, int]) -> DataFrame:
    rows = [(c, m, n * f) for c, n in configs.items() for m, f in models.items()]
    return spark.createDataFrame(rows, "config string, TM string, expected long")


def coverage(rows: DataFrame, configs: dict[str, int], models: dict[str, int], model: str = "TM",
             substring: bool = False, factor: int = 1) -> DataFrame:
    """(config, TM, present, expected, percent) and a total row with NULL keys.

    ``substring`` files a row under every listed model its name contains.
    """
    if substring:
        listed = F.array(*[F.lit(m) for m in models])
        rows = rows.select("config", F.explode(F.filter(
            listed, lambda m: F.contains(F.col(model), m))).alias("TM"))
    else:
        rows = rows.select("config", F.col(model).alias("TM"))
    found = rows.groupBy("config", "TM").agg(F.count("*").alias("present"))
    expected = expected_counts(rows.sparkSession, configs, models)
    each = expected.join(found, ["config", "TM"], "left").select(
        "config", "TM", F.coalesce("present", F.lit(0)).alias("present"),
        (F.col("expected") * factor).alias("expected"))
    both = each.groupingSets([[F.col("config"), F.col("TM")], []], "config", "TM").agg(
        F.sum("present").alias("present"), F.sum("expected").alias("expected"))
    return both.withColumn("percent", 100 * F.col("present") / F.col("expected"))


def missing_configs(rows: DataFrame, required: list[str]) -> DataFrame:
    wanted = rows.sparkSession.createDataFrame([(c,) for c in required], "config string")
    return wanted.join(rows.select("config").distinct(), "config", "left_anti")


def score_table(rows: DataFrame, model: str = "TM") -> DataFrame:
    """(dataset, config, TM family, alpha, beta, gamma)."""
    return combined_scores(rows).select(
        "dataset", "config", family(F.col(model)).alias("TM"), "alpha", "beta", "gamma")


def adjust_for_jitter(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """1 - |score - score of the word counts themselves at that jitter|, per row.

    ``corpus`` has one metric row per (dataset, jitter_2); the larger jitter of a row counts.
    """
    level = combined_scores(corpus).select("dataset", F.col("jitter_2").alias("high"), *[
        F.col(s).alias(f"_{s}") for s in ("alpha", "beta", "gamma")])
    pair = jitter_pair(F.col("jitter_1"), F.col("jitter_2"))
    scored = combined_scores(rows).withColumns({"low": pair["low"], "high": pair["high"]})
    return scored.filter(F.col("high").isNotNull()).join(level, ["dataset", "high"]).withColumns(
        {f"{s}_adjust": 1 - F.abs(F.col(s) - F.col(f"_{s}")) for s in ("alpha", "beta", "gamma")})


def tfidf_partner(column: Column) -> Column:
    """Name of the same run on tf-idf weights; NULL for models that have none."""
    has = lambda n: F.contains(column, F.lit(n))
    swap = lambda a, b: F.replace(column, F.lit(a), F.lit(b))
    return (
        F.when(has("tfidf"), None).when(has("bow"), swap("bow", "tfidf"))
        .when(has("lsi_linear_combined"), swap("lsi_linear_combined", "lsi_linear_combined_tfidf"))
        .when(has("lsi"), swap("lsi", "lsi_tfidf"))
        .when(has("nmf_linear_combined"), swap("nmf_linear_combined", "nmf_linear_combined_tfidf"))
        .when(has("nmf"), swap("nmf", "nmf_tfidf")))


def linear_partner(column: Column) -> Column:
    """Name of the same run in vocabulary space; NULL for models that have none."""
    has = lambda n: F.contains(column, F.lit(n))
    swap = lambda a, b: F.replace(column, F.lit(a), F.lit(b))
    return (
        F.when(has("linear_combined"), None).when(has("lda"), swap("lda", "lda_linear_combined"))
        .when(has("lsi_tfidf"), swap("lsi_tfidf", "lsi_linear_combined_tfidf"))
        .when(has("lsi_n"), swap("lsi_n", "lsi_linear_combined_n"))
        .when(has("nmf_tfidf"), swap("nmf_tfidf", "nmf_linear_combined_tfidf"))
        .when(has("nmf_n"), swap("nmf_n", "nmf_linear_combined_n")))


TREATMENTS = {"tfidf": (tfidf_partner, ["bow", "lsi", "nmf"]),
              "linear_combined": (linear_partner, ["lda", "lsi", "nmf"])}


def improvements(rows: DataFrame, treatment: str) -> DataFrame:
    """(model, reduction, samples, n_alpha, n_beta, n_gamma): pairs where the treated run scores
    higher than its baseline. Partners that are missing or not unique are skipped.

    ``rows`` has dataset, file_name_1, file_name_2, alpha, beta, gamma.
    """
    partner, models = TREATMENTS[treatment]
    scores = ["alpha", "beta", "gamma"]
    base = rows.select(
        "dataset", partner(F.col("file_name_1")).alias("_k1"), partner(F.col("file_name_2")).alias("_k2"),
        F.coalesce(*[F.when(F.contains("file_name_1", F.lit(m)), F.lit(m)) for m in models]).alias("model"),
        model_reduction(F.col("file_name_1"))[0].alias("reduction"), *scores)
    base = base.filter(F.col("_k1").isNotNull() & F.col("model").isNotNull() & (F.col("reduction") != ""))
    treated = rows.groupBy("dataset", F.col("file_name_1").alias("_k1"), F.col("file_name_2").alias("_k2")).agg(
        F.count("*").alias("_c"), *[F.first(s).alias(f"t_{s}") for s in scores]).filter("_c = 1")
    return base.join(treated, ["dataset", "_k1", "_k2"]).groupBy("model", "reduction").agg(
        F.count("*").alias("samples"),
        *[F.count_if(F.col(f"t_{s}") > F.col(s)).alias(f"n_{s}") for s in scores])


def binomial_tail(hits: pd.Series, samples: pd.Series) -> pd.Series:
    """P(X >= hits) for X ~ Binomial(samples, 1/2), one value per result row."""

    def upper(k, n):
        # from k > n / 2 on, terms fall; whole numbers, each stepped from the last, until no double can tell the rest
        term, total = math.comb(n, k) if k <= n else 0, 0
        while term and term * (n - k + 1) << 80 > total:
            total += term
            term, k = term * (n - k) // (k + 1), k + 1
        return total

    def tail(k, n):
        k = max(k, 0)
        whole = 1 << n
        return (upper(k, n) if 2 * k > n else whole - upper(n - k + 1, n)) / whole

    return pd.Series([tail(int(k), int(n)) for k, n in zip(hits, samples)])


def sign_tests(rows: DataFrame, treatment: str) -> DataFrame:
    """One-sided sign test of every model family and reduction."""
    counted = improvements(rows, treatment)
    tail = F.pandas_udf(binomial_tail, "double")
    return counted.withColumns({f"p_{s}": tail(f"n_{s}", "samples")
                                for s in ("alpha", "beta", "gamma")})


def nth_example(rows: DataFrame, where: dict, order: list, n: int) -> DataFrame:
    """The n-th row (from 1) of a conjunctive equality filter under an explicit order."""
    for column, value in where.items():
        rows = rows.filter(F.col(column) == value)
    return rows.orderBy(*order).limit(n).offset(n - 1)
