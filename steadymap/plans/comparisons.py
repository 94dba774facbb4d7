"""Which layouts are compared with which."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from steadymap.functions.naming import TOPICS
from steadymap.operators.order import hash_key, number_rows

# The parameter lists of every reduction, in the order their configs count.
GRIDS = {
    "mds": {"n_iter": [100, 150, 200, 250, 300]},
    "som": {"n": [5, 10, 15, 20, 25, 30], "m": [5, 10, 15, 20, 25, 30]},
    "umap": {"min_dist": [0.0, 0.1, 0.25, 0.5, 0.8, 0.99],
             "n_neighbor": [2, 5, 10, 20, 50, 100, 200]},
    "tsne": {"perplexity": [5.0, 15.0, 25.0, 35.0, 45.0, 55.0],
             "learning_rate": [10.0, 28.0, 129.0, 359.0, 1000.0],
             "n_iter": [1000, 2500, 5000, 10000]},
}
# Model names with their parameter text; {t} topics, {c} categories.
_LSI = "_n_topics_{t}_decay_1.0_onepass_True_power_iters_2_extra_samples_100"
_LDA = "_n_topics_{t}_alpha_auto_iterations_1000_topic_threshold_0.0"
MODEL_NAMES = [
    "bow", "tfidf", "lda" + _LDA, "lda_linear_combined" + _LDA, "lsi" + _LSI, "lsi_tfidf" + _LSI,
    "lsi_linear_combined_tfidf" + _LSI, "lsi_linear_combined" + _LSI, "nmf_n_topics_{t}",
    "nmf_tfidf_n_topics_{t}", "nmf_linear_combined_n_topics_{t}",
    "nmf_linear_combined_tfidf_n_topics_{t}", "bert_all_distilroberta_v1_n_categories_{c}",
    "bert_all_mpnet_base_v2_n_categories_{c}", "doc2vec_n_topics_{t}",
]


def topic_counts(spark) -> DataFrame:
    return spark.createDataFrame(list(TOPICS.items()), "dataset string, topics int")


def model_list(datasets: DataFrame) -> DataFrame:
    """(dataset, topics, categories) -> one row per dataset and model."""
    names = F.array(*[F.lit(n) for n in MODEL_NAMES])
    fill = lambda n: F.replace(F.replace(n, F.lit("{t}"), F.col("topics").cast("string")),
                               F.lit("{c}"), F.col("categories").cast("string"))
    return datasets.select("dataset", F.explode(F.transform(names, fill)).alias("model"))


def successors(values: list) -> list[tuple]:
    return list(zip(values, values[1:]))


def _layout_name(dr: str, p: dict[str, Column]) -> Column:
    text = {k: v.cast("string") for k, v in p.items()}
    head = [F.lit(dr), F.col("dataset"), F.col("model")]
    metric = F.when(F.contains("model", F.lit("lda")), "jensenshannon").otherwise("cosine")
    tail = {
        "mds": lambda: [F.lit("True"), metric, text["n_iter"]],
        "som": lambda: [text["n"], text["m"]],
        "umap": lambda: [text["n_neighbor"], text["min_dist"], metric],
        "tsne": lambda: [text["perplexity"], F.lit("12.0"), text["learning_rate"], text["n_iter"],
                         F.lit("random_barnes_hut_0.5"), metric],
    }[dr]()
    return F.concat_ws("_", *head, *tail)


def successor_pairs(models: DataFrame, grids: dict = GRIDS) -> DataFrame:
    """(dataset, model, config, name_1, name_2): vary one parameter to its successor and hold
    the others at every value. Narrow: every model row explodes its own pairs."""
    parts = []
    for dr, grid in grids.items():
        for n, (varied, values) in enumerate(grid.items()):
            steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in successors(values)]
            rows = models.withColumn("_step", F.explode(F.array(*steps)))
            for other, held in grid.items():
                if other != varied:
                    rows = rows.withColumn(f"_{other}", F.explode(F.array(*[F.lit(v) for v in held])))
            side = lambda s: {p: F.col(f"_step.{s}") if p == varied else F.col(f"_{p}") for p in grid}
            parts.append(rows.select(
                "dataset", "model", F.lit(dr if len(grid) == 1 else f"{dr}{n}").alias("config"),
                _layout_name(dr, side("a")).alias("name_1"), _layout_name(dr, side("b")).alias("name_2")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def resolve_names(wanted: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Attach the file of every wanted layout name; ``files`` is (identifier, path).

    Names meet identifiers by equality; several files of one run give the first by name.
    """
    first = files.groupBy("identifier").agg(F.min("path").alias(f"{column}_path"))
    return wanted.join(first.withColumnRenamed("identifier", column), column, "left")


def random_pairs(layouts: DataFrame, partners: int, seed: int = 42, files: int | None = None) -> DataFrame:
    """Every layout with the ``partners`` next ones in a seeded order (frame: layout_id).

    The range becomes an equi-join: every row names the positions of its partners.
    """
    order = number_rows(layouts.select("layout_id"), hash_key(F.col("layout_id"), seed), ["layout_id"], "rn")
    if files is not None:
        order = order.filter(F.col("rn") < files)
    left = order.select(F.col("layout_id").alias("layout_1"), "rn",
                        F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("_step"))
    right = order.select(F.col("layout_id").alias("layout_2"), F.col("rn").alias("_at"))
    return left.join(right, F.col("rn") + F.col("_step") == F.col("_at")).select("layout_1", "layout_2")


def run_pairs(layouts: DataFrame, varied: str, held: str, value) -> DataFrame:
    """Pairs of runs that differ in ``varied`` only (frame: dataset, identifier, path, seed, jitter).

    ``held`` is fixed at ``value``; within one setting the first path of an identifier counts.
    """
    one = layouts.filter(F.col(held) == value).groupBy("dataset", "identifier", varied).agg(
        F.min("path").alias("path"))
    a = one.select("dataset", "identifier", F.col(varied).alias(f"{varied}_1"), F.col("path").alias("path_1"))
    b = one.select("dataset", "identifier", F.col(varied).alias(f"{varied}_2"), F.col("path").alias("path_2"))
    return a.join(b, ["dataset", "identifier"]).filter(F.col(f"{varied}_1") < F.col(f"{varied}_2"))


def common_identifiers(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("identifier").intersect(right.select("identifier"))


def unfinished(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work whose whole key is not among the finished rows."""
    return planned.join(finished.select(*keys), keys, "left_anti")
