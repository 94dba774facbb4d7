"""Expressions over run names: model families, reductions, paths, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The names results are filed under, most specific first.
MODELS = [
    "bert_all_mpnet_base_v2", "bert_all_distilroberta_v1", "lda_linear_combined", "lda",
    "lsi_linear_combined_tfidf", "lsi_linear_combined", "lsi_tfidf", "lsi",
    "nmf_linear_combined_tfidf", "nmf_linear_combined", "nmf_tfidf", "nmf",
    "doc2vec", "bow", "tfidf",
]
REDUCTIONS = ["som", "tsne", "umap", "mds"]
DATASETS = ["20_newsgroups", "lyrics", "seven_categories"]
TOPICS = {"lyrics": 12, "seven_categories": 14, "emails": 8, "ag_news": 8, "bbc_news": 10,
          "20_newsgroups": 20, "reuters": 10}
TRUE_WORDS = ["yes", "true", "t", "y", "1"]
FALSE_WORDS = ["no", "false", "f", "n", "0"]


def first_match(text: Column, names: list[str]) -> Column:
    """First listed name contained in the text, NULL when none is."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in names])


def family(model: Column) -> Column:
    """BOW, LDA, LSI, NMF, BERT or Doc2Vec of a model name; other names stay."""
    starts = lambda *p: reduce(lambda a, b: a | b, [F.startswith(model, F.lit(x)) for x in p])
    return (
        F.when(model.isin("bow", "tfidf"), "BOW").when(starts("lda"), "LDA")
        .when(starts("lsi"), "LSI").when(starts("nmf"), "NMF").when(starts("bert"), "BERT")
        .when(starts("doc2vec"), "Doc2Vec").otherwise(model))


def short_model(model: Column) -> Column:
    """Like ``family`` but sentence and document models keep their full name."""
    known = family(model)
    return F.when(known.isin("BOW", "LDA", "LSI", "NMF"), known).otherwise(model)


def relative_path(path: Column, dataset: Column) -> Column:
    """Segments from the first one that contains the dataset name; '' when none does."""
    parts = F.split(path, "/")
    hits = F.transform(parts, lambda s: F.contains(s, dataset))
    at = F.coalesce(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, F.greatest(at, F.lit(1)), F.size(parts)), "/")).otherwise("")


def identifier(file_name: Column, trailing: int = 2) -> Column:
    """File name without its last ``trailing`` underscore parts."""
    parts = F.split(file_name, "_")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - trailing, F.lit(0))), "_")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def run_seed(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:^|/)random_seed_(\d+)(?:/|$)", 1).try_cast("int")


def run_jitter(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:^|/)jitter_amount_(\d+(?:\.\d+)?)(?:/|$)", 1).try_cast("double")


def dataset_of(path: Column, names: list[str] = DATASETS) -> Column:
    """Last listed dataset the path contains, '' when none."""
    return F.coalesce(first_match(path, names[::-1]), F.lit(""))


def evaluation_key(name: Column, *fields: Column) -> Column:
    return F.concat_ws("_", name, *fields)


def shortened(name: Column, limit: int = 255, offset: int = 40) -> Column:
    """Names of ``limit`` - ``offset`` characters or more become prefix + '_' + hash + '.csv'.

    The prefix leaves room for the hash and another ``offset`` characters.
    """
    most, hashed = limit - offset, 15
    if most - hashed - offset < 1:
        raise ValueError("the limit leaves no room for a prefix")
    digest = F.substring(F.sha2(name, 256), 1, hashed)
    prefix = F.substring(name, 1, most - hashed - offset)
    return F.when(F.length(name) >= most, F.concat(prefix, F.lit("_"), digest, F.lit(".csv"))).otherwise(name)


def as_flag(text: Column) -> Column:
    """Boolean of a yes/no word, NULL for anything else."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def number_or_word(text: Column) -> Column:
    """(number, word): the parsed number, or the text when it is not one."""
    number = text.try_cast("double")
    return F.struct(number.alias("number"), F.when(number.isNull(), text).alias("word"))


def jitter_pair(a: Column, b: Column) -> Column:
    """(low, high); NULL for equal values, which are no pair."""
    return F.when(a != b, F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def model_reduction(path: Column) -> tuple[Column, Column]:
    """(reduction, model) named by a path; '' when none is."""
    return tuple(F.coalesce(first_match(path, names), F.lit("")) for names in (REDUCTIONS, MODELS))
