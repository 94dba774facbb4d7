"""The training-data pipeline: quality, near duplicates, personal data, mixing, token ids.

``run`` applies the stages to ``documents``; every stage's result is written as Parquet to the shared folder
and read again by the next, so a lost executor or a restarted stage costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steadymap.llm import chunk_bpe, mixing, pii, quality, simhash
from steadymap.llm.common import Stage, read
from steadymap.llm.queries import WORDS, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are scored as empty, repeated rows alike."""
    return quality.keep(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: SimHash of three-word shingles, linked at two or fewer bits.

    Null, empty and blank texts are one group; a group keeps its smallest doc_id, repeated rows stay once.
    """
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` stays that of the source text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them; a null source is a source of its own."""
    return mixing.apply(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, digest of the ids and of the decoded text for every row of the mix; a null text has no ids."""
    return chunk_bpe.digests(docs, vocabulary(WORDS))


STAGES = [("quality", keep_quality), ("near-duplicates", drop_near_duplicates), ("personal-data", redact_personal_data),
          ("mixing", mix_sources), ("tokens", encode_tokens)]

#: Trained models, fingerprints and merges cannot be written in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; returns the last one's rows."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage.save(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
