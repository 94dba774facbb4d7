"""The registered queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadymap.llm import byte_bpe, chunk_bpe, hmm, langid, mixing, multi_index, nn_descent, oracles, phrases, pii, quality, rans, repair, simhash
from steadymap.llm.common import read

BYTES, WORDS, RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov log10 probability of every text beside its unigram base."""
    return hmm.score(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows outside fold 0."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.identify(docs, langid.fit(docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text, linked at two or fewer differing bits."""
    return simhash.groups(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from the labels outside fold 0."""
    return quality.score(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text; the counts and the hash are those of the base expressions."""
    found = pii.find(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *[pii.counted(no).alias(f"n_{kind}") for no, kind in enumerate(pii.KINDS)],
                        F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token files."""
    return rans.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(BYTES))


def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return chunk_bpe.digests(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(WORDS))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors, within their label, at cosine 0.98."""
    return nn_descent.groups(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every vector whose id is divisible by 20."""
    return multi_index.search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id % 20 = 0")


def op11_dynamic_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of every language."""
    return phrases.collocations(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op12_block_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation."""
    return repair.repair(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids by the rank file, and of the bytes they decode to."""
    return byte_bpe.digests(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(RANKS))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_hmm_score, op2_language, op3_simhash, op4_quality, op5_pii, op6_mixing, op7_rans, op8_chunk_bpe, op9_nn_descent, op10_multi_index, op11_dynamic_counting, op12_block_repair, op13_byte_bpe)}
#: Other results cannot be written in SQL; ``tests/llm`` holds them against brute force.
ORACLES: dict[str, str] = dict(oracles.ORACLES)
