"""Near-duplicate texts by SimHash fingerprints and anchor points of a covering code.

The anchors are the codewords of a product of perfect codes over the fingerprint's bits: two binary
Golay codes (23 bits, covering radius 3) and one Hamming code (15 bits, covering radius 1); three
bits are left out. Every fingerprint has one nearest anchor, its home. It is also copied to every
anchor that is the home of any fingerprint within ``threshold`` bits of it, which are the anchors
within covering radius plus threshold that can matter. Two fingerprints at most ``threshold`` bits
apart therefore always meet at the home of either, and are compared there. Which anchors a
fingerprint reaches depends, code by code, only on its syndrome, so they come from small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage, partitions_for, words_of
from steadymap.llm.components import components

SEED = 42
#: Length, covering radius, generator polynomial (highest power first) of the perfect cyclic codes.
GOLAY = (23, 3, 0b101011100011)
HAMMING = (15, 1, 0b10011)
ROWS = 250_000


@dataclass(frozen=True)
class Settings:
    words: int = 3
    threshold: int = 2
    codes: tuple[tuple[int, int, int], ...] = (GOLAY, GOLAY, HAMMING)


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    tokens = words_of(text)
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    digest = xxhash.xxh64_digest
    ones, n, block = np.zeros(64, np.int64), max(1, len(tokens) - words + 1), []
    for s in shingles:
        block.append(digest(s, SEED))
        if len(block) == 65536:
            ones += _bits(block)
            block = []
    if block:
        ones += _bits(block)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _bits(digests: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    # counts per byte value, then per bit: cheaper than unpacking every digest
    if len(raw) < 400:
        return np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return np.concatenate([np.bincount(raw[:, k], minlength=256) @ table for k in range(8)])


def text_key(text: Column) -> Column:
    """A hash that tells the rows of one doc_id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, signed 64-bit ``fp`` and ``key`` (hash of the text) of every whole text."""
    words = settings.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "key"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("key")).mapInArrow(
        run, "doc_id long, fp long, key long")


def _syndromes(values: np.ndarray, length: int, poly: int) -> np.ndarray:
    """Remainders of polynomial division, all values at once."""
    out, degree = values.astype(np.uint64), poly.bit_length() - 1
    for k in range(length - 1, degree - 1, -1):
        out = np.where((out >> np.uint64(k)) & np.uint64(1), out ^ np.uint64(poly << (k - degree)), out)
    return out.astype(np.int64)


@lru_cache
def _offsets(length: int, radius: int, poly: int, flips: int) -> tuple[np.ndarray, ...]:
    """[flipped bits][syndrome, ...]: offsets from a word to the home anchors of words so many bits away.

    An anchor is listed under the fewest flips that reach it; rows are filled up with -1.
    """
    def patterns(weight: int) -> np.ndarray:
        return np.array([sum(1 << b for b in bits) for bits in combinations(range(length), weight)], np.int64)

    leaders = np.zeros(1 << (poly.bit_length() - 1), np.int64)
    for weight in range(radius, -1, -1):
        p = patterns(weight)
        leaders[_syndromes(p, length, poly)] = p
    reached: list[set[int]] = [set() for _ in leaders]
    out = []
    for n in range(flips + 1):
        p = patterns(n)
        syn = _syndromes(p, length, poly)
        rows = [sorted(set((p ^ leaders[s ^ syn]).tolist()) - reached[s]) for s in range(len(leaders))]
        for r, seen in zip(rows, reached):
            seen.update(r)
        table = np.full((len(leaders), max(1, max(map(len, rows)))), -1, np.int64)
        for s, r in enumerate(rows):
            table[s, : len(r)] = r
        out.append(table)
    return tuple(out)


def _ends(fps: np.ndarray, settings: Settings, flips: int) -> list[list[np.ndarray]]:
    """[code][flipped bits]: the anchor's bits of that code, fingerprints x choices, -1 where there is none."""
    out, shift, values = [], 0, fps.view(np.uint64)
    for length, radius, poly in settings.codes:
        word = (values >> np.uint64(shift)) & np.uint64((1 << length) - 1)
        syn, own = _syndromes(word, length, poly), word.astype(np.int64)[:, None]
        tables = _offsets(length, radius, poly, settings.threshold)[: flips + 1]
        out.append([np.where(t[syn] < 0, -1, (own ^ t[syn]) << shift) for t in tables])
        shift += length
    return out


def homes(fps: np.ndarray, settings: Settings) -> np.ndarray:
    """The nearest anchor of every fingerprint."""
    return sum(ends[0][:, 0] for ends in _ends(fps, settings, 0))


def anchors(fps: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``fps`` and anchor, for every anchor a fingerprint is copied to; none comes twice."""
    index, anchor, ends = [], [], _ends(fps, settings, settings.threshold)
    for spent in product(range(settings.threshold + 1), repeat=len(ends)):
        if sum(spent) > settings.threshold:
            continue
        so_far = np.zeros((len(fps), 1), np.int64)
        for code, n in zip(ends, spent):
            more = code[n][:, None, :]
            so_far = np.where((so_far[:, :, None] < 0) | (more < 0), -1, so_far[:, :, None] | more).reshape(len(fps), -1)
        row, col = np.nonzero(so_far >= 0)
        index.append(row)
        anchor.append(so_far[row, col])
    return np.concatenate(index), np.concatenate(anchor)


def links(fps: DataFrame, settings: Settings, rows: int | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of different fingerprints (column ``fp``, distinct) at most ``threshold`` bits apart."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(homes(fp, settings)), batch.column(0)], names=["anchor", "fp"])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for cut in (fp[k : k + 1000] for k in range(0, len(fp), 1000)):
                index, anchor = anchors(cut, settings)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(cut[index])], names=["anchor", "fp"])

    spread = fps.select("fp").repartition(partitions_for(fps, ROWS // 20, rows), "fp")
    own = spread.mapInArrow(at_home, "anchor long, fp long")
    copies = spread.mapInArrow(copied, "anchor long, fp long")
    near = F.expr(f"a.fp != b.fp and bit_count(a.fp ^ b.fp) <= {settings.threshold}")
    # copies are many times the input, which the optimizer cannot see: never broadcast them
    return own.hint("merge").alias("a").join(copies.hint("merge").alias("b"), (F.col("a.anchor") == F.col("b.anchor")) & near).select(
        F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id and key (hash of the text) of every document.

    ``component_id`` is the smallest doc_id reachable over fingerprints at most ``threshold`` bits
    apart, itself included. Null, empty and blank texts have fingerprint zero and so belong together;
    texts with fewer than ``words`` words are one shingle. Repeated rows come out as often as they
    come in; a null doc_id is never a component's smallest id unless the component has no other. An
    empty table gives no rows; further columns of ``docs`` are ignored.
    """
    stage = Stage(docs.sparkSession, "simhash")
    marked = stage.save(fingerprints(docs, settings), "fingerprints")
    # copies collapse here, combined before the shuffle: one row per fingerprint goes on
    classes = stage.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    rows = classes.count()
    roots = stage.save(components(links(classes, settings, rows), stage), "roots")
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage.save(named.join(best, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key")


def keep_first(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of every group, the one with the smallest doc_id, with all its columns.

    Repeated rows of one doc_id and text stay once. Documents without doc_id go if one with a doc_id is in
    their group; if none is, every different text among them stays once.
    """
    return first_of(docs, groups(docs, settings))


def first_of(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``grouped`` (doc_id, component_id, key) has as the first of their group."""
    chosen = grouped.where("doc_id <=> component_id").select("doc_id", "key").distinct()
    key = text_key(F.col("text").cast("string"))
    # the row travels as one struct, so no column of it can clash with the keys
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    kept = rows.alias("d").join(chosen.alias("c"), F.expr("d.id <=> c.doc_id and d.key = c.key"), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")
