"""Hidden Markov language model over whole corpora.

Words are emitted in two steps: a latent state emits a symbol, the symbol emits the word. A word's
symbol is the hash of its first and last two letters, so every word has one, seen or not, and the
state-by-symbol table has a fixed size (``states`` x ``symbols``) whatever the vocabulary. The word
counts behind the second step live in a Spark table that grows with the corpus and is joined, never
broadcast. Absolute discounting moves ``discount`` of every seen word's count to one unknown word, so

    P(w | state) = e(state, sym(w)) * (c(w) - d) / C(sym(w)),   P(unknown | state) = the mass set free,

and the probabilities of all known words, the unknown word and the end of text sum to one. Texts are
scored exactly by the scaled forward recursion over their whole length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage, id_fold, words_of

END, UNKNOWN, FIRST = 0, 1, 2
BLOCK_BYTES = 24 << 20
GROUP_TOKENS = 1 << 21
STORED = ("block long, doc_id long, held_out boolean, shard int, ids binary, syms binary, "
          "word string, local int, sym int, n long")


@dataclass(frozen=True)
class Settings:
    """``rounds`` passes of one of ``shards`` parts of the corpus each, then ``final`` passes of all of it."""

    states: int = 8
    symbols: int = 8192
    discount: float = 0.7
    shards: int = 16
    rounds: int = 8
    final: int = 1
    memory: float = 0.3
    seed: int = 7
    folds: int = 10


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states, the unknown word's mass in row UNKNOWN
    size: np.ndarray  # training tokens of each symbol
    tokens: int
    types: int
    discount: float


def symbol(word: str, symbols: int) -> int:
    return FIRST + zlib.crc32(f"{word[:2]}|{word[-2:]}".encode()) % (symbols - FIRST)


def blocks(docs: DataFrame, settings: Settings) -> DataFrame:
    """Rows of ``STORED``: per block of texts its documents as ids into the block's words, and these words."""
    shards, symbols = settings.shards, settings.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__  # the next free number
        rows: list[tuple] = []

        def frame(*cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, arrow_schema)], schema=arrow_schema)

        def flush() -> Iterator[pa.RecordBatch]:
            block = (part << 32) + number
            names = [w.decode() for w in known]
            syms = np.fromiter((symbol(w, symbols) for w in names), np.uint16, len(names))
            counts = np.zeros(len(names), np.int64)
            for at in range(0, len(rows), 2000):
                doc, held, shard, ids = zip(*rows[at : at + 2000])
                if learned := [i for i, out in zip(ids, held) if not out]:
                    counts += np.bincount(np.concatenate(learned), minlength=len(names))
                none = [None] * len(doc)
                yield frame([block] * len(doc), doc, held, shard, [i.tobytes() for i in ids],
                            [syms[i].tobytes() for i in ids], none, none, none, none)
            for at in range(0, len(names), 100_000):
                word = names[at : at + 100_000]
                none, end = [None] * len(word), at + len(word)
                yield frame([block] * len(word), none, none, none, none, none, word,
                            np.arange(at, end, dtype=np.int32), syms[at:end].astype(np.int32), counts[at:end])

        for batch in batches:
            data = batch.to_pydict()
            for doc, text, held, shard in zip(data["doc_id"], data["text"], data["held_out"], data["shard"]):
                words = words_of(text)
                rows.append((doc, held, shard, np.fromiter(map(known.__getitem__, words), np.int32, len(words))))
                size += len(text or "") + 64
                if size >= BLOCK_BYTES:
                    yield from flush()
                    known.clear()
                    rows, size, number = [], 0, number + 1
        if rows:
            yield from flush()

    arrow_schema = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("shard", pa.int32()),
        ("ids", pa.binary()), ("syms", pa.binary()), ("word", pa.string()), ("local", pa.int32()),
        ("sym", pa.int32()), ("n", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (id_fold("doc_id", settings.folds) == 0).alias("held_out"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    return rows.mapInArrow(run, STORED)


def _layout(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens step by step for texts side by side: symbols, start of each step, texts in each step, order of texts."""
    lens = np.array([len(s) for s in seqs])
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    flat = np.concatenate([seqs[i] for i in order])
    active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
    base = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = np.empty(len(flat), np.int64)
    out[base[step] + np.repeat(np.arange(len(lens)), lens)] = flat
    return out, base, active, order


def forward(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each symbol sequence by the scaled forward recursion."""
    syms, base, active, order = _layout(seqs)
    total = np.zeros(len(seqs))
    a = np.broadcast_to(start, (len(seqs), len(start)))
    for t, n in enumerate(active):
        a = (a if t == 0 else a[:n] @ move) * emit[syms[base[t] : base[t + 1]]]
        s = a.sum(1)
        total[:n] += np.log(s)
        a = a / s[:, None]
    out = np.empty(len(seqs))
    out[order] = total
    return out


def expected(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Baum-Welch counts of one group of sequences: starts, moves, emissions (symbols x states)."""
    syms, base, active, _ = _layout(seqs)
    states = len(start)
    alpha = np.empty((len(syms), states), np.float32)
    scale = np.empty(len(syms), np.float32)
    start, move, emit = (x.astype(np.float32) for x in (start, move, emit))
    a = np.broadcast_to(start, (len(seqs), states))
    for t, n in enumerate(active):
        at = slice(base[t], base[t + 1])
        a = (a if t == 0 else a[:n] @ move) * emit[syms[at]]
        s = a.sum(1)
        a = a / s[:, None]
        alpha[at], scale[at] = a, s
    moves = np.zeros((states, states))
    b = np.ones((active[-1], states), np.float32)
    back = np.ascontiguousarray(move.T)
    for t in range(len(active) - 1, -1, -1):
        at = slice(base[t], base[t + 1])
        if t:
            before = slice(base[t - 1], base[t - 1] + active[t])
            eb = emit[syms[at]] * b / scale[at][:, None]
            moves += alpha[before].T @ eb
            alpha[at] *= b
            b = np.ones((active[t - 1], states), np.float32)
            b[: active[t]] = eb @ back
        else:
            alpha[at] *= b
    emissions = np.stack([np.bincount(syms, alpha[:, k], minlength=len(emit)) for k in range(states)], 1)
    return alpha[: len(seqs)].sum(0, dtype=float), moves * move, emissions


def _groups(texts: list[bytes]) -> Iterator[list[np.ndarray]]:
    """Symbol sequences with their end, in groups of about ``GROUP_TOKENS``."""
    group, size = [], 0
    for syms in texts:
        group.append(np.append(np.frombuffer(syms, np.uint16), np.uint16(END)))
        size += len(group[-1])
        if size >= GROUP_TOKENS:
            yield group
            group, size = [], 0
    if group:
        yield group


def baum_welch(texts: DataFrame, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """One round: every task sums its counts, Spark adds them by symbol; the result has ``symbols`` rows."""
    symbols, states = emit.shape
    cols = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows below ``symbols`` are emissions, then one row of starts, then the moves
        total, any_text = np.zeros((symbols + 1 + states, states)), False
        for batch in batches:
            for seqs in _groups(batch.column(0).to_pylist()):
                s, m, e = expected(seqs, start, move, emit)
                total[:symbols] += e
                total[symbols] += s
                total[symbols + 1 :] += m
                any_text = True
        if any_text:
            used = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(total[used, k]) for k in range(states)],
                                             names=["row", *cols])

    counted = texts.select("syms").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in cols))
    out = np.zeros((symbols + 1 + states, states))
    for r in counted.groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).collect():
        out[r[0]] = r[1:]
    return out


def train(texts: DataFrame, stats: dict[int, tuple[int, int]], settings: Settings) -> Model:
    """Fit on the training texts. ``stats``: symbol -> (tokens, distinct words), end of text included."""
    symbols, states = settings.symbols, settings.states
    size, types = np.zeros(symbols), np.zeros(symbols)
    for sym, (n, v) in stats.items():
        size[sym], types[sym] = n, v
    tokens, rng = size.sum(), np.random.default_rng(settings.seed)
    seen = size > 0
    prior = (size / max(tokens, 1.0))[:, None]
    start, move = np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    emit = prior * rng.uniform(0.5, 1.5, (symbols, states))
    emit = emit / np.maximum(emit.sum(0), 1e-300)
    memory = None
    plan = [r % settings.shards for r in range(settings.rounds)] + [None] * settings.final
    for shard in plan if tokens else []:
        part = texts if shard is None else texts.where(F.col("shard") == shard)
        counts = baum_welch(part, start, move, emit)
        total = counts[:symbols].sum()
        if not total:
            continue
        counts = counts / total
        # shard rounds blend with what earlier rounds saw; full rounds stand alone
        memory = counts if shard is None or memory is None else settings.memory * memory + (1 - settings.memory) * counts
        emit = memory[:symbols] + 1e-3 * prior
        emit = emit / emit.sum(0)
        start = memory[symbols] + 1e-9
        start = start / start.sum()
        move = memory[symbols + 1 :] + 1e-9
        move = move / move.sum(1, keepdims=True)
    types[END] = 0  # the end of text keeps its whole count
    free = np.where(seen, settings.discount * types / np.maximum(size, 1), 0)
    if tokens:
        emit = emit.copy()
        emit[UNKNOWN] = free @ emit
    else:
        emit = np.zeros((symbols, states))
        emit[[END, UNKNOWN]] = 1.0
    return Model(start, move, emit, size, int(tokens), 0, settings.discount)


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows with ``held_out`` false (crc32 of the id, mod ``folds``). A null or empty
    text is one token, its end. Repeated rows are scored once each and count once each. Without
    training rows every token has probability 1 and both scores are 0. Further columns of ``docs``
    are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "hmm")
    stored = stage.save(blocks(docs, settings), "blocks")
    texts = stored.where("word is null").select("block", "doc_id", "held_out", "shard", "ids", "syms")
    words = stage.again("blocks", stored).where("word is not null").select("block", "word", "local", "sym", "n")
    counts = stage.save(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.first("sym").alias("sym")), "counts")
    training = texts.where("not held_out")
    stats = {r[0]: (r[1], r[2]) for r in counts.groupBy("sym").agg(F.sum("c"), F.count("*")).collect()}
    if ends := training.count():
        stats[END] = (ends, 1)
    types = sum(v for _, v in stats.values())
    model = train(training, stats, settings)
    cells = words.join(counts.select("word", "c"), "word", "left").select("block", "local", "sym", "c")
    tokens, floor = model.tokens, model.tokens + 0.1 * (types + 1)

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = len(right)
        c, sym = np.zeros(n), np.zeros(n, np.int64)
        c[right["local"]] = right["c"].fillna(0)
        sym[right["local"]] = right["sym"]
        known = c > 0
        base = np.log10((c + 0.1) / floor)
        inner = np.where(known, np.log((np.where(known, c, 1.0) - model.discount) / np.maximum(model.size[sym], 1)), 0.0)
        sym = np.where(known, sym, UNKNOWN)
        end = np.log10((ends + 0.1) / floor)
        rows = []
        group, size = [], 0

        def close() -> None:
            for r, ll in zip(group, forward([g[-1] for g in group], model.start, model.move, model.emit)):
                rows.append((*r[:-2], (ll + r[-2]) / np.log(10)))
            group.clear()

        for doc, held, raw in zip(left["doc_id"], left["held_out"], left["ids"]):
            ids = np.frombuffer(raw, np.int32)
            group.append((doc, held, len(ids) + 1, int(known[ids].sum()) + (ends > 0), tokens,
                          float(base[ids].sum() + end), float(inner[ids].sum()), np.append(sym[ids], END)))
            size += len(ids) + 1
            if size >= GROUP_TOKENS // 2:
                close()
                size = 0
        if group:
            close()
        return pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                            ).astype({"doc_id": "Int64"})

    return texts.select("block", "doc_id", "held_out", "ids").groupBy("block").cogroup(cells.groupBy("block")).applyInPandas(
        apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
