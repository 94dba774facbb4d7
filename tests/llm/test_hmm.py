import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from steadymap.llm import hmm
from steadymap.llm.common import words_of

SMALL = hmm.Settings(states=2, symbols=64, shards=2, rounds=2)
TEXTS = ["a b a", "B a\tc", "a a b c d", "", None, "x y z", "a b", "ÀÉ b\x0bq", "b " * 300, "a b", "c d e f"]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(n, t, "clash") for n, t in enumerate(TEXTS * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    return rows, {r.doc_id: r for r in hmm.score(docs, SMALL).collect()}


def test_base_score_and_counts(scored):
    rows, got = scored
    held = {n: zlib.crc32(str(n).encode()) % 10 == 0 for n, *_ in rows}
    tokens = {n: [*words_of(t), b" "] for n, t, _ in rows}
    c = Counter(w for n in tokens if not held[n] for w in tokens[n])
    total, types = sum(c.values()), len(c)
    assert set(got) == set(tokens)
    for n, words in tokens.items():
        assert (got[n].held_out, got[n].n_tokens, got[n].train_tokens) == (held[n], len(words), total)
        assert got[n].n_known == sum(w in c for w in words)
        assert got[n].base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words))
        assert got[n].score <= 1e-9


def test_learns_order(scored):
    rows, got = scored
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(1)
    start, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    emit = rng.dirichlet(np.ones(5), 3).T
    seqs = [np.array(s) for s in ([0], [1, 2, 3, 4], [4, 4], [0, 1, 0])]
    for seq, got in zip(seqs, hmm.forward(seqs, start, move, emit)):
        want = 0.0
        for path in itertools.product(range(3), repeat=len(seq)):
            p = start[path[0]] * emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= move[path[t - 1], path[t]] * emit[seq[t], path[t]]
            want += p
        assert got == pytest.approx(math.log(want))


def test_expected_counts_equal_the_posterior_over_paths():
    rng = np.random.default_rng(2)
    start, move = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2)
    emit = rng.dirichlet(np.ones(4), 2).T
    seqs = [np.array(s) for s in ([1, 2, 3], [0, 3], [2])]
    starts, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for seq in seqs:
        weights = {}
        for path in itertools.product(range(2), repeat=len(seq)):
            p = start[path[0]] * emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= move[path[t - 1], path[t]] * emit[seq[t], path[t]]
            weights[path] = p
        for path, p in weights.items():
            p /= sum(weights.values())
            starts[path[0]] += p
            for t, s in enumerate(path):
                emissions[seq[t], s] += p
                if t:
                    moves[path[t - 1], s] += p
    for got, want in zip(hmm.expected(seqs, start, move, emit), (starts, moves, emissions)):
        assert got == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one(spark):
    """Over the first token: every known word, the unknown word and the end of text."""
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS * 5)], "doc_id long, text string")
    train = [t for n, t in enumerate(TEXTS * 5) if zlib.crc32(str(n).encode()) % 10]
    c = Counter(w for t in train for w in words_of(t))
    stats = {hmm.END: (len(train), 1)}
    for w, n in c.items():
        s = hmm.symbol(w.decode(), SMALL.symbols)
        old = stats.get(s, (0, 0))
        stats[s] = (old[0] + n, old[1] + 1)
    stored = hmm.blocks(docs, SMALL)
    m = hmm.train(stored.where("word is null and not held_out").select("syms", "shard"), stats, SMALL)
    total = m.emit[hmm.END] + m.emit[hmm.UNKNOWN]
    for w, n in c.items():
        s = hmm.symbol(w.decode(), SMALL.symbols)
        total = total + m.emit[s] * (n - m.discount) / m.size[s]
    assert total == pytest.approx(np.ones(2))


def test_empty_table_and_no_training_rows(spark):
    assert hmm.score(spark.createDataFrame([], "doc_id long, text string"), SMALL).collect() == []
    only = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = hmm.score(only, SMALL).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(True, 0, 0, 0.0, 0.0)] * 2
