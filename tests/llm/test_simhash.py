from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from steadymap.llm import simhash
from steadymap.llm.common import Stage
from steadymap.llm.components import components

exec(Path(__file__).with_name("plain_simhash.py").read_text())  # brute, plain_fingerprint, roots_of


def test_every_text_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x " * 50_000), (7, "É é É é")]
    base = [" ".join(rng.choice(list("abcdefghij"), 5)) for _ in range(1500)]
    for k in range(60):
        text = base[k % 20 * 70 : k % 20 * 70 + 70]
        if k >= 20:
            text = text[: -(k // 20)] + [f"new{k}"]
        rows.append((100 + k, "\n".join(text)))
    rows.append(rows[-1])
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(docs).collect())
    assert got == brute(rows)


def test_long_text_takes_the_block_path():
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice(["aa", "b", "cc", "dé"], 70_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("flips", [0, 1, 2])
def test_covering(flips):
    """A fingerprint is copied to the home of everything within the threshold."""
    rng, settings = np.random.default_rng(flips), simhash.Settings()
    x = rng.integers(-(2**63), 2**63 - 1, 500)
    y = x.view(np.uint64).copy()
    for k in range(len(y)):
        for b in rng.choice(64, flips, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    index, anchor = simhash.anchors(y.view(np.int64), settings)
    reached = defaultdict(set)
    for i, a in zip(index, anchor):
        assert a not in reached[i]
        reached[i].add(a)
    assert all(h in reached[k] for k, h in enumerate(simhash.homes(x, settings)))


def test_links_in_a_dense_group(spark):
    """Many fingerprints around one centre, and the all-zero and all-one ones."""
    rng = np.random.default_rng(5)
    fps = {0, -1, 1, -2}
    for _ in range(300):
        x = np.uint64(0x0F1E2D3C4B5A6978)
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        fps.add(int(x.astype(np.int64)))
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(table, simhash.Settings()).collect()}
    bits = lambda f: f & (2**64 - 1)
    assert got == {(a, b) for a in fps for b in fps if a < b and (bits(a) ^ bits(b)).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    chain = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (200, 300), (300, 200)]
    found = components(spark.createDataFrame(chain, "a long, b long"), Stage(spark, "test"))
    want = roots_of({n for p in chain for n in p}, chain)
    assert {r.node: r.root for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), Stage(spark, "test")).count() == 0


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
