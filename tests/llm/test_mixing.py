import math
import re
from collections import Counter

import numpy as np
import pytest

from steadymap.llm import mixing

SMALL = mixing.Settings(fan=4)


def plain_targets(sizes):
    """Shares by weight; what is above twice a source's size goes to the others until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * unit > 2 * sizes[s]}
        if not over:
            return out | {s: weights[s] * unit for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    names = ["hot"] * 6 + ["a", "É", None, "𝄞", "￮", "z"]
    out = [(n, " ".join(["w"] * int(rng.integers(0, 40))), names[int(rng.integers(0, len(names)))]) for n in range(400)]
    return out + [(500, None, "a"), (501, "  x\x0by\x85z", "a"), (502, "word " * 60_000, "hot"), (503, "", "empty"), (3, "a b", "a"),
                  (3, "a b", "a"), (None, "a b c", "z"), (None, "a b c", "z")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_against_plain_rules(spark, rows):
    got = mixing.mix(frame(spark, rows).repartition(7), SMALL).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    want = plain_targets(totals)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == totals[r.source]
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(ratio + 1e-9), math.ceil(ratio - 1e-9)) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in want)


def test_reruns_and_partitions_agree(spark, rows):
    runs = [sorted(mixing.mix(frame(spark, rows).repartition(n), SMALL).collect(), key=str) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_expectation_is_kept(spark):
    """Over many sources that look alike, a document's place in its source does not change its odds."""
    rows = [(1000 * s + k, "w " * (k + 1), f"s{s:03d}") for s in range(300) for k in range(6)]
    settings = mixing.Settings(weights=(1.0,), share=0.4, fan=4)
    copies = Counter()
    for r in mixing.mix(frame(spark, rows), settings).collect():
        copies[r.doc_id % 1000] += r.copies
    assert all(abs(copies[k] / 300 - 0.4) < 0.1 for k in range(6))


def test_empty_and_wordless(spark, rows):
    assert mixing.mix(frame(spark, rows).limit(0)).collect() == []
    got = mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r.target, r.taken, r["size"]) for r in got} == {(0.0, 0, 0)}
