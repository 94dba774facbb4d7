"""Both vector operators against brute force on every row."""

import math

import numpy as np
import pytest

from steadymap.llm import multi_index, nn_descent

NAN, INF = float("nan"), float("inf")
ODD = [None, [0.0] * 8, [NAN] + [1.0] * 7, [INF] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 3, []]


def usable(v):
    return v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<float>, label int, e double")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    x[100:220] = x[100] + rng.normal(size=(120, 8)).astype(np.float32) * 0.05
    x[300:330] = x[300]
    out = [(int(n), [float(c) for c in v], int(n % 2) if n < 100 else 0) for n, v in enumerate(x)]
    out += [(600 + n, v, 0) for n, v in enumerate(ODD)] + [(700, out[300][1], None), (701, out[300][1], 1), (None, out[300][1], 0)]
    return out


def sequential(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


@pytest.mark.parametrize("miss", [0.0, 0.1])
def test_search(spark, rows, miss):
    settings = multi_index.Settings(k=7, centroids=4, part_rows=40, part_queries=9, miss=miss)
    got = multi_index.search(table(spark, rows), "vec_id % 10 = 0", settings).collect()
    good = {i: v for i, v, _ in rows if i is not None and usable(v)}
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 10 == 0}
    hits = 0
    for q, mine in found.items():
        want = sorted(((-sequential(good[q], v), i) for i, v in good.items() if i != q))[:7]
        mine.sort()
        assert [m[0] for m in mine] == list(range(1, 8))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        assert all(s == sequential(good[q], good[i]) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in want})
        if miss == 0:
            assert [(i, s) for _, i, s in mine] == [(i, -s) for s, i in want]
    assert hits / (7 * len(found)) >= 0.9


def test_search_small_tables(spark, rows):
    assert multi_index.search(table(spark, rows).limit(0), "vec_id % 10 = 0").collect() == []
    assert multi_index.search(table(spark, [(0, [0.0] * 8, 0), (1, None, 0)]), "vec_id % 10 = 0").collect() == []
    two = multi_index.search(table(spark, [(0, [1.0] * 8, 0), (1, [2.0] * 8, 0)]), "vec_id % 10 = 0").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in two] == [(0, 1, 1, 16.0)]
    assert multi_index.search(table(spark, [(0, [1.0] * 8, 0)]), "vec_id % 10 = 0").collect() == []


def test_recall_counts_what_is_missing(spark, rows):
    t = table(spark, rows)
    found = multi_index.search(t, "vec_id % 10 = 0", multi_index.Settings(k=5, miss=0.0))
    assert multi_index.recall(t, found, "vec_id % 10 = 0", 5) == 1.0
    assert multi_index.recall(t, found.where("rank = 1"), "vec_id % 10 = 0", 5) == pytest.approx(0.2)


def test_links(spark, rows):
    settings = nn_descent.Settings(bucket=32, neighbours=4, sample=24, recall=1.0)
    got = {r.vec_id: r for r in nn_descent.groups(table(spark, rows), settings).collect()}
    good = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and usable(v) and c is not None]
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (i, v, c) in enumerate(good):
        for j, w, d in good[:k]:
            if c == d and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sum(n.values()) > 5000
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (n[i], find(i), i is not None and find(i) == i) for i in n}


def test_links_small_tables(spark):
    assert nn_descent.groups(table(spark, []).limit(0)).collect() == []
    rows = nn_descent.groups(table(spark, [(3, None, 0), (4, [0.0] * 8, 0)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(3, 0, 3, True), (4, 0, 4, True)]
    same = nn_descent.groups(table(spark, [(9, [1.0] * 8, 0)] * 3 + [(8, [2.0] * 8, 0)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in same) == [(8, 3, 8, True)] + [(9, 3, 8, False)] * 3


def test_cosines_of_extreme_vectors():
    x = np.array([[1e300, 1e300], [1e-300, 1e-300], [1.0, -1.0]])
    assert nn_descent.cosines(x, x) == pytest.approx(np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]]))
