"""Links that no bucket and no list leads to."""

import numpy as np
import pytest

from steadymap.llm import nn_descent


@pytest.mark.parametrize("change", [{}, {"cell": 150}])
def test_isolated_pairs_are_all_linked(spark, change):
    """Pairs without another near neighbour, in a label with a strong mean and in one without, beside a dense group."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[450:] = x[450:] * 0.3 + 2
    x[1::2] = x[::2] + rng.normal(size=(450, 16)) * 0.03 * np.abs(x[::2]).mean(1)[:, None]
    x[:60] = x[0] + rng.normal(size=(60, 16)) * 0.02
    label = np.repeat([0, 1], 450)
    table = spark.createDataFrame([(n, [float(c) for c in v], int(c0)) for n, (v, c0) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label long")
    cos = nn_descent.cosines(x, x)
    near = (cos >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    few = nn_descent.Settings(tables=1, bucket=16, audits=1, **change)
    got = {r.vec_id: r.n_links for r in nn_descent.groups(table, few).collect()}
    assert near[60:450].sum(1).min() >= 1 and got == {n: int(k) for n, k in enumerate(near.sum(1))}
