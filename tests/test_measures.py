"""Named measures and the caller's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadymap.operators import scores


def points(spark):
    rng = np.random.default_rng(1)
    rows = [("a", n, n % 3, [float(x) for x in p], [float(x) for x in p + rng.normal(0, 0.1, 2)]) for n, p in enumerate(rng.normal(size=(40, 2)))]
    return spark.createDataFrame(rows, "space string, id long, label int, v1 array<double>, v2 array<double>")


def test_every_name_gives_its_column(spark):
    names = list(scores.registry(5))
    row = scores.run_measures(points(spark), names, 5).first()
    assert set(row.asDict()) == {"space", *names} and all(np.isfinite(row[n]) for n in names)


def test_the_callers_function_runs_and_unknown_names_fail(spark):
    own = ("first", lambda p: p.groupBy("space").agg(F.min("id").alias("first")))
    assert scores.run_measures(points(spark), [own]).first()["first"] == 0
    with pytest.raises(ValueError):
        scores.run_measures(points(spark), ["no such measure"])
