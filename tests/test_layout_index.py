"""Layouts in the plane are searched by cells, not by all pairs of blocks; the measures stay the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from steadymap.operators import local, pivots
from steadymap.operators.pivots import Index
from tests.test_kernels import frame


def test_measures_by_cells_equal_those_by_blocks(spark):
    rng = np.random.default_rng(2)
    data = np.round(rng.normal(size=(400, 4)), 1)
    data[50:90], data[7, 0] = data[50], np.nan  # copies, ties, a point without a distance
    both = frame(spark, data).withColumn("label", F.col("id") % 3).select(
        "space", "id", "label", F.slice("v", 1, 2).alias("v1"), F.slice("v", 3, 2).alias("v2"))
    assert local.label_preservation(both, index=Index(cell=20)).collect() == local.label_preservation(both).collect()
    one = both.withColumnRenamed("v1", "v")
    assert local.neighborhood_hit(one, index=Index(cell=20)).collect() == local.neighborhood_hit(one).collect()


@pytest.mark.parametrize("name,searches", [("label_preservation", 2), ("backfill_metric", 2), ("neighborhood_hit", 1)])
def test_layout_queries_ask_for_cells(spark, monkeypatch, name, searches):
    asked, search = [], pivots.pivot_knn
    monkeypatch.setattr(pivots, "pivot_knn", lambda *args: asked.append(1) or search(*args))
    entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(asked) == searches
