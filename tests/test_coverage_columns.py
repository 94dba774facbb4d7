"""Counting runs carries the columns it counts by, not the measures as well."""

import __spark_entry__ as entry

from steadymap.catalog import results as queries


def test_coverage_by_model_carries_what_it_counts(spark, monkeypatch):
    written, materialize = [], queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df: written.append(df.columns) or materialize(df))
    entry.queries()["coverage_by_model"](spark, "/root/testdata/sf0.001").collect()
    assert written == [["pos", "dataset", "file_name_1", "file_name_2"]]
