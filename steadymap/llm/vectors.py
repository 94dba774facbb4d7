"""Which rows of a vector table take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(table: DataFrame, vector: str) -> int:
    """The most frequent length of a vector, the smaller of equally frequent ones; 0 for an empty table."""
    rows = table.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    best = rows.where("d > 0").orderBy(F.desc("count"), "d").first()
    return best[0] if best else 0


def usable(vector: str, dim: int) -> Column:
    """A vector of ``dim`` finite components that are not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
