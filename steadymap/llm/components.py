"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``links`` (``a``, ``b``) with a partner.

    Each round hooks neighbours onto the smallest of them, larger ones first, then the rest, until
    nothing changes; the number of rounds grows with the logarithm of a component's size. Rounds
    aggregate minima (combined before the shuffle) and write their state as a staged table, so a hub
    with many links never sits in one task's memory.
    """
    edges = stage.save(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges-0")
    done, rounds, before = False, 0, None
    while not done:
        rounds += 1
        # large star: every larger neighbour of a node points to the smallest in its neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage.save(large, f"large-{rounds}")
        # small star: a node and its smaller neighbours point to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        small = stage.save(small, f"edges-{rounds}")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(f"edges-{rounds - 1}", f"large-{rounds}")
        edges, done, before = small, state == before, state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
