"""Session helpers: builder for tests and benches, and intermediate tables on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and ``bench.py``; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("steadymap")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Spark's setting that removes the shuffle files of a query when it ends
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folder: tempfile.TemporaryDirectory | None = None


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share a disk, falls back to a temporary
    folder that disappears with the process.
    """
    global _local_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="steadymap-")
    return _local_folder.name


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of inputs that several jobs read: executors may be lost without
    recomputing them, plans stay small and columns are still pruned.
    """
    path = f"{work_folder(df.sparkSession)}/steadymap-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def released(spark: SparkSession, job):
    """``job()``, whose queries nothing runs again: the files of their shuffles go as soon as they end."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        return job()
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


_shared: list[DataFrame] = []


def share(df: DataFrame) -> DataFrame:
    """Keep a small result that one query reads more than once; lost blocks are recomputed."""
    _shared.append(df.persist())
    return df


def release_shared() -> None:
    """Drop everything ``share`` kept; call it once the results have been consumed."""
    while _shared:
        _shared.pop().unpersist()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scan over the cores when its files give fewer tasks than there are cores.

    Scans of many files already have enough tasks and are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
