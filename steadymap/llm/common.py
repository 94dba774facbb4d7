"""Helpers of the training-data operators: staged tables, folds, words and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadymap.session import released, work_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


class Stage:
    """Tables of one run in the shared folder named by ``spark.checkpoint.dir``.

    A staged table cuts lineage, so a lost executor costs a re-read. ``drop`` removes tables of
    earlier rounds that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.again(name, df)

    def save_once(self, df: DataFrame, name: str) -> DataFrame:
        """As ``save``, for a ``df`` that nothing runs again: the files of its shuffles go as soon as it is written.

        Else they stay until the driver's garbage collector finds their owners, so jobs in a row pile them up.
        """
        return released(self.spark, lambda: self.save(df, name))

    def again(self, name: str, like: DataFrame) -> DataFrame:
        """A second reader of a staged table, for joins of a table with itself."""
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def id_fold(key: str | Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``; a null id counts as the empty text, so as fold 0."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return text.encode().translate(TO_LOWER).split() if text else []


def partitions_for(df: DataFrame, per_partition: int, rows: int | None = None) -> int:
    """Shuffle partitions so that one holds about ``per_partition`` rows, and no fewer than the session asks for."""
    rows = df.count() if rows is None else rows
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
