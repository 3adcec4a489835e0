"""Intermediate tables of one run in the shared folder; those of long rounds are dropped, the others stay for the caller to remove."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.session import staging_dir


class Scratch:
    """Tables written under one folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor repeats the tasks of the
    current step only, and what was decided before stays decided.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, key: str, ids: DataFrame, at_most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one-column table ``ids``.

    ``ids`` (a written table) is counted first: up to ``at_most`` ids, some 16 MB,
    travel to the rows; more are joined by a shuffle.
    """
    ids = ids.toDF(key).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= at_most else ids, key, "left_semi")
