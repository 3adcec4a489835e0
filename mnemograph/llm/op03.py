"""op3: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm.hyperminhash import near_duplicates

NAME = "op3_hyperminhash"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
