"""op10: near-duplicate classes of all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm.descent import near_vectors

NAME = "op10_nn_descent"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
