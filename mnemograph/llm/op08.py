"""op8: passages that repeat across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm.chaining import passages

NAME = "op8_collinear_chains"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    return passages(spark.read.parquet(f"{folder}/documents.parquet"))
