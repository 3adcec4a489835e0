"""op7: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm.packing import pack

NAME = "op7_best_fit_packing"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
