"""op6: token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm.tokens import count_tokens

NAME = "op6_token_counts"
SQL = None
LIMIT = 4096


def query(spark: SparkSession, folder: str) -> DataFrame:
    counts = count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", counts.n_tokens > LIMIT)
