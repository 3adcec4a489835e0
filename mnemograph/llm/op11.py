"""op11: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm.mainmatter import main_text

NAME = "op11_main_text"
#: SQL can't nest elements; tested against built pages and a plain form of the windows.
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    texts = main_text(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
