"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemograph.llm import chaining, mixing, packing, quality
from mnemograph.llm.hyperminhash import near_duplicates
from mnemograph.llm.scratch import Scratch

#: SQL doesn't express near-duplicate classes, chains and packing.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; all columns are kept as they are, whatever their names.

    A null or empty text has too few words and goes, a very long one is read whole; repeated rows are judged alike.
    """
    sketch = quality.sketches(quality.features(docs.select("text", "lang", "source")))
    limits = Scratch(spark, "quality").keep(quality.thresholds(sketch), "limits")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    return quality.decide(quality.features(whole), limits).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (similarity of 0.8 or more), the one of smallest doc_id, in one row."""
    scratch = Scratch(spark, "near-dedup")
    classes = scratch.keep(near_duplicates(docs, percent=80).select("doc_id", "kept"), "classes")
    gone = classes.where("not kept").select("doc_id").distinct()
    left = docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, "doc_id", "left_anti")
    again = scratch.keep(classes.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    first = Window.partitionBy("doc_id").orderBy("text")
    one = left.join(again, "doc_id", "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id has too."""
    return chaining.without(docs, chaining.passages(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    takes = mixing.mix(docs).groupBy(F.col("doc_id").alias("_doc_id"), F.col("size").alias("_size")).agg(F.max("copies").alias("_copies"))
    takes = Scratch(spark, "mix").keep(takes.where("_copies > 0"), "takes")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.withColumn("_words", size)
    takes = F.broadcast(takes) if takes.count() <= 1_000_000 else takes
    joined = sized.join(takes, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.col("_words") == F.col("_size")))
    return joined.withColumn("_copy", F.explode(F.expr("sequence(1, _copies)"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules), ("near dedup", near_dedup), ("substring dedup", drop_passages),
    ("mix sources", mix_sources), ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
