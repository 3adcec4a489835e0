"""op12: periodic runs of all documents, some made periodic first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm.runs import periodic_runs

NAME = "op12_periodic_runs"
#: SQL has no automaton; tested against brute force.
SQL = None


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every word from word a on taken from the p words at a, where crc32(doc_id) % 10 is 0."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(hashed % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", F.floor(hashed / 10).alias("_g"), words.alias("_words")).withColumn("_n", F.size("_words"))
    split = split.withColumn("_a", F.expr("CASE WHEN _n > 0 THEN int(_g % _n) END"))
    split = split.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    tail = "slice(flatten(array_repeat(slice(_words, _a + 1, _p), int(ceil((_n - _a) / _p)))), 1, _n - _a)"
    made = F.expr(f"array_join(concat(slice(_words, 1, _a), {tail}), ' ')")
    return split.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(made_periodic(spark.read.parquet(f"{folder}/documents.parquet")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r.length, r.start, r.period)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    found = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id", "n_runs", F.col("_best.start").alias("start"), (-F.col("_best.col1")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("(-1000 * _best.col1) div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
