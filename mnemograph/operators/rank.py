"""Fusion, decay and external order of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C
from mnemograph.operators.skew import top_rows


def rrf_fuse(lists: list[DataFrame], top_n: int, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (qid, id, rank) lists: (qid, id, score, rank)."""
    out = lists[0].select("qid", "id", "rank")
    for part in lists[1:]:
        out = out.unionByName(part.select("qid", "id", "rank"))
    share = F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))
    fused = out.filter(F.col("id") != "").groupBy("qid", "id").agg(F.sum(share).alias("score"))
    return top_rows(fused, ["qid"], [F.desc(F.round("score", 9)), F.asc("id")], top_n)


def decay(hits: DataFrame, nodes: DataFrame, as_of: Column, top_n: int, half_life: float = V.HALF_LIFE_DAYS) -> DataFrame:
    """Scores weighed down by age, re-ranked: (qid, id, score, rank)."""
    dated = hits.drop("rank").join(nodes.select("id", "ts"), "id")
    scored = dated.withColumn("score", C.temporal_bias(F.col("score"), F.col("ts"), as_of, half_life)).drop("ts")
    ranked = top_rows(scored, ["qid"], [F.desc(F.round("score", 9)), F.asc("id")], top_n)
    return ranked.select("qid", "id", "score", "rank")


def external_order(hits: DataFrame, orders: DataFrame, top_n: int) -> DataFrame:
    """Reorder (qid, id, rank) by ``orders(qid, indices)``, 1-based positions from a model.

    Repeats and out-of-range numbers are skipped; a query without a usable number
    keeps its first ``top_n`` rows.
    """
    named = orders.select("qid", F.posexplode("indices").alias("pos", "rank"))
    first = named.groupBy("qid", "rank").agg(F.min("pos").alias("pos"))
    chosen = hits.join(first, ["qid", "rank"], "left")
    usable = chosen.groupBy("qid").agg(F.max(F.col("pos").isNotNull()).alias("ordered"))
    rows = chosen.join(usable, "qid").filter(~F.col("ordered") | F.col("pos").isNotNull())
    key = F.when(F.col("ordered"), F.col("pos")).otherwise(F.col("rank"))
    return top_rows(rows, ["qid"], [key.asc()], top_n, "new_rank").select(
        "qid", "id", F.col("rank").alias("old_rank"), F.col("new_rank").alias("rank")
    )
