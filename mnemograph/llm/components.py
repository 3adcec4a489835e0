"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Each round hooks every node to the smallest node in sight and then replaces
    the edges by edges between the labels; the number of nodes at least halves a
    round. A hub is one key of a partial aggregation. Self edges and repeated
    edges are harmless; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    live = scratch.keep(edges.select("a", "b").where("a <> b"), "edges")
    found = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")), "hook")
        root = _follow(hook, scratch)
        first, second = root.toDF("a", "low_a"), root.toDF("b", "low_b")
        thinner = (
            live.join(first, "a").join(second, "b").where("low_a <> low_b")
            .select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).distinct()
        )
        thinner = scratch.keep(thinner, "edges")
        if found is None:
            found = root
        else:
            step = root.toDF("component", "next")
            newer = scratch.keep(
                found.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "found"
            )
            scratch.drop(found, root)
            found = newer
        scratch.drop(live)
        if root._scratch_path != hook._scratch_path:
            scratch.drop(hook)
        live = thinner
    if found is None:
        return spark.createDataFrame([], "node long, component long")
    return found


def _follow(hook: DataFrame, scratch: Scratch) -> DataFrame:
    """Replace ``up`` by the end of its chain; chains shrink by half a round."""
    now = hook.toDF("node", "component")
    now._scratch_path = hook._scratch_path
    first = now
    while True:
        step = now.select(F.col("node").alias("component"), F.col("component").alias("next"))
        joined = now.join(step, "component")
        if joined.where("next <> component").isEmpty():
            return now
        longer = scratch.keep(joined.select("node", F.col("next").alias("component")), "follow")
        if now is not first:
            scratch.drop(now)
        now = longer
