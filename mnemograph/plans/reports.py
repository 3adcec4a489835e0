"""Inputs of the periodic jobs: context blocks, briefing, synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemograph.functions import columns as C
from mnemograph.operators import filters, joins
from mnemograph.operators.skew import numbered


def _block(df: DataFrame, name: str, text: Column, order: Column) -> DataFrame:
    return df.select(F.lit(name).alias("section"), "id", order.cast("string").alias("key"), text.alias("text"))


def context_blocks(nodes: DataFrame, queries: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per line of the assistant's standing context: (section, id, key, text).

    Identity, last five exchanges, three signals, three gaps, the active project with its
    children, three summaries.
    """
    recent = filters.newest(queries, 5)
    turn = F.concat(
        F.date_format("ts", "HH:mm"), F.lit(" User: "), C.cut_runes(F.col("question"), 100),
        F.lit("\n      Asst: "), C.cut_runes(F.col("answer"), 150),
    )
    gaps = filters.newest(queries.filter("is_gap"), 3)
    identity = filters.newest(filters.of_type(nodes, "user_identity"), 20)
    project = joins.active_project(tasks)
    task_text = F.concat(F.lit("["), "status", F.lit("] "), "content")
    ts = F.col("ts")
    blocks = [
        _block(identity, "identity", F.col("content"), ts),
        _block(recent, "conversation", turn, ts),
        _block(filters.signals(nodes, 3), "signal", F.col("line"), ts),
        _block(gaps, "gap", F.concat(F.lit("- "), C.cut_runes(F.col("question"), 120)), ts),
        _block(project, "project", task_text, ts),
        _block(filters.summaries(nodes, 3), "summary", F.col("line"), ts),
    ]
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def briefing_inputs(entries: DataFrame, nodes: DataFrame, watermark: str | None, most: int | None = None, fallback: int = 3) -> DataFrame:
    """New entries and active goals; without new entries only the top goals: (part, id, rank, text)."""
    new = filters.since(entries, watermark, most)
    kept = filters.active_goals(nodes, fallback if new.isEmpty() else 20)
    kept = kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), F.asc("id"))))
    placed = numbered(new.select("id", "ts", "content"), ["ts", "id"], "rank")
    return placed.select(F.lit("entry").alias("part"), "id", "rank", F.col("content").alias("text")).unionByName(
        kept.select(
            F.lit("goal").alias("part"), "id", "rank",
            F.concat(F.lit("["), "node_type", F.lit("/"), "status", F.lit("] "), "content").alias("text"),
        )
    )


def synthesis_inputs(
    entries: DataFrame, tasks: DataFrame, questions: DataFrame, watermark: str | None, month_ago: str, most: int | None = None
) -> DataFrame:
    """(part, id, text): all new (or the oldest ``most``) entries, open root tasks, open and recently answered questions."""
    new = filters.since(entries, watermark, most)
    answer = F.coalesce(F.nullif(C.trim_ws(F.col("answer")), F.lit("")), F.lit("(skipped)"))
    parts = [
        new.select(F.lit("entry").alias("part"), "id", F.col("content").alias("text")),
        filters.open_roots(tasks, 10).select(
            F.lit("task").alias("part"), "id", F.concat(F.lit("["), "status", F.lit("] "), "content").alias("text")
        ),
        filters.unresolved(questions, 20).select(
            F.lit("open").alias("part"), "id", F.concat(F.lit("[OPEN] "), "question").alias("text")
        ),
        filters.resolved(questions, month_ago).select(
            F.lit("answered").alias("part"), "id", F.concat(F.lit("[ANSWERED] "), "question", F.lit(" → "), answer).alias("text")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def should_skip(new_rows: int, hours_since_last: float | None, forced: bool, least: int = 5, interval_hours: float = 24) -> bool:
    """Whether a cycle waits: too few rows, the last run is recent, and it is neither the first nor forced."""
    if forced or hours_since_last is None or new_rows >= least:
        return False
    return hours_since_last < interval_hours
