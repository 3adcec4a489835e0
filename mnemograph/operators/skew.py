"""Neighbour lookups and limits that stay balanced when one key holds most rows.

Plain joins are left to adaptive execution, which splits a hot partition of the left side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemograph.session import stage


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the place (from 1) of every row in the order of some columns.

    Rows are dealt to ranges of the order and counted within each; a range starts behind the rows
    of those before it. Only one row per range passes through a single task. Rows alike in all of ``order`` share
    a range, in any order.
    """
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.select("*", F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    offsets = F.broadcast(ranges.select("_range", before.alias("_before")))
    return dealt.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def next_row(df: DataFrame, keys: list[str], pos: str, cols: list[str], name: str, span: int = 4096) -> DataFrame:
    """Add ``name`` = struct(cols) of the row that follows in ``pos`` order within ``keys``.

    The sequence of each key is cut into spans of ``span`` positions. The window
    runs inside a span; the last row of a span takes the first row of the next
    non-empty span, found over one row per span. A key of any length is therefore
    spread over many tasks.
    """
    payload = F.struct(*[F.col(c) for c in cols])
    cut = df.withColumn("_span", F.floor(F.col(pos) / span))
    heads = cut.groupBy(*keys, "_span").agg(F.min_by(payload, F.col(pos)).alias("_head"))
    after = heads.select(
        *keys,
        "_span",
        F.lead("_head").over(Window.partitionBy(*keys).orderBy("_span")).alias("_next_head"),
    )
    inside = cut.withColumn("_lead", F.lead(payload).over(Window.partitionBy(*keys, "_span").orderBy(pos)))
    return (
        inside.join(after, [*keys, "_span"], "left")
        .withColumn(name, F.coalesce("_lead", "_next_head"))
        .drop("_span", "_lead", "_next_head")
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank. Spark cuts each map task to ``k`` rows first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
