"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled, form a stream of words that repeats; equal blocks of it are
taken in order. Slot i of the mix belongs to the source in whose share of [0, 1) the i-th
golden-ratio point falls, so that every stretch of the mix holds the sources near their
weights; the j-th slot of a source takes its j-th block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemograph.llm.running import running
from mnemograph.llm.scratch import Scratch

GOLDEN = 2654435769  # 2 ** 32 divided by the golden ratio, odd
CELL_BITS = 20
CHUNKS = 1024
#: A multiplier and an addend of a full-period generator modulo 2 ** 31, for the shuffle.
TIMES, PLUS = 1103515245, 12345


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each whole text; a null text has none."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row a source: sid, source_size, target, take (whole words), lo and hi (its part of 2 ** 32).

    Sources by code point, null last, get the weights in turn. No target exceeds ``most``
    times its source; what a source can't take goes to the others by weight: with the sources
    in the order of cap over weight, the common level is the highest of the levels that remain
    when the sources before are capped. Windows here run over one row a source.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    one = one.withColumn("sid", F.row_number().over(everyone).cast("long"))
    one = one.withColumns({"weight": F.get(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights)).cast("int")), "cap": most * F.col("source_size")})
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(rising), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
    one = one.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    one = one.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    one = one.withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    upto = F.try_divide(F.sum("take").over(Window.orderBy("sid")), F.sum("take").over(whole))
    edge = F.coalesce(F.floor(upto * float(1 << 32)), F.lit(0)).cast("long")
    one = one.withColumn("hi", edge).withColumn("lo", F.lag("hi", 1, 0).over(Window.orderBy("sid")))
    return one.select("source", "sid", "source_size", "target", "take", "lo", "hi")


def slots(sources: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """(slot, sid, rank): the source of each slot and how many slots it had before.

    A source's blocks beyond its take are left out; the few it still lacks when the points
    are used up (no more than the discrepancy of the sequence) follow at the end.
    """
    spark = sources.sparkSession
    n = sources.agg(F.ceil(F.sum("take") / block)).first()[0] or 0
    cells = sources.where("hi > lo").select(
        "sid", "lo", "hi", F.explode(F.expr(f"sequence(shiftright(lo, {CELL_BITS}), shiftright(hi - 1, {CELL_BITS}))")).alias("cell")
    )
    points = spark.range(int(n)).select(F.col("id").alias("slot"), F.expr(f"(id % {1 << 31}) * {GOLDEN} % {1 << 32}").alias("point"))
    points = points.withColumn("cell", F.expr(f"shiftright(point, {CELL_BITS})"))
    drawn = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "sid")
    drawn = running(drawn, "sid", F.expr("slot div 65536"), ["slot"], F.lit(1), "rank")
    drawn = scratch.keep(drawn, "drawn")
    had = drawn.groupBy(F.col("sid").alias("_sid")).agg(F.count("*").alias("had"))
    need = sources.where("take > 0").join(had, F.col("sid") == F.col("_sid"), "left").select(
        "sid", F.coalesce("had", F.lit(0)).alias("had"), F.ceil(F.col("take") / block).alias("blocks")
    )
    late = need.where("blocks > had").select(
        F.lit(int(n)).cast("long").alias("slot"), "sid", F.explode(F.expr("sequence(had, blocks - 1)")).alias("rank")
    )
    fits = drawn.join(need.select("sid", "blocks"), "sid").where("rank < blocks").select("slot", "sid", F.col("rank").cast("long").alias("rank"))
    return fits.union(late)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 2048
) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, copies.

    One row per input row. taken counts words, repeats included: the takes of a source add up
    to its target, rounded, and no document is taken more than ``most`` times. copies counts
    the passes over the source that take at least half of the document. A null text has size 0
    and is not taken; a null source is a source of its own, the last; a null doc_id is one like
    others. Repeated rows are separate documents. The order depends on doc_id alone, so reruns
    agree. Other columns are not read.
    """
    return _mix(docs, weights, share, most, block)[0]


def schedule(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 2048
) -> DataFrame:
    """The mix itself: (slot, source, doc_id, first, words), a row for each part of a document.

    ``slot`` orders the mix, ``first`` is the part's first word in its document.
    """
    return _mix(docs, weights, share, most, block)[1]


def _mix(docs, weights, share, most, block):
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(sizes_of(docs), "sizes")
    sources = scratch.keep(targets(sizes, weights, share, most), "sources")
    few = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "take")
    few = F.broadcast(few) if few.count() <= 100_000 else few
    spot = F.coalesce((F.pmod("doc_id", F.lit(1 << 31)) * TIMES + PLUS) % (1 << 31), F.lit(0))
    placed = sizes.join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("spot", spot)
    chunk = F.expr(f"spot div {(1 << 31) // CHUNKS}")
    placed = running(placed, "sid", chunk, ["spot", "doc_id", "size"], F.col("size"), "begin")
    placed = scratch.keep(placed, "placed")

    passes = F.explode_outer(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("begin") + e * F.col("source_size") < F.col("take")))
    parts = placed.where("size > 0").withColumn("pass", passes).withColumns(
        {"lo": F.expr("begin + pass * source_size"), "hi": F.expr("least(begin + pass * source_size + size, take)")}
    )
    parts = parts.withColumn("rank", F.explode_outer(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    taken = parts.join(slots(sources, block, scratch), ["sid", "rank"], "left").withColumns(
        {"from": F.greatest("lo", F.col("rank") * block), "to": F.least("hi", (F.col("rank") + 1) * block)}
    )
    words = F.when(F.col("slot").isNotNull(), F.col("to") - F.col("from")).otherwise(F.lit(0))
    taken = taken.withColumn("words", words)
    row = ["sid", "begin", "doc_id", "source", "size", "source_size", "target"]
    by_pass = taken.groupBy(*row, "pass").agg(F.sum("words").alias("words"))
    summed = by_pass.groupBy(*row).agg(
        F.sum("words").alias("taken"), F.sum(F.when(2 * F.col("words") >= F.col("size"), 1).otherwise(0)).alias("copies")
    )
    none = placed.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    out = summed.union(none).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")
    order = taken.where("slot is not null").select("slot", "source", "doc_id", F.expr("from - lo").alias("first"), "words")
    return out, order
