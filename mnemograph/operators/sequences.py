"""Budgets, recent turns, repeats and question order within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemograph.functions import columns as C
from mnemograph.operators.skew import next_row, top_rows
from mnemograph.session import stage


def rank_in_list(hits: DataFrame, most: int | None = None) -> DataFrame:
    """1-based rank of the rows in each (qid, list), by (score desc, id); of the first ``most`` only when given."""
    order = [F.desc("score"), F.asc("id")]
    if most is not None:
        return top_rows(hits, ["qid", "list"], order, most)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "list").orderBy(*order)))


def entry_line(ts: Column, source: Column, content: Column, image_url: Column, description: Column, entry_id: Column) -> Column:
    when = F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("(no date)"))
    line = F.concat(F.lit("["), when, F.lit("] ("), C.text_or_empty(source), F.lit(") "), C.text_or_empty(content))
    described = F.when(
        C.text_or_empty(description) != "", F.concat(F.lit("\n[Attached Image Content: "), description, F.lit("]"))
    ).otherwise("\n[Attached image]")
    tail = F.when(C.text_or_empty(entry_id) != "", F.concat(F.lit("\n[Entry UUID: "), entry_id, F.lit("]"))).otherwise("")
    return F.when(C.text_or_empty(image_url) != "", F.concat(line, described, tail)).otherwise(line)


def query_line(ts: Column, source: Column, question: Column, answer: Column) -> Column:
    when = F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("(no date)"))
    short = F.when(F.length(answer) > 300, F.concat(C.cut_runes(answer, 300), F.lit("..."))).otherwise(answer)
    return F.concat(
        F.lit("["), when, F.lit("] ("), source, F.lit(")\n  Q: "), question, F.lit("\n  A: "), short
    )


def task_line(task_id: Column, status: Column, due: Column, content: Column) -> Column:
    return F.concat(
        F.lit("["), task_id, F.lit("] status="), status, F.lit(" due="),
        F.coalesce(F.nullif(due, F.lit("")), F.lit("(not set)")), F.lit(" | "), C.cut_runes(content, 120),
    )


def char_budget(
    rows: DataFrame, budget: int, order: list[Column], gap: int = 1, noun: str | None = "entries"
) -> DataFrame:
    """Leading rows of each ``ctx`` whose summed ``line`` length (+ ``gap`` each) fits ``budget``.

    When rows are left over, one more row says how many (unless ``noun`` is None).
    The shortest line is measured first: no more rows than the budget has room for such
    lines can fit, and only that many rows per context reach the running sum. Only where
    lines are empty and ``gap`` is 0 all rows do.
    """
    totals = stage(rows.groupBy("ctx").agg(F.count(F.lit(1)).alias("total"), F.min(F.length("line")).alias("shortest")), "totals")
    least = (totals.agg(F.min("shortest")).first()[0] or 0) + gap
    if least:
        head = top_rows(rows, ["ctx"], order, budget // least + 1, "pos")
    else:
        head = rows.withColumn("pos", F.row_number().over(Window.partitionBy("ctx").orderBy(*order)))
    running = Window.partitionBy("ctx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("line") + gap).over(running)
    fits = head.withColumn("used", used).filter(F.col("used") <= budget).select("ctx", "pos", "line")
    if noun is None:
        return fits
    shown = fits.groupBy("ctx").agg(F.max("pos").alias("shown"))
    rest = F.col("total") - F.coalesce("shown", F.lit(0))
    trailer = totals.join(shown, "ctx", "left").filter(rest > 0).select(
        "ctx",
        (F.coalesce("shown", F.lit(0)) + 1).alias("pos"),
        F.concat(F.lit("... and "), rest.cast("string"), F.lit(f" more {noun} (truncated)")).alias("line"),
    )
    return fits.unionByName(trailer)


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """First row per key in ``order``; merged map-side, no group is collected."""
    first = F.min_by(F.struct(*keep), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def recent_turns(queries: DataFrame, keys: list[str], keep: int = 5) -> DataFrame:
    """Last ``keep`` exchanges per key with short texts; ``pos`` counts from the oldest kept."""
    last = top_rows(queries, keys, [F.desc("ts"), F.desc("id")], keep, "back")
    w = Window.partitionBy(*keys).orderBy(F.desc("back"))
    return last.select(
        *keys,
        F.row_number().over(w).alias("pos"),
        F.date_format("ts", "HH:mm").alias("at"),
        C.cut_runes(F.col("question"), 100).alias("question"),
        C.cut_runes(F.col("answer"), 150).alias("answer"),
    )


def repeat_signature(iterations: DataFrame) -> DataFrame:
    """Iterations of a run whose call signature equals that of the next one: (run_id, iteration, repeated_at)."""
    rows = next_row(iterations, ["run_id"], "iteration", ["iteration", "signature"], "after")
    same = (F.col("signature") == F.col("after.signature")) & (F.col("signature") != "")
    return rows.filter(same).select("run_id", "iteration", F.col("after.iteration").alias("repeated_at"), "signature")


def backoff_days(ask_count: Column) -> Column:
    """Days to wait before asking again: 0, 1, 2, 4, ... at most 30."""
    doubled = F.pow(F.lit(2.0), F.least(ask_count, F.lit(6)) - 1)
    return F.when(ask_count <= 0, 0).otherwise(F.least(F.lit(30.0), doubled)).cast("int")


def next_question(questions: DataFrame, as_of: Column, mentioned: DataFrame | None = None) -> DataFrame:
    """Question to ask each client: a mentioned one first, else the newest one whose backoff has passed.

    ``mentioned`` holds (client, id). Questions are open ones with a ``client`` column.
    """
    waited = C.seconds_between(F.col("last_asked"), as_of) >= backoff_days(F.col("ask_count")) * 86400
    due = (F.col("ask_count") == 0) | F.col("last_asked").isNull() | waited
    rows = questions.filter(F.col("resolved").isNull()).withColumn("due", due)
    if mentioned is None:
        rows = rows.withColumn("hit", F.lit(False))
    else:
        flags = mentioned.select("client", "id", F.lit(True).alias("hit")).distinct()
        rows = rows.join(flags, ["client", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    rows = rows.filter(F.col("hit") | F.col("due")).withColumn(
        "age", -F.unix_micros(F.col("created").cast("timestamp"))
    )
    return first_occurrence(
        rows.withColumn("miss", ~F.col("hit")), ["client"], ["miss", "age", "id"], ["id", "hit"]
    )
