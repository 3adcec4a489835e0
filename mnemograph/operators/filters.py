"""Filtered, ordered and limited scans.

All of them are a pushed-down filter and a top-k, so Spark keeps k rows per task
and never sorts the table. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemograph.functions import columns as C
from mnemograph.operators.keywords import contains_all
from mnemograph.operators.skew import top_rows

OPEN = ["pending", "active"]


def newest(df: DataFrame, limit: int | None, ts: str = "ts") -> DataFrame:
    """Newest ``limit`` rows, or all of them, in that order."""
    rows = df.orderBy(F.desc(ts), F.asc("id"))
    return rows if limit is None else rows.limit(limit)


def oldest(df: DataFrame, limit: int | None, ts: str = "ts") -> DataFrame:
    """Oldest ``limit`` rows, or all of them, in that order."""
    rows = df.orderBy(F.asc(ts), F.asc("id"))
    return rows if limit is None else rows.limit(limit)


def in_range(df: DataFrame, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``; a bare end date includes its whole day."""
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        upper = F.lit(end).cast("timestamp_ntz")
        bare = len(end) == 10
        df = df.filter(F.col(ts) < upper + F.expr("INTERVAL '1' DAY") if bare else F.col(ts) <= upper)
    return df


def by_date(df: DataFrame, start: str, end: str, limit: int, ts: str = "ts") -> DataFrame:
    return newest(in_range(df, start, end, ts), limit, ts)


def since(df: DataFrame, watermark: str | None, limit: int | None = None) -> DataFrame:
    """Oldest rows after the watermark; without one, the newest rows."""
    if not watermark:
        return newest(df, limit)
    return oldest(df.filter(F.col("ts") > F.lit(watermark).cast("timestamp_ntz")), limit)


def scan_window(df: DataFrame, rows: int, ts: str = "ts") -> DataFrame:
    """Only the newest ``rows`` rows; filters applied afterwards see nothing older."""
    return newest(df, rows, ts)


def search_entries(
    entries: DataFrame, keywords: str, limit: int, text: str = "content", window: int | None = None
) -> DataFrame:
    """Newest rows that contain every keyword."""
    rows = scan_window(entries, window) if window else entries
    return newest(rows.filter(contains_all([F.col(text)], keywords)), limit)


def search_knowledge(nodes: DataFrame, keywords: str, limit: int, window: int | None = None) -> DataFrame:
    """Newest non-log rows with every keyword in content or metadata; no keywords, no rows."""
    rows = scan_window(nodes, window) if window else nodes
    rows = rows.filter(F.col("node_type") != "log")
    if not keywords.split():
        return rows.limit(0)
    return newest(rows.filter(contains_all([F.col("content"), F.col("metadata")], keywords)), limit)


def search_category(analysed: DataFrame, phrase: str, category: str, limit: int) -> DataFrame:
    category_of = F.get_json_object("entry_analysis", "$.category")
    hit = (category_of == category) & F.contains(F.lower("content"), F.lit(phrase.lower()))
    return newest(analysed.filter(hit), limit)


def mentions(df: DataFrame, phrase: str, column: str = "content") -> DataFrame:
    return df.filter(F.contains(F.lower(column), F.lit(phrase.lower())))


def activity_history(
    entries: DataFrame, topic: str, start: str | None = None, end: str | None = None, limit: int | None = None
) -> DataFrame:
    """Entries about a topic, oldest first; with ``limit`` only the newest ``limit`` of them."""
    rows = mentions(in_range(entries, start, end), topic)
    return oldest(rows if limit is None else newest(rows, limit), None)


def by_source(entries: DataFrame, part: str, limit: int) -> DataFrame:
    return newest(mentions(entries, part, "source"), limit)


def with_image(entries: DataFrame, limit: int) -> DataFrame:
    return newest(entries.filter(F.col("image_url") != ""), limit)


def open_roots(tasks: DataFrame, limit: int = 25) -> DataFrame:
    return newest(tasks.filter((F.col("parent_id") == "") & F.col("status").isin(OPEN)), limit)


def open_children(tasks: DataFrame, per_parent: int = 20) -> DataFrame:
    """Open children of every parent, oldest first, at most ``per_parent`` each."""
    rows = tasks.filter((F.col("parent_id") != "") & F.col("status").isin(OPEN))
    return top_rows(rows, ["parent_id"], [F.asc("ts"), F.asc("id")], per_parent)


def tasks_by_status(tasks: DataFrame, status: str, limit: int) -> DataFrame:
    return newest(tasks.filter(F.col("status") == C.task_status(F.lit(status))), limit)


def of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.filter(F.col("node_type").isin(*types))


def signals(nodes: DataFrame, limit: int) -> DataFrame:
    """Newest self-model thoughts as display lines."""
    rows = nodes.filter((F.col("domain") == "selfmodel") & (F.col("node_type") == "thought"))
    picked = newest(rows.filter(F.col("content") != ""), limit)
    when = F.coalesce(F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1, 19), F.lit("(no date)"))
    return picked.select("id", "ts", F.concat(F.lit("- ["), when, F.lit("] "), "content").alias("line"))


def summaries(nodes: DataFrame, limit: int) -> DataFrame:
    """Newest summary rows as display lines."""
    picked = newest(of_type(nodes, "summary").filter(F.col("content") != ""), limit)
    day = F.col("ts").cast("date").cast("string")
    line = F.when(F.col("ts").isNull(), F.col("content")).otherwise(F.concat(F.lit("["), day, F.lit("]: "), "content"))
    return picked.select("id", "ts", line.alias("line"))


def unresolved(questions: DataFrame, limit: int | None = 20) -> DataFrame:
    return newest(questions.filter(F.col("resolved").isNull()), limit, "created")


def resolved(questions: DataFrame, since_ts: str, limit: int | None = None, by: str = "created") -> DataFrame:
    """Resolved questions created (or resolved, with ``by='resolved'``) from ``since_ts`` on."""
    recent = F.col(by) >= F.lit(since_ts).cast("timestamp_ntz")
    return newest(questions.filter(F.col("resolved").isNotNull() & recent), limit, "created")


def active_goals(nodes: DataFrame, limit: int = 20) -> DataFrame:
    status = F.get_json_object("metadata", "$.status")
    rows = of_type(nodes, "goal", "project").withColumn("status", status)
    return top_by_weight(rows.filter(F.col("status").isin("active", "planning", "blocked")), limit)


def top_by_weight(df: DataFrame, limit: int, weight: str = "weight") -> DataFrame:
    return df.orderBy(F.desc(weight), F.asc("id")).limit(limit)


def countdowns(nodes: DataFrame, as_of: Column, name: str | None = None) -> DataFrame:
    """Countdown rows with whole days until the target (negative once it has passed)."""
    rows = of_type(nodes, "countdown")
    if name:
        rows = mentions(rows, name)
    target = F.try_to_timestamp(F.get_json_object("metadata", "$.target_date"), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    hours = C.seconds_between(as_of, target) / 3600.0
    return rows.withColumn("target", target.cast("date")).filter(F.col("target").isNotNull()).select(
        "id",
        F.regexp_replace("content", "^Countdown: ", "").alias("name"),
        F.col("target").cast("string").alias("target"),
        (hours / 24).cast("int").alias("days"),
    )


def bookmarks(nodes: DataFrame) -> DataFrame:
    """Bookmark rows, one per tag."""
    rows = of_type(nodes, "bookmark")
    tags = F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>")
    return rows.select(
        "id",
        F.regexp_replace("content", "^Bookmark: ", "").alias("title"),
        F.get_json_object("metadata", "$.url").alias("url"),
        F.explode_outer(tags).alias("tag"),
    )


def get_by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is listed; empty, repeated and unknown ids are ignored."""
    wanted = ids.filter(F.coalesce("id", F.lit("")) != "").select("id").distinct()
    return rows.join(wanted, "id", "left_semi")


def decision_lines(lines: DataFrame, keep: int = 50) -> DataFrame:
    """Last ``keep`` lines per run that hold a decision marker."""
    rows = lines.filter(C.decision_line(F.col("line")))
    return top_rows(rows, ["run_id"], [F.desc("line_no")], keep)
