"""Date expressions of log queries, resolved against an ``as_of`` column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mnemograph.functions.columns import trim_ws

NTZ = "timestamp_ntz"
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# Accepted calendar formats.
FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy"]


def calendar_date(expr: Column, as_of: Column) -> Column:
    """A single day: today / tomorrow / yesterday / a written date / "N days ago"; null if unreadable."""
    text = F.lower(trim_ws(expr))
    today = F.to_date(as_of)
    written = F.initcap(text)
    parsed = F.coalesce(*[F.try_to_timestamp(written, F.lit(f)).cast("date") for f in FORMATS])
    ago = F.regexp_extract(text, r"^(\d{1,6}) days? ago$", 1)
    return (
        F.when(text == "today", today)
        .when(text == "tomorrow", F.date_add(today, 1))
        .when(text == "yesterday", F.date_sub(today, 1))
        .when(ago != "", F.date_sub(today, F.nullif(ago, F.lit("")).try_cast("int")))
        .otherwise(parsed)
    )


def _end_of(day: Column) -> Column:
    return F.date_add(day, 1).cast(NTZ) - F.expr("INTERVAL '1' SECOND")


def relative_range(expr: Column, as_of: Column) -> Column:
    """struct(start, end), both inclusive; null fields when the expression is unreadable."""
    text = F.lower(trim_ws(expr))
    today = F.to_date(as_of)
    now = as_of.cast(NTZ)
    monday = F.trunc(today, "week").cast("date")
    month = F.trunc(today, "month").cast("date")
    since = F.regexp_extract(text, r"^since\s+(.*)$", 1)

    weekday = F.lit(None).cast("int")
    for i, name in enumerate(DAYS):
        weekday = F.when(since.isin(name, name[:3]), i).otherwise(weekday)
    back = F.pmod(F.weekday(today) - weekday, F.lit(7))
    # on a Sunday, "since sunday" reaches back a whole week
    back = F.when((F.weekday(today) == 6) & (weekday == 6), 7).otherwise(back)
    from_day = F.coalesce(F.date_sub(today, back), calendar_date(since, as_of))
    day = calendar_date(text, as_of)

    start = (
        F.when(text.isin("this morning", "today"), today)
        .when(text == "since yesterday", F.date_sub(today, 1))
        .when(text == "last week", F.date_sub(monday, 7))
        .when(text == "last month", F.add_months(month, -1))
        .when(since != "", from_day)
        .otherwise(day)
        .cast(NTZ)
    )
    end = (
        F.when(text == "last week", _end_of(F.date_sub(monday, 1)))
        .when(text == "last month", _end_of(F.date_sub(month, 1)))
        .when((text == "this morning") | (since != ""), now)
        .otherwise(_end_of(day))
    )
    return F.struct(start.alias("start"), F.when(start.isNotNull(), end).alias("end"))


def resolve_range(start_expr: Column, end_expr: Column, as_of: Column) -> Column:
    """struct(start_date, end_date) as yyyy-MM-dd strings; null start when unreadable."""
    prefix = lambda e: F.regexp_extract(e, r"^\d{4}-\d{2}-\d{2}", 0)
    first = relative_range(start_expr, as_of)
    iso = F.try_to_timestamp(prefix(start_expr), F.lit("yyyy-MM-dd")).cast("date")
    start = F.coalesce(F.to_date(first["start"]), iso)
    own_end = F.coalesce(F.to_date(first["end"]), iso)
    last = relative_range(end_expr, as_of)
    end_iso = F.try_to_timestamp(prefix(end_expr), F.lit("yyyy-MM-dd")).cast("date")
    has_end = (F.coalesce(end_expr, F.lit("")) != "") & (end_expr != start_expr)
    end = F.when(has_end, F.coalesce(F.to_date(last["end"]), end_iso, own_end)).otherwise(own_end)
    return F.struct(start.cast("string").alias("start_date"), end.cast("string").alias("end_date"))
