"""Counts and rollups. Each is a partial and a final hash aggregate; none collects a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C
from mnemograph.session import stage
from mnemograph.operators.filters import in_range


def count_entries(entries: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return in_range(entries, start, end).agg(F.count(F.lit(1)).alias("n"))


def unique_sources(entries: DataFrame) -> DataFrame:
    return entries.filter(F.coalesce("source", F.lit("")) != "").select("source").distinct()


def dates_with_entries(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("ts").cast("date").cast("string").alias("day")).distinct()


def local_days(events: DataFrame, zone: Column) -> DataFrame:
    """Rows and score per owner and day of the owner's zone; times are UTC."""
    local = F.convert_timezone(F.lit("UTC"), C.zone_of(zone), F.col("ts"))
    return events.groupBy("owner", local.cast("date").cast("string").alias("local_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")
    )


def analysis_of(analysed: DataFrame) -> DataFrame:
    return analysed.withColumn("analysis", C.parse_analysis(F.col("entry_analysis"), F.col("id")))


def entities_of(analysed: DataFrame) -> DataFrame:
    """One row per extracted entity."""
    return (
        analysis_of(analysed)
        .select("id", "ts", F.col("analysis.category").alias("category"), F.explode("analysis.entities").alias("e"))
        .select("id", "ts", "category", "e.name", "e.type", "e.status", "e.source_id")
    )


def entity_rollup(
    analysed: DataFrame,
    entity_type: str = "",
    name_part: str = "",
    status: str = "",
    category: str = "",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Distinct entities by name, type, status and source, with the newest date they occur on."""
    rows = entities_of(in_range(analysed, start, end))
    if entity_type:
        rows = rows.filter(F.lower("type") == entity_type.lower())
    if name_part:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(name_part.lower())))
    if status:
        rows = rows.filter(F.col("status") == status)
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy("name", "type", "status", "source_id").agg(
        F.max(F.col("ts").cast("date")).cast("string").alias("entry_date")
    )


def daily_summary(analysed: DataFrame, keep: str = "newest") -> DataFrame:
    """Per day, as rows (day, part, key, value, n): entry count, summaries, tag counts, entity statuses.

    Of several statuses of one entity on a day, the newest counts (or ``keep='oldest'``).
    Summary lines are as they are written; counts and statuses are aggregations of their own.
    """
    doc = stage(analysis_of(analysed).select(
        F.col("ts").cast("date").cast("string").alias("day"), "ts", "id", C.trim_ws(C.text_or_empty(F.col("analysis.summary"))).alias("summary"),
        F.transform(_or_empty("analysis.tags"), C.trim_ws).alias("tags"),
        F.transform(
            _or_empty("analysis.entities"),
            lambda e, i: F.struct(F.concat_ws("|", e["name"], e["type"]).alias("key"), e["status"].alias("value"), i.alias("pos")),
        ).alias("entities"),
    ), "analyses")
    out = lambda rows, part, key, value, n: rows.select(
        "day", F.lit(part).alias("part"), key.alias("key"), value.alias("value"), n.cast("bigint").alias("n")
    )
    blank, one, n = F.lit(""), F.lit(1), F.col("n")
    stamp = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "))
    summaries = out(doc.filter("summary <> ''"), "summary", F.col("id"), F.concat(stamp, "summary"), one)
    counted = doc.select("day", F.explode(F.concat(F.array(F.struct(F.lit("entries").alias("part"), blank.alias("key"))), F.transform(
        "tags", lambda t: F.struct(F.lit("tag").alias("part"), t.alias("key"))))).alias("f"))
    counted = counted.groupBy("day", "f.part", "f.key").agg(F.count(one).alias("n")).select("day", "part", "key", blank.alias("value"), "n")
    seen = doc.select("day", "ts", "id", F.explode("entities").alias("e"))
    if keep == "newest":
        value = F.max_by("e.value", F.struct("ts", "id", "e.pos"))
    else:
        value = F.min_by("e.value", F.struct("ts", "id", (-F.col("e.pos")).alias("p")))
    statuses = seen.groupBy("day", F.col("e.key").alias("key")).agg(value.alias("value"), F.count(one).alias("n"))
    return summaries.unionByName(counted).unionByName(out(statuses, "entity", F.col("key"), F.col("value"), n))


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array())


def retrieval_quality(hits: DataFrame) -> DataFrame:
    """Median, p90, maximum and label of the scores of each query. Groups are at most top-k long."""
    sorted_scores = F.sort_array(F.collect_list("score"))
    grouped = hits.groupBy("qid").agg(sorted_scores.alias("s"))
    n = F.size("s")
    at = lambda i: F.get(F.col("s"), i.cast("int"))
    half = F.floor(n / 2)
    median = F.when(n % 2 == 0, (at(half - 1) + at(half)) / 2).otherwise(at(half))
    p90 = at(F.least(F.floor(n * 0.9), n - 1))
    out = grouped.select("qid", n.alias("n"), median.alias("median"), p90.alias("p90"), at(n - 1).alias("top"))
    label = (
        F.when(F.col("p90") >= 0.6, "HIGH_CONFIDENCE_MATCH")
        .when((F.col("median") >= 0.5) | (F.col("top") >= 0.6), "MEDIUM_CONFIDENCE_MATCH")
        .otherwise("LOW_CONFIDENCE_MATCH")
    )
    return out.withColumn("status", label)


def with_usage(calls: DataFrame, prices: dict | None = None) -> DataFrame:
    """Calls with token counts (bytes / 4 where usage is missing), price key and cost."""
    tokens_in = F.coalesce("prompt_tokens", F.floor(F.col("input_bytes") / 4), F.lit(0))
    tokens_out = F.coalesce("completion_tokens", F.lit(0))
    return calls.withColumns(
        {
            "tokens_in": tokens_in,
            "tokens_out": tokens_out,
            "price_key": C.price_key(F.col("model"), prices),
            "cost": C.call_cost(F.col("model"), tokens_in, tokens_out, prices),
        }
    )


def cost_rollup(calls: DataFrame, prices: dict | None = None) -> DataFrame:
    return with_usage(calls, prices).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost").alias("cost"),
    )


def token_audit(calls: DataFrame, threshold: int = 2048) -> DataFrame:
    """Static, recent and total tokens per model, and how many calls could be cached."""
    static = F.col("system_tokens") + F.col("tool_tokens") + F.col("archive_tokens")
    return calls.withColumn("static", static).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("static").alias("static_tokens"),
        F.sum(F.col("static") + F.col("recent_tokens")).alias("total_tokens"),
        F.sum(F.when(F.col("static") > threshold, 1).otherwise(0)).alias("cacheable"),
    )


def latency_breakdown(requests: DataFrame) -> DataFrame:
    """Seconds per phase and path; overhead is what the phases leave of the total."""
    overhead = F.greatest(F.lit(0.0), F.col("total_s") - F.col("llm_s") - F.col("embedding_s") - F.col("write_s"))
    return requests.withColumn("overhead_s", overhead).groupBy("path").agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.sum(c).alias(c) for c in ("llm_s", "embedding_s", "write_s", "overhead_s")],
        F.max("total_s").alias("slowest_s"),
    )


def quantile_sketch(rows: DataFrame, keys: list[str], value: str, error: float = 0.01) -> DataFrame:
    """(keys, bucket, n): counts of the values in buckets whose bounds grow by (1 + error) / (1 - error).

    Sketches of parts of the data are merged by adding the counts of equal keys and buckets. Values of
    zero or less share the bucket null; null values aren't counted.
    """
    growth = (1 + error) / (1 - error)
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value)) / F.log(F.lit(growth))))
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float], error: float = 0.01) -> DataFrame:
    """(keys, n, one column for each of ``shares``): values within ``error`` of the exact ones, relative to them.

    A group is as many rows as it has buckets: some 1,400 from a microsecond to a year at 1 percent.
    """
    growth = (1 + error) / (1 - error)
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    summed = merged.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    middle = F.coalesce(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1), F.lit(0.0))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * share), middle))
    return summed.groupBy(*keys).agg(F.max("total").alias("n"), *[at(share).alias(name) for name, share in shares.items()])


def text_stats(docs: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Text statistics of every row, summed by ``by``."""
    stats = C.text_stats(F.col(text))
    sums = [F.sum(name).alias(name) for name in stats]
    return docs.withColumns(stats).groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), *sums)


def normalised_args(arguments: Column) -> Column:
    """Search text of a tool call (lower-cased, trimmed), or its whole arguments."""
    search = C.bind(
        C.variant_of(arguments), lambda doc: F.coalesce(*[C.string_field(doc, k) for k in V.TOOL_QUERY_KEYS])
    )
    return F.coalesce(F.lower(C.trim_ws(search)), arguments)


def tool_usage(calls: DataFrame, repeat_at: int = 3) -> DataFrame:
    """Per run: calls, successes, distinct tools and repeated (tool, arguments) pairs."""
    per_args = calls.groupBy("run_id", "tool", normalised_args(F.col("arguments")).alias("args")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("success").cast("int")).alias("ok")
    )
    per_tool = per_args.groupBy("run_id", "tool").agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"),
        F.sum((F.col("n") >= repeat_at).cast("int")).alias("repeats"),
    )
    return per_tool.groupBy("run_id").agg(
        F.sum("n").alias("calls"), F.sum("ok").alias("successes"), F.count(F.lit(1)).alias("tools"),
        F.sum("repeats").alias("repeats"),
    )
