"""Reading and writing logs, manifests, chat updates and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C

MARKER = "LLM_CONTEXT_AUDIT"


def with_time(rows: DataFrame, column: str = "timestamp") -> DataFrame:
    """Add ``ts``, the instant (UTC) of an RFC 3339 string, null when unreadable."""
    return rows.withColumn("ts", F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp(column).cast("timestamp_ntz")))


def read_json_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a JSON Lines log; undecodable lines are kept apart."""
    schema = V.T.StructType(V.ENTRY_LOG.fields + [V.T.StructField("_bad", V.S)])
    lines = spark.read.text(path)
    parsed = lines.select(
        F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.col("value").alias("line")
    )
    bad = F.col("r._bad").isNotNull() | F.col("r.id").isNull()
    return parsed.filter(~bad).select("r.*").drop("_bad"), parsed.filter(bad).select("line")


def list_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    return nodes.filter(F.col("node_type") != "log").orderBy("id").limit(limit)


def export_manifest(entries: DataFrame, path: str) -> None:
    """All entries, oldest first, as JSON Lines with explicit nulls; ``_SUCCESS`` marks a complete export."""
    file_name = lambda c: F.nullif(F.regexp_extract(C.text_or_empty(F.col(c)), r"[^/]*$", 0), F.lit("")).alias(c.replace("_url", "_file"))
    have = lambda c: file_name(c) if c in entries.columns else F.lit(None).cast("string").alias(c.replace("_url", "_file"))
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    finer = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamp = F.when(F.col("ts") == F.date_trunc("second", "ts"), second).otherwise(finer)
    rows = entries.orderBy("ts", "id").select(
        F.col("id").alias("uuid"), "content", "source", stamp.alias("timestamp"), have("image_url"), have("audio_url"),
    )
    rows.write.option("ignoreNullFields", "false").json(path)


def manifest_rows(lines: DataFrame) -> DataFrame:
    """``lines(line, ...)`` with the fields of exported entries; the id is null where a line can't be decoded or has none."""
    schema = V.T.StructType(V.MANIFEST.fields + [V.T.StructField("_bad", V.S)])
    parsed = lines.withColumn("_r", F.from_json("line", schema, {"columnNameOfCorruptRecord": "_bad"}))
    rows = with_time(parsed.withColumn("timestamp", F.col("_r.timestamp")))
    return rows.select(
        *lines.columns, F.when(F.col("_r._bad").isNull(), F.col("_r.uuid")).alias("id"), "_r.content", "_r.source", "ts",
        F.coalesce("_r.image_file", F.lit("")).alias("image_url"), F.coalesce("_r.audio_file", F.lit("")).alias("audio_url"),
    )


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows ready to append, rejected lines) of an exported manifest."""
    rows = manifest_rows(spark.read.text(path).withColumnRenamed("value", "line"))
    return rows.filter(F.col("id").isNotNull()).drop("line"), rows.filter(F.col("id").isNull()).select("line")


def normalise_updates(updates: DataFrame, raw: str = "raw") -> DataFrame:
    """Flat messages of raw chat updates (JSON text); updates without a message are dropped."""
    u = F.from_json(raw, V.CHAT_UPDATE)
    rows = updates.select(u.alias("u")).select("u.update_id", F.coalesce("u.message", "u.edited_message").alias("m"))
    rows = rows.filter(F.col("m").isNotNull())
    image = C.text_or_empty(F.try_element_at("m.photo", F.lit(-1))["file_id"])
    voice = C.text_or_empty(F.col("m.voice.file_id"))
    place = F.col("m.location").isNotNull()
    empty = lambda c: F.nullif(c, F.lit(""))
    text = F.coalesce(
        empty(F.col("m.text")), empty(F.col("m.caption")), F.when(F.size("m.photo") > 0, "Photo"),
        F.when(voice != "", "Voice note"), F.when(place, "Shared location pin"), F.lit(""),
    )
    return rows.select(
        "update_id", "m.message_id", F.col("m.chat.id").alias("chat_id"),
        F.coalesce("m.from.id", F.lit(0)).alias("user_id"), text.alias("text"), image.alias("image_file_id"),
        voice.alias("voice_file_id"), place.alias("has_location"),
        F.coalesce("m.location.latitude", F.lit(0.0)).alias("lat"),
        F.coalesce("m.location.longitude", F.lit(0.0)).alias("lng"),
    )


def log_rows(lines: DataFrame) -> DataFrame:
    """(ts, level, msg, event, trace_id, path, text, rejected) of ``lines(value)`` of a structured log in JSON.

    A line that can't be decoded or has no readable time is kept whole in ``rejected``, the rest of its row is null.
    """
    parsed = with_time(
        lines.select("value", F.from_json("value", V.LOG_LINE, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).withColumn("timestamp", F.col("r.timestamp"))
    )
    good = F.col("r._bad").isNull() & F.col("ts").isNotNull()
    pick = lambda name, *fields: F.when(good, F.coalesce(*[F.nullif(F.col(f"r.{f}"), F.lit("")) for f in fields])).alias(name)
    return parsed.select(
        F.when(good, F.col("ts")).alias("ts"), pick("level", "jsonPayload.level", "jsonPayload.severity"), pick("msg", "jsonPayload.msg", "jsonPayload.message"),
        *[pick(f, f"jsonPayload.{f}") for f in ("event", "trace_id", "path")], pick("text", "textPayload"), F.when(~good, F.col("value")).alias("rejected"),
    )


def audit_hit(start: str | None, end: str | None, marker: str, text: bool = True) -> Column:
    """A log row speaks of the marker and lies in the half-open time window; a bound that is None is open."""
    hit = F.contains(C.text_or_empty(F.col("msg")), F.lit(marker)) | (C.text_or_empty(F.col("event")) == marker)
    if text:
        hit = hit | F.contains(C.text_or_empty(F.col("text")), F.lit(marker))
    if start is not None:
        hit = hit & (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return hit if end is None else hit & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def audit_line(text: bool = True) -> Column:
    """One line of a log row; a plain text of more than 400 characters shows its first 200."""
    line = F.concat(
        F.lit("["), F.coalesce("level", F.lit("INFO")), F.lit("] "),
        F.coalesce(F.nullif("msg", F.lit("")), F.concat(F.lit("event="), "event")),
        F.coalesce(F.concat(F.lit(" trace_id="), "trace_id"), F.lit("")),
        F.coalesce(F.concat(F.lit(" path="), "path"), F.lit("")),
    )
    if not text:
        return line
    short = F.when(F.length("text") > 400, F.concat(F.lit("[long] "), F.left("text", F.lit(200)), F.lit("..."))).otherwise(F.col("text"))
    return F.coalesce(line, short)


def audit_lines(logs: DataFrame, start: str, end: str, marker: str = MARKER) -> DataFrame:
    """Audit lines of a structured log (ts, level, msg, event, trace_id, path) in a time window."""
    rows = logs.filter(audit_hit(start, end, marker, text=False))
    return rows.select("ts", audit_line(text=False).alias("line")).orderBy("ts", "line")
