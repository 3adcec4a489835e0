"""Exported manifests replayed, and a structured log followed, as streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemograph.operators import merge
from mnemograph.session import stage
from mnemograph.sources import logs
from mnemograph.sources.versioned import Versioned
from mnemograph.streaming.jobs import run_batches


def read_lines(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of (value, file) over the text files of a folder (or glob), oldest files first."""
    reader = spark.readStream
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.text(folder).select("value", F.col("_metadata.file_path").alias("file"))


class ReplayJob:
    """Lines of exported manifests into a table of entries; what can't be taken goes to a table of rejects.

    Every entry is taken once: an id that is stored already is passed over, and of several good lines of one
    batch with one id the first counts, by file and then by text. A line is rejected, with its file and the reason,
    if it can't be decoded or has no id, content or source; blank lines are skipped. An entry without a readable time gets ``as_of``.

    ``then(entries, batch_id)`` gets the new entries of a batch before they are published, for instance to hand them
    to an ingest job. After a failure a batch comes again under its number with the same new entries.
    Entries and rejects have one part a batch: a batch writes its new rows only, and of the entries before it reads the ids. Its
    lines are moved once, to those of the same id, and decoded again where they are needed.
    """

    ENTRIES = "id string, node_type string, content string, source string, ts timestamp_ntz, weight double, image_url string, audio_url string, batch int"
    REJECTS = "file string, line string, reason string, batch int"

    def __init__(self, spark: SparkSession, root: str, as_of: Column, then: Callable[[DataFrame, int], None] | None = None):
        self.root, self.as_of, self.then = root, as_of, then
        self.entries = Versioned(spark, f"{root}/entries", self.ENTRIES, "batch")
        self.rejected = Versioned(spark, f"{root}/rejects", self.REJECTS, "batch")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        lines = batch.filter(F.col("value").rlike(r"\S")).withColumnRenamed("value", "line")
        reason = F.when(F.col("id").isNull(), "not decodable").otherwise(merge.append_error())
        parsed = logs.manifest_rows(lines).withColumn("reason", reason)
        first = parsed.filter("reason is null").groupBy("id").agg(F.min(F.struct("file", "line")).alias("r"))
        held = self.entries.read(before=batch_id).select("id")
        rows = logs.manifest_rows(first.join(held, "id", "left_anti").select("r.line")).drop("line")
        new, _ = merge.append_entries(rows, self.as_of)
        if self.then:
            new = stage(new, "new")
            self.then(new, batch_id)
        numbered = F.lit(batch_id).alias("batch")
        self.rejected.publish(parsed.filter("reason is not null").select("file", "line", "reason", numbered), batch_id, dealt=False)
        self.entries.publish(new.select("*", numbered), batch_id, dealt=False)

    def run(self, lines: DataFrame) -> None:
        run_batches(lines, self.root, self.handle)


def follow_log(lines: DataFrame, root: str, start: str | None = None, end: str | None = None, marker: str = logs.MARKER) -> DataFrame:
    """Audit lines (ts, line, rejected) of all log files that arrived so far under a stream of (value, file).

    A line that can't be decoded is kept in ``rejected`` alone, whatever the time window. A new call on the same root
    adds what arrived since; the sink's own log holds every file once.
    """
    spark = lines.sparkSession
    rows = logs.log_rows(lines)
    found = rows.filter(F.col("rejected").isNotNull() | logs.audit_hit(start, end, marker))
    out = found.select("ts", F.when(F.col("rejected").isNull(), logs.audit_line()).alias("line"), "rejected")
    state = {"path": f"{root}/lines", "checkpointLocation": f"{root}/checkpoint"}
    out.writeStream.format("parquet").options(**state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(state["path"])
