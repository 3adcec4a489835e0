"""Media files of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AT_MOST_PATHS = 10_000


def list_media(spark: SparkSession, folder: str, pattern: str, glob: str | None = None) -> DataFrame:
    """(id, path, size) of the files below a folder, contents unread; the id is the first group of ``pattern`` in the path.

    Files whose path does not fit are left out, and empty ones, which Spark's scan skips; of several with one id the newest counts, then the one of greatest path.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    named = files.select(F.regexp_extract("path", pattern, 1).alias("id"), "path", F.col("length").alias("size"), "modificationTime").filter("id <> ''")
    newest = F.max_by(F.struct("path", "size"), F.struct("modificationTime", "path"))
    return named.groupBy("id").agg(newest.alias("f")).select("id", "f.path", "f.size")


def read_media(wanted: DataFrame, files: DataFrame, folder: str, at_most: int = AT_MOST_PATHS) -> DataFrame:
    """(id, size, bytes) of each of ``wanted(id)`` among ``files`` of ``list_media``; both are null for an empty or missing file.

    Up to ``at_most`` wanted files (counted) are opened by path, so no other content is read. Beyond that the contents of the
    folder are read once and joined by path.
    """
    spark = wanted.sparkSession
    found = wanted.select("id").distinct().join(files, "id", "left")
    there = found.filter("path is not null").select("path").distinct()
    paths = [r.path for r in there.limit(at_most + 1).collect()]
    if not paths:
        return found.select("id", "size", F.lit(None).cast("binary").alias("bytes"))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    contents = reader.load(paths) if len(paths) <= at_most else reader.load(folder).join(there, "path", "left_semi")
    return found.join(contents.select("path", F.col("content").alias("bytes")), "path", "left").select("id", "size", "bytes")
