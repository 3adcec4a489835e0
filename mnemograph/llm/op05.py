"""op5: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm import mixing

NAME = "op5_mix_sources"


def query(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
one AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM one),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM leveled),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS take,
         coalesce(sum(size) OVER (PARTITION BY s.source
           ORDER BY ((doc_id % 2147483648) * {mixing.TIMES} + {mixing.PLUS}) % 2147483648, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, take) - start) + greatest(0, least(start + source_size + size, take) - start - source_size))::BIGINT AS taken
FROM placed
"""
