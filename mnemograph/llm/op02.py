"""op2: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm import quality
from mnemograph.llm.scratch import Scratch

NAME = "op2_quality_rules"


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = Scratch(spark, "quality").keep(quality.features(docs).drop("text"), "measured")
    judged = quality.decide(measured, quality.thresholds(quality.sketches(measured)))
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", *(f"m_{m}" for m in quality.SPREADS))


_SPREAD = " ".join(f"WHEN '{m}' THEN {s}" for m, s in quality.SPREADS.items())
_LOW = "CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END"


def _fences(keys: str, robust: bool = False) -> str:
    by = f"{keys}, " if keys else ""
    least = f"CASE metric {_SPREAD} END"
    if robust:
        high, low = f"q2 + {quality.FENCE} * greatest(2 * (q2 - q1), {least})", f"q2 - {quality.FENCE} * greatest(2 * (q3 - q2), {least})"
    else:
        high, low = f"q3 + {quality.FENCE} * greatest(q3 - q1, {least})", f"q1 - {quality.FENCE} * greatest(q3 - q1, {least})"
    return f"""
    SELECT {by}metric, total AS n_rows, {high} AS high, {low} AS low
    FROM (SELECT {by}metric, total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (2 * upto >= total) AS q2,
                 min(bucket) FILTER (4 * upto >= 3 * total) AS q3
          FROM (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS total
                FROM (SELECT {by}metric, bucket, count(*) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""


SQL = rf"""
WITH split AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM split),
grams AS (
  SELECT doc_id, i, gram FROM (
    SELECT doc_id, i, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS n
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8),
twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams),
covered AS MATERIALIZED (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 8) r(j) WHERE n > 1 GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{{Lu}}!]+', '', 'g')) AS capitals
  FROM split LEFT JOIN covered USING (doc_id)),
measured AS MATERIALIZED (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS m_symbols, capitals * 1000 // greatest(word_chars, 1) AS m_capitals,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS m_dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS m_repeats,
         word_chars * 100 // greatest(n_words, 1) AS m_word_length, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM base),
sketch AS MATERIALIZED (
  SELECT lang, source, metric, {_LOW} AS bucket
  FROM (SELECT lang, source, unnest([{", ".join(f"{{'metric': '{m}', 'v': m_{m}}}" for m in quality.SPREADS)}], recursive := true)
        FROM measured WHERE n_words >= 20)),
whole AS ({_fences("", robust=True)}),
by_lang AS (
  SELECT o.lang, o.metric, CASE WHEN o.n_rows < {quality.LEAST_ROWS} THEN w.high ELSE o.high END AS high,
         CASE WHEN o.n_rows < {quality.LEAST_ROWS} THEN w.low ELSE o.low END AS low
  FROM ({_fences("lang", robust=True)}) o JOIN whole w USING (metric)),
own AS (
  SELECT o.lang, o.source, o.metric, CASE WHEN o.n_rows < {quality.LEAST_ROWS} THEN l.high ELSE least(o.high, {quality.PARENT_TIMES} * l.high) END AS high,
         CASE WHEN o.n_rows < {quality.LEAST_ROWS} THEN l.low ELSE greatest(o.low, l.low // {quality.PARENT_TIMES}) END AS low
  FROM ({_fences("lang, source")}) o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric),
beyond AS (
  SELECT m.doc_id, bool_or(CASE o.metric {" ".join(f"WHEN '{m}' THEN m.m_{m} > o.high" for m in quality.SPREADS if m != "word_length")}
         ELSE m.m_word_length > o.high OR m.m_word_length < o.low END) AS out_of
  FROM measured m JOIN own o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(out_of, false) AS kept,
       {", ".join(f"m_{m}" for m in quality.SPREADS)}
FROM measured LEFT JOIN beyond USING (doc_id)
"""
