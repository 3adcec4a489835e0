"""op9: the licence of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm import licences

NAME = "op9_licence_scan"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(spark.read.parquet(f"{folder}/pages.parquet"))


_IDF, _OTHER, _ROWS = licences.weights(licences.TEMPLATES)
_ANCHORS = "(?:^|[^a-z0-9])(?:" + "|".join(t.replace(".", r"\.") for t in licences.anchors(_ROWS, licences.LEAST)) + ")(?:$|[^a-z0-9])"
_HOST = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
SQL = rf"""
WITH idf(term, idf) AS (VALUES {", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in sorted(_IDF.items()))}),
template(template, licence, term, weight) AS (VALUES {", ".join(f"({i}, '{k}', '{t}', {w!r}::DOUBLE)" for i, k, t, w in _ROWS)}),
named AS (
  SELECT page_id, {_LOWER(_HOST)} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, coalesce(html, '') AS html FROM pages),
blocks AS (
  SELECT page_id, path, block FROM (
    SELECT page_id, path, unnest(regexp_split_to_array(regexp_replace(html, '(?i)</?(?:a|abbr|b|code|em|font|i|small|span|strong|u)\b[^>]*>', '', 'g'), '<[^>]*>|\n')) AS block
    FROM named
    UNION ALL
    SELECT page_id, path, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM named
    WHERE regexp_matches(path, '(?i)/(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$'))
  WHERE regexp_matches(block, '(?i){_ANCHORS}')),
terms AS (
  SELECT block, term, count(*) AS n
  FROM (SELECT block, unnest(regexp_extract_all({_LOWER("block")}, '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM (SELECT DISTINCT block FROM blocks)) GROUP BY ALL),
weighed AS (SELECT block, term, n * coalesce(idf, {_OTHER!r}::DOUBLE) AS w FROM terms LEFT JOIN idf USING (term)),
lengths AS (SELECT block, sqrt(sum(w * w)) AS length FROM weighed GROUP BY block),
scored AS (
  SELECT block, licence, round(sum(w * weight) / any_value(length), 6) AS score
  FROM weighed JOIN template USING (term) JOIN lengths USING (block) GROUP BY block, template, licence),
own AS (
  SELECT page_id, path, score, licence FROM blocks JOIN scored USING (block) WHERE score >= {licences.LEAST}
  QUALIFY row_number() OVER (PARTITION BY page_id, path ORDER BY score DESC, licence DESC) = 1),
mine AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, licence DESC) = 1),
files AS (
  SELECT regexp_replace(path, '[^/]*$', '') AS directory, score, licence FROM own
  WHERE regexp_matches(path, '(?i)/(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, licence DESC) = 1),
near AS (
  SELECT n.page_id, n.path, directory, score, licence
  FROM named n JOIN files f ON starts_with(n.path, f.directory) WHERE NOT starts_with(n.path, '/')
  QUALIFY row_number() OVER (PARTITION BY n.page_id, n.path ORDER BY length(directory) DESC) = 1)
SELECT n.page_id, n.path, coalesce(m.licence, r.licence) AS licence, coalesce(m.score, r.score) AS score,
       CASE WHEN m.licence IS NOT NULL THEN 'text' WHEN r.licence IS NOT NULL THEN 'directory' END AS found,
       CASE WHEN m.licence IS NULL THEN r.directory END AS directory
FROM named n LEFT JOIN mine m USING (page_id) LEFT JOIN near r ON n.page_id = r.page_id AND n.path = r.path
"""
