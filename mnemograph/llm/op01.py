"""op1: a verdict for the URL of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm.globs import Rule, judge

NAME = "op1_url_filter"
RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]
BLOCKED = ["*.cheap-pills.**", "*.spam-*.**", "*.casino*.**", "**/wp-login.php", "*.xn--*.**", "*.?.?.**"]


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, BLOCKED).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')"
SQL = rf"""
WITH parts AS (
  SELECT page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches('.' || host || path, '(?s)^[^/]*\.(cheap-pills|spam-[^/]*|casino[^/]*|xn--[^/]*|[^/]\.[^/])\..*$|/wp-login\.php$')
                THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting USING (page_id)
"""
