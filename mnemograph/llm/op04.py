"""op4: all conversations without quotes, in reply order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm.quotes import by_reply

NAME = "op4_quotation_links"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return by_reply(spark.read.parquet(f"{folder}/conversations.parquet"))


_NORMAL = r"translate(trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
SQL = rf"""
WITH RECURSIVE numbered AS (SELECT *, row_number() OVER () AS row_no FROM conversations),
lines AS (
  SELECT row_no, conv_id, turn, role, unnest(range(len(l))) AS i, unnest(l) AS line
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM numbered)),
marked AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '{_MARKS}', 1), '[^>]', '', 'g')) AS level FROM lines),
told AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY row_no ORDER BY i), 0) AS next_level FROM marked),
own AS (
  SELECT row_no, conv_id, turn, role, count(*) FILTER (level > 0) AS n_quoted,
         regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (
           level = 0 AND NOT (next_level > 0 AND regexp_matches(line, '(wrote|schrieb|écrit|escribió) ?:[ \t\r]*$'))), ''),
           '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS own
  FROM told GROUP BY ALL),
said AS (
  SELECT conv_id, {_NORMAL("part")} AS unit, min(turn) AS first_turn
  FROM (SELECT conv_id, turn, unnest(list_concat([own], regexp_split_to_array(own, '\n[ \t\r]*\n'), string_split(own, chr(10)))) AS part FROM own)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
quoted AS (
  SELECT conv_id, turn, row_no, level, i, {_NORMAL(f"regexp_replace(line, '{_MARKS}', '')")} AS unit,
         i - row_number() OVER (PARTITION BY row_no, level ORDER BY i) AS run
  FROM marked WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
units AS (
  SELECT DISTINCT conv_id, turn, level, text_no, i, unit FROM (
    SELECT conv_id, turn, level, q.row_no, i, unit, hash(text) AS text_no FROM quoted q JOIN numbered n USING (row_no, conv_id, turn)
    UNION ALL
    SELECT conv_id, turn, level, row_no, -1 - min(i), {_NORMAL("string_agg(unit, ' ' ORDER BY i)")}, any_value(hash(text))
    FROM quoted q JOIN numbered n USING (row_no, conv_id, turn) GROUP BY conv_id, turn, level, row_no, run)
  WHERE unit <> ''),
votes AS (
  SELECT u.conv_id, u.turn, level, first_turn, sum(len(string_split(unit, ' '))) AS words
  FROM units u JOIN said s USING (conv_id, unit) WHERE first_turn < u.turn GROUP BY ALL),
replies AS (
  SELECT conv_id, turn, first_turn AS reply_to FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, words DESC, first_turn DESC) = 1),
chain AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM replies
  UNION ALL
  SELECT c.conv_id, c.turn, r.reply_to, depth + 1 FROM chain c JOIN replies r ON c.conv_id = r.conv_id AND c.thread = r.turn),
top AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM chain GROUP BY ALL)
SELECT o.conv_id, o.turn, role, own, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || own || chr(10) || '<|end|>' AS formatted,
       n_quoted, reply_to, coalesce(thread, o.turn) AS thread, coalesce(depth, 0) AS depth
FROM own o LEFT JOIN replies r ON o.conv_id = r.conv_id AND o.turn = r.turn LEFT JOIN top t ON o.conv_id = t.conv_id AND o.turn = t.turn
"""
