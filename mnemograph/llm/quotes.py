"""Conversations ordered by reply, linked through what messages quote.

A line that starts with ``>`` is quoted, once for each ``>``. Consecutive lines of one level
make a passage. Normalised passages and their lines are hashed and joined to the messages of
the same conversation that said them first; the quoted message is what a message replies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemograph.llm.scratch import Scratch, only

BLANKS = r"[\x20\x09-\x0D]+"
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: The line with which mail programs introduce a quotation.
INTRO = r"(wrote|schrieb|écrit|escribió) ?:[ \t\r]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(text, BLANKS, " ")), UPPER, LOWER)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with own (the text without quotes) and n_quoted (its quoted lines)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    quoted = lambda x: F.coalesce(x.rlike(MARKS), F.lit(False))
    kept = F.transform(
        F.array("_lines"),
        lambda all_lines: F.filter(all_lines, lambda x, i: ~quoted(x) & ~(x.rlike(INTRO) & quoted(F.get(all_lines, i + 1)))),
    )[0]
    out = messages.withColumn("_lines", lines)
    own = F.regexp_replace(F.array_join(kept, "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return out.withColumns({"own": own, "n_quoted": F.size(F.filter("_lines", quoted)).cast("long")}).drop("_lines")


def _said(messages: DataFrame) -> DataFrame:
    """(conv_id, unit, first): the first turn whose own text is, or has as a paragraph or line, what ``unit`` hashes."""
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t\r]*\n"), F.split("own", "\n"))
    units = F.array_distinct(F.filter(F.transform(parts, _normal), lambda x: x != ""))
    return messages.select("conv_id", "turn", F.explode(units).alias("u")).groupBy("conv_id", F.xxhash64("u").alias("unit")).agg(F.min("turn").alias("first"))


def _quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, unit, words) of the passages and lines that messages quote."""
    lines = messages.select("conv_id", "turn", F.xxhash64("text").alias("m"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).distinct()
    lines = lines.withColumn("level", _level(F.col("line"))).where("level > 0")
    lines = lines.withColumn("line", _normal(F.regexp_replace("line", MARKS, "")))
    row = F.row_number().over(Window.partitionBy("conv_id", "turn", "m", "level").orderBy("i"))
    runs = lines.withColumn("run", F.col("i") - row)
    whole = runs.groupBy("conv_id", "turn", "m", "level", "run").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("all"))
    whole = whole.select("conv_id", "turn", "level", _normal(F.array_join(F.col("all.line"), " ")).alias("u"))
    units = whole.union(lines.select("conv_id", "turn", "level", F.col("line").alias("u"))).where("u <> ''")
    return units.select("conv_id", "turn", "level", F.xxhash64("u").alias("unit"), F.size(F.split("u", " ")).alias("words"))


def _threads(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of replies (conv_id, turn, reply_to): depths double each round."""
    now = scratch.keep(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        joined = now.join(above, ["conv_id", "thread"], "left")
        if joined.where("higher is not null").isEmpty():
            return now
        longer = joined.select(
            "conv_id", "turn", "reply_to", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        longer = scratch.keep(longer, "replies")
        scratch.drop(now)
        now = longer


def by_reply(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes, placed in the replies of their conversation.

    Returns, one row per input row: conv_id, turn, role, own (text without quoted lines and the
    lines that introduce them), formatted (role mark and own text), n_quoted, reply_to (the
    turn it replies to), thread (the first turn of its chain of replies) and depth (replies
    from there). Reply order is the order by conv_id, thread, depth, turn.

    The quoted message is the first of the conversation that said a quoted passage, paragraph or
    line in its own words, before the quoting turn. The outermost level with such a message
    decides; of several, the one with most quoted words, then the latest. Without one a message
    starts a thread of its own, so a conversation without quotes keeps its turns' order.

    A null text is empty and a null role is written ``unknown``; without conv_id or turn a row
    is linked with nothing, and its thread is its turn. Rows of one conv_id and turn are one
    message; each is returned. First turns are a partial minimum, so a line that a whole corpus
    or one huge conversation repeats is one row a task. Other columns are not read.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    messages = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    valid = messages.where("conv_id is not null and turn is not null")
    quoting = valid.where(F.col("text").rlike("(?m)" + MARKS))
    quotes = scratch.keep(_quotes(quoting), "quotes")
    said = _said(parsed(only(valid, "conv_id", quotes.select("conv_id"))))
    linked = quotes.join(said, ["conv_id", "unit"]).where("first < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "first").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "words", "first"))["first"].alias("reply_to"))
    threads = _threads(best, scratch)
    out = parsed(messages).join(threads, ["conv_id", "turn"], "left")
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>"))
    return out.select(
        "conv_id", "turn", "role", "own", mark.alias("formatted"), "n_quoted", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
