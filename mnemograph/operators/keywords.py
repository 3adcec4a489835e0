"""Keyword search of many queries at once.

A row matches a query when every keyword is a substring of its text. Keywords hold
no white space, so a keyword lies inside one white-space token of the text; both
ways below rest on that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mnemograph.operators.skew import top_rows
from mnemograph.session import stage

BROADCAST_SETS = 2_000
NEWEST = 512  # rows of the first round; each further round takes eight times as many
BROADCAST_BYTES = 16 << 20
HIT = "set_key string, id string, ts string"
_SEP = "\x1f"


def words_of(text: Column) -> Column:
    """Lower-cased distinct white-space separated words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def contains_all(texts: list[Column], keywords: str) -> Column:
    """Every word of ``keywords`` occurs in at least one of ``texts`` (lower-cased)."""
    out = F.lit(True)
    for word in keywords.lower().split():
        hit = F.lit(False)
        for text in texts:
            hit = hit | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(word))
        out = out & hit
    return out


def set_key(text: Column) -> Column:
    """The distinct words of a text as one key, whatever their order."""
    return F.array_join(F.array_sort(words_of(text)), _SEP)


def search_many(queries: DataFrame, docs: DataFrame, k: int, broadcast_sets: int = BROADCAST_SETS) -> DataFrame:
    """Newest ``k`` of ``docs(id, ts, text)`` per row of ``queries(qid, words)``.

    Queries with the same words share one search. Returns (qid, id, rank), ranked by
    (ts desc, id). Queries without words match nothing.
    """
    keyed = queries.filter(F.size("words") > 0).select(
        "qid", F.array_join(F.array_sort("words"), _SEP).alias("set_key")
    )
    sets = keyed.select("set_key").distinct()
    docs = docs.select("id", F.col("ts").cast("string").alias("ts"), F.lower("text").alias("text"))
    n, size = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("set_key")), F.lit(0))).first()
    if n <= broadcast_sets and size <= BROADCAST_BYTES:
        hits = _scan_with_sets([r[0] for r in sets.collect()], docs, k)
    else:
        hits = _newest_first(sets, docs, k)
    best = top_rows(hits, ["set_key"], [F.desc("ts"), F.asc("id")], k)
    return keyed.join(best, "set_key").select("qid", "id", "rank")


def _newest_first(sets: DataFrame, docs: DataFrame, k: int, newest: int = NEWEST) -> DataFrame:
    """(set_key, id, ts) with the newest ``k`` of ``docs(id, ts, text)`` for each of ``sets(set_key)``.

    Rounds go back in time, each over more rows. A set that has ``k`` rows is done, so sets of
    common words, which most rows hold, end in the first rounds, and those left over find few rows in a round.
    """
    docs, left = stage(docs, "haystack"), stage(sets, "sets")
    n, shares = docs.count(), []
    while newest < n:
        shares.append(1.0 - newest / n)
        newest += 8 * newest
    cuts = docs.agg(F.percentile_approx(F.col("ts").cast("timestamp_ntz"), shares, 1000).cast("array<string>")).first()[0] if shares else []
    found, upper = [], None
    for cut in [*dict.fromkeys(cuts or []), None]:
        part = docs if upper is None else docs.filter(F.col("ts").isNull() | (F.col("ts") < upper))
        part = part if cut is None else part.filter(F.col("ts") >= cut)
        hits = rows_with_words(left, part).join(part.select("id", "ts"), "id").select("set_key", "id", "ts")
        best = top_rows(hits, ["set_key"], [F.desc("ts"), F.asc("id")], k).drop("rank")
        held = stage(best if not found else found[-1].unionByName(best), "newest")
        found.append(held)
        done = held.groupBy("set_key").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("set_key")
        left, upper = stage(left.join(done, "set_key", "left_anti"), "sets"), cut
        if left.isEmpty():
            break
    return found[-1]


def _finder(words: list[str]):
    """Function text -> set of word numbers found in it."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {i for i, w in enumerate(words) if w in text}
    automaton = ahocorasick.Automaton()
    for i, word in enumerate(words):
        automaton.add_word(word, i)
    automaton.make_automaton()
    return lambda text: {i for _, i in automaton.iter(text)}


def _scan_with_sets(keys: list[str], docs: DataFrame, k: int) -> DataFrame:
    """Word sets are few (checked by the caller): one pass over the text, top-k kept per task."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        set_keys = shared.value
        if not set_keys:
            return
        members = [key.split(_SEP) for key in set_keys]
        words = sorted({w for m in members for w in m})
        number = {w: i for i, w in enumerate(words)}
        # each set is filed under one of its words; the others are checked on a hit
        filed: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for s, m in enumerate(members):
            nums = frozenset(number[w] for w in m)
            filed.setdefault(number[max(m, key=len)], []).append((s, nums))
        find = _finder(words)
        held = pd.DataFrame({"s": [], "id": [], "ts": []})
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "id"], ascending=[False, True])
            seen = [0] * len(set_keys)
            rows = []
            for doc_id, ts, text in zip(pdf["id"], pdf["ts"], pdf["text"]):
                if not text:
                    continue
                found = find(text)
                for word in found:
                    for s, nums in filed.get(word, ()):
                        if seen[s] < k and nums <= found:
                            seen[s] += 1
                            rows.append((s, doc_id, ts))
            held = pd.concat([held, pd.DataFrame(rows, columns=["s", "id", "ts"])], ignore_index=True)
            held = held.sort_values(["s", "ts", "id"], ascending=[True, False, True])
            held = held.groupby("s", sort=False).head(k)
        if len(held):
            names = [set_keys[int(s)] for s in held["s"]]
            yield pd.DataFrame({"set_key": names, "id": held["id"], "ts": held["ts"]})

    return docs.mapInPandas(scan, HIT)


def rows_with_words(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_key, id) of all ``docs(id, text)`` that hold every word of a set, for any number of ``sets(set_key)``.

    Words are matched against the distinct tokens of the texts and joined back.

    Token and word meet on a gram of up to three characters, so no pair is formed
    that does not at least share it. Each set is started from its rarest word and
    the other words are checked on those rows only.
    """
    members = sets.select("set_key", F.explode(F.split("set_key", _SEP)).alias("word"))
    words = members.select("word").distinct()
    postings = docs.select(
        "id", F.explode(F.array_distinct(F.filter(F.split("text", r"\s+"), lambda t: t != ""))).alias("token")
    )
    token = F.col("token")
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(token)),
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(token, i, n)
                ),
            )
        )
    )
    vocabulary = postings.select("token").distinct().withColumn("gram", F.explode(grams))
    anchored = words.withColumn("gram", F.substring("word", 1, 3))
    pairs = (
        vocabulary.join(anchored, "gram")
        .filter(F.contains(F.col("token"), F.col("word")))
        .select("token", "word")
        .distinct()
    )
    hits = stage(postings.join(pairs, "token").select("id", "word").distinct(), "word-hits")
    frequency = hits.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        members.join(frequency, "word", "left")
        .groupBy("set_key")
        .agg(
            F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("word"),
            F.count(F.lit(1)).alias("size"),
        )
    )
    started = rarest.join(hits, "word").select("set_key", "size", "id")
    others = members.join(rarest.select("set_key", "word"), ["set_key", "word"], "left_anti")
    # one other word is a plain join; only sets of three words and more are counted
    met = started.filter("size > 1").join(others, "set_key").join(hits, ["word", "id"])
    counted = met.filter("size > 2").groupBy("set_key", "id", "size").agg(F.count(F.lit(1)).alias("found")).filter("found = size - 1")
    whole = started.filter("size = 1"), met.filter("size = 2"), counted
    return whole[0].select("set_key", "id").unionByName(whole[1].select("set_key", "id")).unionByName(whole[2].select("set_key", "id"))
