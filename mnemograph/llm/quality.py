"""Quality rules with limits that adapt to language and source.

Every metric of a document is an integer. A group (language, source) is described by one
quantile sketch a metric: counts in log-linear buckets (16 to each power of two, so a
quantile is at most 1/16 too low). Sketches merge by adding counts: the groups' sketches
give those of the languages and of the whole corpus without another pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Metric -> least spread assumed between its quartiles. Parts are in thousandths, word length in hundredths.
SPREADS = {"symbols": 8, "capitals": 20, "dup_lines": 60, "repeats": 50, "word_length": 50}
FENCE, LEAST_ROWS, PARENT_TIMES = 6, 100, 2


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, each word once."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(F.slice(p, 2, F.size(p)), lambda x, i: F.least(F.lit(WINDOW), x - F.get(p, i)))
        return F.aggregate(steps, F.lit(WINDOW), lambda a, b: a + b)

    return _let(_let(marked, repeated), total)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the base features and the metrics of its whole texts.

    A null text has no words. New columns replace columns of the same name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")

    def grams(words: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        return F.when(F.size(words) >= WINDOW, found).otherwise(F.array().cast("array<bigint>"))

    def repeats(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes)).cast("long")

    def base(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), count(BLANKS).alias("word_chars"), count(r"[^#*$%&|<>]+").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), _let(grams(words), repeats).alias("n_repeat_words"),
            count(r"[^\p{Lu}!]+").alias("_capitals"), F.size(lines).cast("long").alias("_n_lines"),
        )

    found = _let(F.array_remove(F.split(text, BLANKS), ""), lambda words: _let(lines, lambda rows: base(words, rows)))
    # a generator is computed once a row; filters on its fields don't go below it and repeat it
    out = docs.drop(*FEATURES, "base_failed").select("*", F.explode(F.array(found)).alias("_found")).select("*", "_found.*").drop("_found")
    part = lambda a, b, times: F.expr(f"{a} * {times} div greatest({b}, 1)").cast("long")
    out = out.withColumns(
        {
            "m_symbols": part("n_symbols", "word_chars", 1000), "m_capitals": part("_capitals", "word_chars", 1000),
            "m_dup_lines": part("n_dup_lines", "_n_lines", 1000), "m_repeats": part("n_repeat_words", "n_words", 1000),
            "m_word_length": part("word_chars", "n_words", 100),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    return out.drop("_n_lines", "_capitals")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the documents with 20 words or more."""
    pairs = ", ".join(f"'{m}', m_{m}" for m in SPREADS)
    long = measured.where("n_words >= 20").selectExpr("lang", "source", f"stack({len(SPREADS)}, {pairs}) as (metric, v)")
    low = F.when(F.col("v") < 32, F.col("v")).otherwise(F.expr("shiftleft(shiftright(v, length(bin(v)) - 5), length(bin(v)) - 5)"))
    return long.groupBy("lang", "source", "metric", low.alias("bucket")).agg(F.count("*").alias("n"))


def _limits(sketch: DataFrame, keys: list[str], robust: bool = False) -> DataFrame:
    """One row a group and metric: the group's rows, and the fences above and below its quartiles.

    ``robust`` fences stand around the median and take each side's spread from the other side: rows of
    junk on one side, if they are fewer than half of the group, neither move nor widen the fence there.
    """
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(of.orderBy("bucket"))).withColumn("total", F.sum("n").over(of))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}")
    quartiles = ranked.groupBy(*keys, "metric", F.col("total").alias("rows")).agg(at(1), at(2), at(3))
    least = F.create_map(*[x for m, s in SPREADS.items() for x in (F.lit(m), F.lit(s))])[F.col("metric")]
    q1, q2, q3 = (F.col(f"q{k}") for k in (1, 2, 3))
    if robust:
        high, low = q2 + FENCE * F.greatest(2 * (q2 - q1), least), q2 - FENCE * F.greatest(2 * (q3 - q2), least)
    else:
        spread = FENCE * F.greatest(q3 - q1, least)
        high, low = q3 + spread, q1 - spread
    return quartiles.select(*keys, "metric", "rows", high.alias("high"), low.alias("low"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Limits of every (lang, source).

    A group below ``LEAST_ROWS`` rows takes the limits of its language, a language below
    it those of the corpus. No group's upper limit exceeds ``PARENT_TIMES`` that of its language
    and none's lower limit is below that part of it. The limits of languages and corpus
    are robust: a source of junk holding less than half of its language doesn't excuse itself.
    """
    up = {"rows": "up_rows", "high": "up_high", "low": "up_low"}
    few = F.col("rows") < LEAST_ROWS
    lang = _limits(sketch, ["lang"], robust=True).join(_limits(sketch, [], robust=True).withColumnsRenamed(up), "metric").select(
        F.col("lang").alias("_lang"), F.col("metric").alias("_metric"), *(F.when(few, F.col(u)).otherwise(F.col(c)).alias(u) for c, u in list(up.items())[1:])
    )
    own = _limits(sketch, ["lang", "source"]).join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric")))
    own = own.withColumns({
        "high": F.when(few, F.col("up_high")).otherwise(F.least("high", PARENT_TIMES * F.col("up_high"))),
        "low": F.when(few, F.col("up_low")).otherwise(F.greatest("low", F.expr(f"up_low div {PARENT_TIMES}"))),
    })
    return own.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("metric") == m, F.col("high"))).alias(f"high_{m}") for m in SPREADS),
        F.max(F.when(F.col("metric") == "word_length", F.col("low"))).alias("low_word_length"),
    )


def decide(measured: DataFrame, limits: DataFrame, at_most: int = 100_000) -> DataFrame:
    """``measured`` with ``kept``: not base_failed and no metric beyond its group's limits.

    ``limits`` (one row a group) is counted, and travels to the rows up to ``at_most`` groups.
    """
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    limits = F.broadcast(limits) if limits.count() <= at_most else limits
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = F.col("m_word_length") < F.col("low_word_length")
    for m in SPREADS:
        beyond = beyond | (F.col(f"m_{m}") > F.col(f"high_{m}"))
    kept = ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))
    return joined.withColumn("kept", kept).drop("_lang", "_source", *(c for c in limits.columns if c.startswith(("high_", "low_"))))
