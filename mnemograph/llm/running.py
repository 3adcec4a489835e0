"""Running sums that don't gather a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, key: str, chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of its ``key`` as column ``name``.

    Rows are ordered by ``chunk``, then by ``order``. Sums of the chunks are made before the
    shuffle, running totals over one row a chunk, and only a chunk's rows meet in a task:
    a key with a third of all rows is as many tasks as it has chunks. ``key`` isn't null.
    """
    df = df.withColumns({"_chunk": chunk, "_value": value})
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_at")).agg(F.sum("_value").alias("_sum"))
    sums = sums.select("_key", "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_at")))
    total = F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return joined.withColumn(name, total).drop("_key", "_at", "_before", "_chunk", "_value")
