"""op13: conversations, damaged by a hash, and their cheapest repair."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm.repair import repair
from mnemograph.llm.scratch import Scratch

NAME = "op13_conversation_repair"
#: SQL has no heaps; tested against a plain dynamic program and all edits of short conversations.
SQL = None


def damaged(messages: DataFrame) -> DataFrame:
    """By crc32(conv_id:turn) % 20: 0 gone, 1 without text, 2 without ``[.!?]``, 3 twice, 4 by the user."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    how = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(filled[3], "[.!?]", "")).otherwise(filled[3])
    role = F.when(how == 4, "user").otherwise(filled[2])
    rows = messages.withColumn("_times", F.when(how == 3, 2).otherwise(1)).where(how != 0)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("sequence(1, _times)")).alias("_time")).drop("_time")


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines joined by newlines.

    A chunk's lines become one cell. A hash goes through a conversation in order, so the
    cells of one conversation, sorted, stream through one task and are not held together.
    """
    line = F.struct("mid", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda m: m.line)
    cells = messages.groupBy("conv_id", "chunk").agg(F.array_join(lines, "\n").alias("lines"))
    kind = cells.schema["conv_id"].dataType.simpleString()

    def work(batches):
        held, state, typed = None, None, None
        for batch in batches:
            typed = batch.column(0).type
            done = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                data = text.as_py().encode()
                if state is not None and conv == held:
                    state.update(b"\n" + data)
                    continue
                if state is not None:
                    done.append((held, state.hexdigest()))
                held, state = conv, hashlib.sha256(data)
            if done:
                yield _hashed(done, typed)
        if state is not None:
            yield _hashed([(held, state.hexdigest())], typed)

    ordered = cells.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


def _hashed(pairs, kind):
    keys, values = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.string())], ["conv_id", "repaired_sha256"])


def query(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    scratch = Scratch(spark, "repair")
    found = repair(damaged(given), scratch)
    rows = given.select("conv_id").distinct()
    for more in (found.conversations, digests(found.messages)):
        more = more.withColumnRenamed("conv_id", "_conv")
        rows = rows.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
