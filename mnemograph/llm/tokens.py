"""Exact token counts; huge documents are encoded in overlapping chunks that are resynchronised.

The tokenizer merges neighbouring pieces by the rank of what they form. A sequence of pieces
is what it makes of their text exactly when it makes each two neighbours of theirs, and
neighbours inside an encoded chunk are such. So where two chunks that overlap have the same
piece at the same place, the pieces of the first before it and of the second from it on are
the pieces of the whole: the first chunk holds the pair at the seam. Where they share no
piece, the overlap is widened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.scratch import Scratch
from mnemograph.llm.words import slices

CHUNK, OVERLAP = 1 << 15, 256
SIDE = "array<struct<place: long, piece: long, before: long>>"
ENCODED = f"text_id string, chunk long, n long, head {SIDE}, tail {SIDE}"


def _count(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.append(0, np.cumsum(batch.column("n_bytes").to_numpy()))
            counts: list[int] = []
            for a, b in slices(sizes):
                part = texts.slice(a, b - a).to_pylist()
                counts += [len(x) for x in tokenizer.encode([t or "" for t in part], num_threads=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def pieces_of(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte at which each piece begins, piece ids). Pieces for the bytes of one character share its first byte."""
    found = tokenizer.encode(text, return_type="proto").pieces
    return np.array([p.begin for p in found], np.int64), np.array([p.id for p in found], np.int64)


def _whole_starts(at: np.ndarray) -> np.ndarray:
    """Pieces with a place of their own: none of the pieces of a character written in bytes."""
    own = np.ones(len(at), bool)
    own[1:] &= at[1:] != at[:-1]
    own[:-1] &= at[1:] != at[:-1]
    return own


def chunks(data: bytes, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(number, first byte, text) of the chunks of UTF-8 bytes; neighbours share about ``2 * overlap`` bytes."""
    for k, seam in enumerate(range(0, len(data), chunk)):
        begin, end = max(0, seam - overlap), min(len(data), seam + chunk + overlap)
        while begin and data[begin] & 0xC0 == 0x80:
            begin -= 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield k, begin, data[begin:end].decode()


def sides(tokenizer, k: int, begin: int, text: str, chunk: int, overlap: int, last: bool) -> tuple[int, list | None, list | None]:
    """(pieces of a chunk, those around its first seam, those around its last): (place, piece, pieces before)."""
    at, piece = pieces_of(tokenizer, text)
    own, at = _whole_starts(at), at + begin
    own[:1] = False  # the first piece carries the mark of a text's start

    def around(seam: int) -> list[tuple[int, int, int]]:
        near = np.flatnonzero(own & (at > seam - overlap) & (at < seam + overlap))
        return list(zip(at[near].tolist(), piece[near].tolist(), near.tolist(), strict=True))

    return len(at), around(k * chunk) if k else None, None if last else around((k + 1) * chunk)


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("text_id").to_pylist(), batch.column("text"), strict=True):
                whole = text.as_py().encode()
                n = -(-len(whole) // chunk)
                for k, begin, part in chunks(whole, chunk, overlap):
                    yield pa.RecordBatch.from_pylist([{"text_id": name, "chunk": k, "begin": begin, "last": k + 1 >= n, "part": part}])

    return run


def _encode(model: str, chunk: int, overlap: int):
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("place", "piece", "before")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            rows = batch.select(["chunk", "begin", "last"]).to_pylist()
            found = [
                sides(tokenizer, r["chunk"], r["begin"], part.as_py(), chunk, overlap, r["last"])
                for r, part in zip(rows, batch.column("part"), strict=True)
            ]
            near = [
                pa.array([None if f[i] is None else [dict(zip(("place", "piece", "before"), x, strict=True)) for x in f[i]] for f in found], kind)
                for i in (1, 2)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), batch.column("chunk"), pa.array([f[0] for f in found], pa.int64()), *near],
                names=["text_id", "chunk", "n", "head", "tail"],
            )

    return run


def _huge(texts: DataFrame, model: str, chunk: int, overlap: int, scratch: Scratch) -> DataFrame:
    """(text_id, n_tokens) of distinct huge texts (text_id, text)."""
    done: list[DataFrame] = []
    while True:
        parts = texts.mapInArrow(_cut(chunk, overlap), "text_id string, chunk long, begin long, last boolean, part string")
        parts = parts.repartition("text_id", "chunk").mapInArrow(_encode(model, chunk, overlap), ENCODED)
        parts = scratch.keep(parts, "chunks")
        right = parts.select("text_id", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next"))
        seams = parts.where("tail is not null").join(right, ["text_id", "chunk"])
        shared = F.array_intersect(F.expr("transform(tail, x -> struct(x.place, x.piece))"), F.expr("transform(next, x -> struct(x.place, x.piece))"))
        seams = seams.withColumn("shared", F.get(shared, F.lit(0))).select(
            "text_id", "n",
            F.expr("get(filter(tail, x -> x.place = shared.place), 0).before").alias("upto"),
            F.expr("get(filter(next, x -> x.place = shared.place), 0).before").alias("since"),
        )
        spliced = seams.groupBy("text_id").agg(
            F.sum(F.col("n") - F.col("upto") + F.col("since")).alias("twice"), F.max(F.col("upto").isNull()).alias("apart")
        )
        counted = parts.groupBy("text_id").agg(F.sum("n").alias("n")).join(spliced, "text_id", "left").select(
            "text_id", (F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"), F.coalesce("apart", F.lit(False)).alias("apart")
        )
        counted = scratch.keep(counted, "counted")
        done.append(counted.where("not apart").select("text_id", "n_tokens"))
        apart = counted.where("apart").select("text_id")
        if apart.isEmpty():
            break
        texts = texts.join(apart, "text_id", "left_semi")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def count_tokens(docs: DataFrame, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text of ``docs`` (doc_id, text).

    Texts of up to ``chunk`` bytes are encoded as they are, where they are read. Each
    distinct longer text is cut into chunks, which are spread over the tasks and spliced; texts
    with a seam that shares no piece come again with a fourfold overlap, at last as one chunk.
    No mark of begin or end is counted, and text that looks like one is text. A null text is
    empty and has no tokens; repeated rows, nulls in doc_id and very long texts are rows like
    others. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    long = F.coalesce(F.col("n_bytes") > chunk, F.lit(False))
    short = docs.where(~long).mapInArrow(_count(model), "doc_id long, n_bytes long, n_tokens long")
    huge = docs.where(long).withColumn("text_id", F.md5("text"))
    texts = scratch.keep(huge.select("text_id", "text").dropDuplicates(["text_id"]), "huge")
    counted = huge.select("doc_id", "n_bytes", "text_id").join(_huge(texts, model, chunk, overlap, scratch), "text_id")
    return short.union(counted.select("doc_id", "n_bytes", "n_tokens"))
