"""Best-fit packing of token pieces by exact-complement hashing.

What is packed is known from its lengths alone: a histogram of at most ``CAPACITY`` counts.
The plan made from it says how many sequences hold which lengths; every piece finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.running import running
from mnemograph.llm.scratch import Scratch
from mnemograph.llm.words import slices, text_bytes

CAPACITY = 2048
CHUNKS = 1024
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _complement(have: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """Up to ``most`` (three) lengths that fill ``gap`` and are in stock, the fewest and the largest first."""
    if gap <= 0:
        return None
    if have[gap] > 0:
        return (gap,)
    pair = _pair(have, gap, gap - 1) if most > 1 else None
    if pair or most < 3:
        return pair
    for top in np.flatnonzero(have[: gap - 1])[::-1].tolist():
        if 3 * top < gap:
            return None
        have[top] -= 1
        pair = _pair(have, gap - top, top)
        have[top] += 1
        if pair:
            return (top, *pair)
    return None


def _pair(have: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """The two lengths in stock that add up to ``total``, the larger at most ``most`` and as large as can be."""
    high = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
    fits = (have[high] > 0) & (have[total - high] > 0) & ((2 * high != total) | (have[high] > 1))
    at = int(fits.argmax()) if len(fits) else 0
    return (int(high[at]), total - int(high[at])) if len(fits) and fits[at] else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) for pieces of the given lengths.

    From the longest length down, a length takes the one, two or three lengths whose sum fills
    its gap exactly, as often at once as the stock allows. What finds no complement is packed
    best-fit decreasing, whole groups of equal sequences at a time. Pairs and triples can take
    the short pieces that other long ones need, so the plan is made with up to one, two and
    three, and the one with the fewest sequences counts. A step uses up a length or a group of
    gaps: the plan's size and time depend on ``capacity`` alone.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    done: list[tuple[tuple[int, ...], int]] = [((capacity,), int(have[capacity]))] if have[capacity] else []
    left = np.zeros(capacity + 1, np.int64)
    for length in range(capacity - 1, 0, -1):
        while have[length] > 0:
            have[length] -= 1
            rest = _complement(have, capacity - length, most)
            have[length] += 1
            if rest is None:
                left[length] = have[length]
                have[length] = 0
                break
            used = (length, *rest)
            times = min(int(have[x]) // used.count(x) for x in set(used))
            for x in used:
                have[x] -= times
            done.append((used, times))
    return done + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        n, gap = int(left[length]), length
        while n:
            while gap < capacity and not bins[gap]:
                gap += 1
            if gap >= capacity:
                each = capacity // length
                if n >= each:
                    bins[capacity - each * length].append(((length,) * each, n // each))
                n %= each
                if n:
                    bins[capacity - n * length].append(((length,) * n, 1))
                break
            held, times = bins[gap].pop()
            if times > n:
                bins[gap].append((held, times - n))
            now = min(times, n)
            bins[gap - length].append(((*held, length), now))
            n -= now
    return [group for groups in bins for group in groups]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the ids of each text and ``end_id``.

    Only a document longer than ``capacity`` is cut; all its pieces but the first have
    ``capacity`` ids. A null text is empty: one piece with ``end_id`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mnemograph.llm.segments import encoder

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in slices(offsets):
                ids, upto = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out = []
                for i in range(b - a):
                    own = np.append(ids[upto[i] : upto[i + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    edges = [0, *range(first, len(own) + 1, capacity)]
                    out += [(names[a + i], k, x, y - x, zlib.crc32(own[x:y].tobytes())) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False))]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and its offset there.

    Sequences hold at most ``capacity`` ids and have no gaps. The histogram of lengths, at most
    ``capacity`` rows, is all that reaches the driver; the plan that goes back has a number of
    entries bounded by ``capacity``. A length shared by a third of all pieces is ranked in
    ``CHUNKS`` tasks. Null texts are empty, a null doc_id is kept, repeated rows are packed as
    often as they occur; an empty table packs to nothing. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    place = _placer(plan(counts, capacity))
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = running(cut, "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(CHUNKS)), order, F.lit(1), "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(
        place, PIECE + ", sequence_id long, offset long"
    )


def _placer(planned: list[tuple[tuple[int, ...], int]]):
    """Where the rank-th piece of a length goes, by the plan."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in planned:
        at = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), base, at))
            used[x] = used.get(x, 0) + times
            at += x
        base += times
    tables = {x: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for x, rows in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for x in np.unique(length).tolist():
                mine = np.flatnonzero(length == x)
                first, start, at = tables[x]
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = start[k] + rank[mine] - first[k]
                offset[mine] = at[k]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return place
