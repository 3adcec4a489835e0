"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Each 64-bit shingle hash falls
into one of ``BUCKETS`` buckets by its top bits; of the rest a bucket keeps the
smallest value, stored as the count of its leading zeros and ``MANTISSA`` bits after
the first one. Bands of registers give the candidates; a collision-corrected estimate
from all registers, then the full sets, decide. Documents of crowded bands are banded
again with more and longer bands, so that a large group of merely similar documents
doesn't make a candidate of each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.components import components
from mnemograph.llm.scratch import Scratch, only
from mnemograph.llm.words import lowered_words, mix, shingle_sets, slices, text_bytes

BUCKETS, BUCKET_BITS, MANTISSA = 256, 8, 10
FINE_BUCKETS = 5120
MISS = 1 / 20_000
CROWDED, BLOCK = 32, 1024
SET = "doc_id long, n_shingles long, set_a long, set_b long, registers binary, bands binary"
REST = 64 - BUCKET_BITS


def compressed(hashes: np.ndarray) -> np.ndarray:
    """16-bit codes of what hashes hold below the bucket bits: leading zeros and one, then ``MANTISSA`` bits."""
    rest = hashes & np.uint64((1 << REST) - 1)
    zeros = REST - np.frexp((rest >> np.uint64(REST - 53)).astype(np.float64))[1] - (REST - 53)
    ones = np.minimum(zeros, REST - MANTISSA - 1).astype(np.uint64)
    lead = ((rest << (ones + np.uint64(BUCKET_BITS))) >> np.uint64(REST - 1 - MANTISSA + BUCKET_BITS)) & np.uint64((1 << MANTISSA) - 1)
    return (((zeros.astype(np.uint64) + np.uint64(1)) << np.uint64(MANTISSA)) | lead).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sorted sets, one row of ``BUCKETS`` 16-bit codes each; 0 is an empty bucket."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bucket = (hashes >> np.uint64(REST)).astype(np.int64)
    cell = owner * BUCKETS + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # a set is sorted, so the smallest rest of a bucket comes first
    out = np.zeros(len(sets) * BUCKETS, np.uint16)
    out[cell[first]] = compressed(hashes[first])
    return out.reshape(len(sets), BUCKETS)


def filled(codes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Registers whose empty buckets hold what the first further round of hashing puts there; rows of empty sets stay empty.

    A round hashes the whole set afresh, so a register of two sets agrees with probability J
    however few elements they have, and registers don't repeat each other.
    """
    out, width = codes.copy(), codes.shape[1]
    for row, hashes in zip(out, sets, strict=True):
        done, some = 0, max(1, 4 * width // max(len(hashes), 1))
        while len(hashes) and not row.all():
            salts = mix(np.arange(done + 1, done + some + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            fresh = mix(hashes[None, :] ^ salts[:, None])
            bucket = (mix(fresh) % np.uint64(width)).astype(np.int64).ravel()
            value, round_ = (fresh & np.uint64((1 << REST) - 1)).ravel(), np.repeat(np.arange(some), len(hashes))
            free = np.flatnonzero(row[bucket] == 0)
            free = free[np.lexsort((value[free], round_[free]))[::-1]]
            row[bucket[free]] = compressed(value[free])  # of a bucket's values the last stays: first round, smallest
            done += some
    return out


def band_keys(codes: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` registers, taken in a fixed random order; a key knows its band.

    ``codes`` has no empty registers, so a band of two sets agrees with probability J ** rows.
    """
    order = np.random.default_rng(codes.shape[1]).permutation(codes.shape[1])
    bands = codes.shape[1] // rows
    spread = codes[:, order[: bands * rows]].reshape(len(codes), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1), spread.shape[:2])
    for i in range(rows):
        key = mix(key * np.uint64(3) + spread[:, :, i])
    return key.view(np.int64)


def band_rows(percent: int, width: int) -> int:
    """Rows of a band of ``width`` registers: the most that miss a pair at ``percent`` with a probability of ``MISS`` or less."""
    missed = lambda rows: (1 - (percent / 100) ** rows) ** (width // rows)
    return max((r for r in range(1, 65) if missed(r) <= MISS), default=1)


def fine_codes(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of ``FINE_BUCKETS`` buckets from hashes of their own; the sets aren't empty."""
    width = FINE_BUCKETS
    out = np.zeros((len(sets), width), np.uint16)
    for row, hashes in zip(out, sets, strict=True):
        fresh = np.sort(mix(hashes + np.uint64(0x5851F42D4C957F2D)) & np.uint64((1 << REST) - 1))[::-1]
        bucket = mix(fresh) % np.uint64(width)
        row[bucket.astype(np.int64)] = compressed(fresh)  # of a bucket's values the last, smallest stays
    return filled(out, sets)


@lru_cache(maxsize=4096)
def chance(log_a: int, log_b: int) -> float:
    """Expected part of the buckets in which two disjoint sets agree by chance.

    The sets have 2 ** (log / 4) elements. Summed over all register values: the
    probability that the smallest of a bucket's hashes falls on it in both sets.
    """
    at = np.arange(1 << MANTISSA) / (1 << MANTISSA)
    lows = np.concatenate([(1 + at) * 2.0 ** -(z + 1) for z in range(REST - MANTISSA)])
    highs = np.concatenate([(1 + at + 1 / (1 << MANTISSA)) * 2.0 ** -(z + 1) for z in range(REST - MANTISSA)])
    out = np.ones(len(lows))
    for log in (log_a, log_b):
        n = 2.0 ** (log / 4)
        out *= np.exp(-n * lows / BUCKETS) - np.exp(-n * highs / BUCKETS)
    return float(out.sum())


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected estimate, buckets used in it) for rows of two register tables."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    logs = [np.round(4 * np.log2(np.maximum(n, 1))).astype(int).tolist() for n in (n_a, n_b)]
    extra = np.array([chance(min(x), max(x)) for x in zip(*logs, strict=True)]) * BUCKETS
    part = np.minimum(extra / np.maximum(used, 1), 0.9)
    return np.maximum(same / np.maximum(used, 1) - part, 0) / (1 - part), used


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may be linked: their sizes allow it, and the estimate is at most five deviations too low."""
    found, used = jaccard(a, b, n_a, n_b)
    least = percent / 100
    near = found >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(used, 1))
    return near & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _sets(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, sets in _shingled(batches):
            sums = [np.array([mix(s + np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
            codes = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([k.tobytes() for k in band_keys(filled(codes, sets), rows)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "registers", "bands"],
            )

    return run


def _keyed(keys: np.ndarray, reps: pa.Array) -> pa.RecordBatch:
    owners = np.repeat(reps.to_numpy(), keys.shape[1]) if len(keys) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(owners)], names=["key", "rep"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        yield _keyed(keys.reshape(len(batch), -1) if len(batch) else keys, batch.column("rep"))


def _fine_bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, sets in _shingled(batches, 1 << 19):
            keys = band_keys(fine_codes(sets), rows)
            keyed = _keyed(keys, batch.column("doc_id").slice(a, b - a))
            yield keyed.append_column("component", _keyed(keys, batch.column("component").slice(a, b - a)).column("rep"))

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, a, b, sets in _shingled(batches):
        hashes = pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), hashes], names=["rep", "hashes"])


def _shingled(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets, limit):
            yield batch, a, b, shingle_sets(*lowered_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            near = likely(_codes(batch.column("reg_a")), _codes(batch.column("reg_b")), n_a, n_b, percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            sides = [text_bytes(batch.column(c)) for c in ("text_a", "text_b")]
            for a, b in slices(sides[0][1] + sides[1][1]):
                sets = [
                    shingle_sets(*lowered_words(d[o[a] : o[b]], o[a : b + 1] - o[a]), b - a) for d, o in sides
                ]
                keep[a:b] = [linked(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Classes of documents (doc_id, text) linked by shingle similarity.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their full
    shingle sets. Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable), kept (doc_id = component_id).

    Documents with equal sets meet in one representative by an aggregation. In each
    band bucket all members are compared with a hub, the document that shares most
    buckets with others; a group of copies costs as many rows as it has members. Where
    a bucket still holds several components, its members outside the hub's component
    are compared with all members of other components, so every candidate pair is
    compared or already connected. A bucket of more than ``CROWDED`` members leaves
    this to the finer bands of its members, in whose buckets members are compared
    where they meet and only links leave the task. Rows and bands follow ``percent`` (``band_rows``): bands of
    either kind miss a pair at the threshold with a probability of ``MISS`` or less if registers
    are independent. Empty registers are filled by hashing again, not from other registers.

    A null or blank text has an empty set and is linked with nothing. A null doc_id
    is linked with nothing; its component_id is null and it is kept. Repeated rows
    are returned as often as they occur; rows with one doc_id and different texts are
    one node. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "hyperminhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.keep(docs.mapInArrow(_sets(band_rows(percent, BUCKETS)), SET), "sets")
    alike = scratch.keep(
        sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")),
        "alike",
    )
    reps = sets.join(alike, ["set_a", "set_b", "n_shingles"]).where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "registers", "bands")
    reps = scratch.keep(reps.dropDuplicates(["rep", "n"]), "reps")

    banded = reps.select("rep", "bands").mapInArrow(_bands, "key long, rep long")
    reps = reps.drop("bands")
    shared, pairs = _hub_pairs(banded, scratch)
    confirm = lambda tested: _confirm(tested, reps, docs, percent, scratch)
    links = confirm(pairs)
    member = _open(shared, components(links, scratch), scratch)
    few = member.where(F.col("members") <= CROWDED)
    more = scratch.keep(_across(few).join(pairs, ["a", "b"], "left_anti"), "more")
    links = links.union(confirm(more))

    crowd = scratch.keep(member.where(F.col("members") > CROWDED).select("rep").distinct(), "crowd")
    crowded = only(docs, "doc_id", crowd).dropDuplicates(["doc_id"])
    placed = crowded.join(components(links, scratch).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "text")
    fine = placed.mapInArrow(_fine_bands(band_rows(percent, FINE_BUCKETS)), "key long, rep long, component long")
    member = _open_fine(scratch.keep(fine, "fine"))
    links = links.union(scratch.keep(_compared(member, crowded, reps, percent), "links"))

    copies = sets.join(alike, ["set_a", "set_b", "n_shingles"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    groups = components(links.union(copies), scratch)
    out = sets.select("doc_id", "n_shingles").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _hub_pairs(banded: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, rep, rank, members) of the buckets with several members, and the pairs (a < b) of each member and its hub."""
    counted = scratch.keep(banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "counted")
    shared = scratch.keep(banded.join(counted, "key"), "shared")
    degree = shared.groupBy("rep").agg(F.sum("members").alias("degree"))
    ranked = shared.join(degree, "rep").select("key", "rep", "members", F.struct("degree", (-F.col("rep")).alias("low")).alias("rank"))
    ranked = scratch.keep(ranked, "ranked")
    scratch.drop(shared)
    hubs = ranked.groupBy("key").agg((-F.max("rank")["low"]).alias("hub"))
    pairs = ranked.join(hubs, "key").where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    return ranked, scratch.keep(pairs.distinct(), "pairs")


def _open_fine(member: DataFrame) -> DataFrame:
    """(key, rep, members, component) of the buckets that hold several components; only these are joined by key."""
    keys = member.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("least"), F.max("component").alias("most"))
    return member.join(keys.where("least < most").select("key", "members"), "key")


def _compared(member: DataFrame, texts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links between components inside each bucket of ``member``, no more than connect them.

    Members are compared where they lie, a block of ``BLOCK`` with a block; only links leave the task.
    """
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = member.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("key", "rep", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    known = reps.join(texts.mapInArrow(_full_sets, "rep long, hashes binary"), "rep")
    bins = F.lit(1 + placed.count() // 512)
    full = placed.join(known, "rep").withColumn("bin", F.pmod(F.xxhash64("key", "low", "high"), bins))
    return full.groupBy("bin").applyInArrow(_connect(percent), "a long, b long")


def _connect(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("rep", "ascending")])
        key, low, high, part, rep, component, n = (table.column(c).to_numpy() for c in ("key", "low", "high", "part", "rep", "component", "n"))
        codes, hashes = _codes(table.column("registers")), [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        new = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
        out: list[tuple[int, int]] = []
        for x, y in zip(edges, edges[1:], strict=False):
            up: dict[int, int] = {}

            def root(c: int, up: dict[int, int] = up) -> int:
                while up.get(c, c) != c:
                    c = up[c]
                return c

            for i in range(x, y):
                one = np.arange(i + 1, y) if low[i] == high[i] else np.flatnonzero(part[i + 1 : y] != part[i]) + i + 1
                one = one[component[one] != component[i]]
                near = one[likely(codes[[i]], codes[one], n[[i]].repeat(len(one)), n[one], percent)] if len(one) else one
                for j in near.tolist():
                    a, b = root(int(component[i])), root(int(component[j]))
                    if a != b and linked(hashes[i], hashes[j], percent):
                        up[max(a, b)] = min(a, b)
                        out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _open(ranked: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the buckets that hold several components, with the component of the hub as ``main``."""
    member = ranked.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    member = scratch.keep(member, "member")
    keys = member.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.struct("rank", "component"))["component"].alias("main")
    )
    return member.join(keys.where("least < most").select("key", "main"), "key").select("key", "rep", "members", "component", "main")


def _across(member: DataFrame) -> DataFrame:
    """Pairs (a < b) that share a bucket and lie in different components."""
    outside = member.where("component <> main").select("key", F.col("rep").alias("one"), F.col("component").alias("apart"))
    both = outside.join(member, "key").where("component <> apart")
    return both.select(F.least("one", "rep").alias("a"), F.greatest("one", "rep").alias("b")).distinct()


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are linked: estimate from the registers, then the full sets."""
    left = reps.toDF("a", "n_a", "reg_a")
    right = reps.toDF("b", "n_b", "reg_b")
    likely = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "reg_a", "reg_b")
    likely = scratch.keep(likely.mapInArrow(_estimate(percent), "a long, b long"), "likely")
    texts = only(docs, "doc_id", likely.select("a").union(likely.select("b")))
    both = likely.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    return scratch.keep(both.mapInArrow(_verify(percent), "a long, b long").distinct(), "links")
