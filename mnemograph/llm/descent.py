"""Near-duplicate vectors by NN-descent.

The neighbour graph starts from a few random-hyperplane partitions and is refined by comparing
the neighbours of each vector with each other, forward and backward, until little changes. A
list whose last neighbour still is a link is saturated and grows; where it stays saturated,
its whole group of links is compared in blocks, so counts are exact whatever a group's size,
and with the groups that it can touch, so that links which full lists dropped join them.
An audit compares a bounded sample of vectors with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemograph.llm.components import components
from mnemograph.llm.scratch import Scratch

K, MOST_K, JOIN_TOP = 10, 40, 4
TREES, LEAF, CELL, BLOCK = 4, 256, 512, 1024
ROUNDS, STEADY = 6, 0.001
AUDIT, ENOUGH, ATTEMPTS = 512, 0.9999, 3

EDGE = "u long, v long, cos float"
LINK = "a long, b long, n_a long, n_b long, cos double"


def _matrix(column, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; rows that can't be linked are left out."""
    for batch in batches:
        ids, out, dims = [], [], []
        for name, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if name is None or not vector.is_valid or vector.values.null_count or not len(vector.values):
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()
            ids.append(name)
            dims.append(len(x))
            out.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "vec"])


def _best(cos: np.ndarray, ids_u: np.ndarray, ids_v: np.ndarray, above: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` best (u, v, cos) of each row of ``cos`` that exceed the row's ``above``."""
    k = min(k, cos.shape[-1])
    top = np.argpartition(-cos, k - 1, axis=-1)[..., :k]
    value = np.take_along_axis(cos, top, -1)
    good = value > above[..., None]
    u = np.broadcast_to(ids_u[..., None], value.shape)[good]
    v = np.take_along_axis(np.broadcast_to(ids_v[..., None, :], cos.shape), top, -1)[good]
    return u, v, value[good]


def _edges(u, v, cos) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "cos": pa.array(cos, pa.float32())})


def _partitions(trees: range, bits: int):
    """(tree, key, id, vector) of each vector: the signs of ``bits`` random projections in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("vec"))
                short = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                for tree in trees:
                    planes = np.random.default_rng([tree, dim]).standard_normal((dim, bits))
                    sign = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), tree, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(sign.astype(np.int64)), part.column("rep"), short],
                        names=["tree", "dim", "key", "rep", "short"],
                    )

    return run


def _within_cell(table: pa.Table) -> pa.Table:
    x, ids = _matrix(table.column("short"), np.float32), table.column("rep").to_numpy()
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    return _edges(*_best(cos, ids, ids, np.full(len(ids), -1.5, np.float32), K)) if len(ids) > 1 else _edges([], [], [])


def _start(vectors: DataFrame, trees: range, n: int, scratch: Scratch) -> DataFrame:
    bits = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    keyed = vectors.mapInArrow(_partitions(trees, bits), "tree int, dim int, key long, rep long, short binary")
    keyed = scratch.keep(keyed, "keyed")
    parts = keyed.groupBy("tree", "dim", "key").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    celled = keyed.join(parts, ["tree", "dim", "key"]).withColumn("cell", F.pmod(F.xxhash64("rep", "tree"), F.col("cells")))
    return celled.groupBy("tree", "dim", "key", "cell").applyInArrow(_within_cell, EDGE)


def _closest(edges: DataFrame, lists: DataFrame | None) -> DataFrame:
    """The best edges of each u: ``K`` or, from ``lists`` (u, k), its own number; ``last`` is the worst of them."""
    edges = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    edges = edges.withColumn("k", F.lit(K)) if lists is None else edges.join(lists, "u", "left").withColumn("k", F.coalesce("k", F.lit(K)))
    best = Window.partitionBy("u").orderBy(F.col("cos").desc(), "v")
    return edges.withColumn("place", F.row_number().over(best)).where("place <= k")


def _longer(lists: DataFrame | None, full: DataFrame) -> DataFrame:
    """The greatest k of each u in ``lists`` and ``full`` (u, k)."""
    return full if lists is None else lists.union(full).groupBy("u").agg(F.max("k").alias("k"))


def _neighbours_joined(table: pa.Table) -> pa.Table:
    """Compares the members of each centre with each other; all centres of a bucket at once."""
    x, centre, ids, last = (
        _matrix(table.column("short"), np.float32), *(table.column(c).to_numpy() for c in ("centre", "member", "last"))
    )
    order = np.lexsort((ids, centre))
    x, centre, ids, last = x[order], centre[order], ids[order], last[order]
    new = np.append(True, centre[1:] != centre[:-1])
    group = np.cumsum(new) - 1
    place = np.arange(len(ids)) - np.flatnonzero(new)[group]
    shape = (int(group[-1]) + 1, int(place.max()) + 1)
    padded, names, floor = np.zeros((*shape, x.shape[1]), np.float32), np.full(shape, -1), np.full(shape, 2, np.float32)
    padded[group, place], names[group, place], floor[group, place] = x, ids, last
    empty = np.ones(shape, bool)
    empty[group, place] = False
    cos = padded @ padded.transpose(0, 2, 1)
    cos[np.broadcast_to(empty[:, None, :], cos.shape) | (names[:, :, None] == names[:, None, :])] = -2
    return _edges(*_best(cos, names, names, floor, JOIN_TOP))


def _refine(graph: DataFrame, vectors: DataFrame, n: int, round_: int) -> DataFrame:
    """Edges between the neighbours of each vector that beat the lists they would enter."""
    last = graph.groupBy("u").agg(F.count("*").alias("held"), F.min("cos").alias("cos"), F.max("k").alias("k"))
    last = last.select(F.col("u").alias("member"), F.when(F.col("held") < F.col("k"), F.lit(-1.5)).otherwise(F.col("cos")).cast("float").alias("last"))
    some = lambda by, other: Window.partitionBy(by).orderBy(F.xxhash64(other, F.lit(round_)), other)
    ahead = graph.withColumn("r", F.row_number().over(some("u", "v"))).where(F.col("r") <= K).select(F.col("u").alias("centre"), F.col("v").alias("member"))
    behind = graph.withColumn("r", F.row_number().over(some("v", "u"))).where(F.col("r") <= K).select(F.col("v").alias("centre"), F.col("u").alias("member"))
    members = ahead.union(behind).union(graph.select(F.col("u").alias("centre"), F.col("u").alias("member"))).distinct()
    known = vectors.select(F.col("rep").alias("member"), "dim", "short").join(last, "member", "left")
    joined = members.join(known.withColumn("last", F.coalesce("last", F.lit(-1.5).cast("float"))), "member")
    joined = joined.withColumn("bucket", F.pmod(F.xxhash64("centre"), F.lit(max(1, n // LEAF))))
    return joined.groupBy("dim", "bucket").applyInArrow(_neighbours_joined, EDGE)


def _descend(graph: DataFrame, lists: DataFrame | None, vectors: DataFrame, n: int, rounds: int, scratch: Scratch) -> DataFrame:
    for i in range(rounds):
        found = graph.select("u", "v", "cos").union(_refine(graph, vectors, n, i))
        better = scratch.keep(_closest(found, lists), "graph")
        new = better.join(graph, ["u", "v"], "left_anti").count()
        scratch.drop(graph)
        graph = better
        if new <= STEADY * n * K:
            break
    return graph


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            cos = (_matrix(batch.column("vec_a")) * _matrix(batch.column("vec_b"))).sum(axis=1)
            kept = batch.select(["a", "b", "n_a", "n_b"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cos)], names=[*kept.schema.names, "cos"])


def _links(graph: DataFrame, vectors: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The graph's edges of ``least`` or more in double precision, a < b once, with the vectors' multiplicities."""
    near = graph.where(F.col("cos") >= least - 1e-4).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    side = lambda x: vectors.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("vec").alias(f"vec_{x}"))
    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "vec_a", "vec_b")
    return scratch.keep(both.mapInArrow(_exact, LINK).where(F.col("cos") >= least), "links")


def _block_counts(least: float):
    def run(table: pa.Table) -> pa.Table:
        ids, part, n = (table.column(c).to_numpy() for c in ("rep", "part", "n"))
        x, low, high = _matrix(table.column("vec")), *(table.column(c)[0].as_py() for c in ("low", "high"))
        one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
        near = x[one] @ x[two].T >= least
        if low == high:
            np.fill_diagonal(near, False)
            return pa.table({"rep": pa.array(ids[one]), "links": pa.array(near @ n[two])})
        return pa.table({"rep": pa.array(np.concatenate([ids[one], ids[two]])), "links": pa.array(np.concatenate([near @ n[two], n[one] @ near]))})

    return run


def _dense_counts(members: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(rep, links) inside each group of ``members`` (rep, component), compared in blocks of about ``BLOCK``."""
    parts = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = members.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns(
        {"low": F.least("part", "other"), "high": F.greatest("part", "other")}
    )
    full = cells.join(vectors.select("rep", "n", "vec"), "rep").select("component", "low", "high", "rep", "part", "n", "vec")
    return full.groupBy("component", "low", "high").applyInArrow(_block_counts(least), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def _angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            cos = (_matrix(batch.column("vec")) * _matrix(batch.column("centre_vec"))).sum(axis=1)
            kept = [c for c in batch.schema.names if not c.endswith("vec")]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(np.arccos(np.clip(cos, -1, 1)))], names=[*kept, "angle"])


def _touching(reach: float):
    """Pairs (low, high) of balls (component, vec, radius) whose members can be ``reach`` or less apart."""

    def run(table: pa.Table) -> pa.Table:
        ids, part, radius = (table.column(c).to_numpy() for c in ("component", "part", "radius"))
        x, low, high = _matrix(table.column("vec")), *(table.column(c)[0].as_py() for c in ("low", "high"))
        one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
        near = np.arccos(np.clip(x[one] @ x[two].T, -1, 1)) <= radius[one][:, None] + radius[two][None, :] + reach
        i, j = np.nonzero(near)
        a, b = ids[one[i]], ids[two[j]]
        keep = a < b if low == high else np.ones(len(a), bool)
        return pa.table({"low": pa.array(np.minimum(a, b)[keep], pa.int64()), "high": pa.array(np.maximum(a, b)[keep], pa.int64())})

    return run


def _first_link(least: float):
    def run(table: pa.Table) -> pa.Table:
        ids, side, n = (table.column(c).to_numpy() for c in ("rep", "component", "n"))
        x, low = _matrix(table.column("vec")), table.column("low")[0].as_py()
        one, two = np.flatnonzero(side == low), np.flatnonzero(side != low)
        near = x[one] @ x[two].T
        at = int(near.argmax()) if near.size else -1
        found = [] if at < 0 or near.flat[at] < least else [(one[at // len(two)], two[at % len(two)])]
        pairs = [tuple(sorted(p, key=lambda i: ids[i])) for p in found]
        cols = [[ids[i] for i, _ in pairs], [ids[j] for _, j in pairs], [n[i] for i, _ in pairs], [n[j] for _, j in pairs], [near.flat[at] for _ in pairs]]
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "n_a", "n_b", "cos"])

    return run


def _bridges(top: DataFrame, vectors: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links between vectors of ``top`` (rep, component) in different components: all pairs of components that have one.

    A list that is full of links may have dropped others, which only a full list of the other
    vector too can hide. Each component is a ball around the vector it is named after; the balls
    are compared in blocks, then, in blocks again, the members that can reach the other ball.
    """
    reach = math.acos(min(1.0, least)) + 1e-6
    names = scratch.keep(top.select("component").distinct(), "names")
    some = names.count()
    if some < 2:
        return scratch.keep(_no_links(top), "bridges")
    centres = scratch.keep(names.join(vectors.select(F.col("rep").alias("component"), "dim", F.col("vec").alias("centre_vec")), "component"), "centres")
    small = lambda df, rows: F.broadcast(df) if rows <= 20_000 else df
    member = scratch.keep(top.join(vectors.select("rep", "n", "vec"), "rep"), "member")
    apart = member.join(small(centres.drop("dim"), some), "component").select("component", "vec", "centre_vec")
    radius = apart.mapInArrow(_angle, "component long, angle double").groupBy("component").agg(F.max("angle").alias("radius"))
    balls = scratch.keep(centres.join(radius, "component"), "balls")
    parts = balls.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = balls.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("component"), F.col("parts")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    cells = cells.select("dim", "low", "high", "part", "component", "radius", F.col("centre_vec").alias("vec"))
    pairs = scratch.keep(cells.groupBy("dim", "low", "high").applyInArrow(_touching(reach), "low long, high long"), "touching")
    if pairs.isEmpty():
        return scratch.keep(_no_links(top), "bridges")
    both = pairs.select("low", "high", F.col("low").alias("component"), F.col("high").alias("beyond")).union(pairs.select("low", "high", "high", "low"))
    far = balls.select(F.col("component").alias("beyond"), "radius", "centre_vec")
    facing = member.select("rep", "component", "vec").join(both, "component").join(small(far, some), "beyond")
    facing = facing.select("rep", "component", "low", "high", "radius", "vec", "centre_vec")
    facing = facing.mapInArrow(_angle, "rep long, component long, low long, high long, radius double, angle double").where(F.col("angle") <= F.col("radius") + reach)
    facing = scratch.keep(facing.select("rep", "component", "low", "high"), "facing")
    side = facing.groupBy("low", "high").agg(
        *(F.ceil(F.sum((F.col("component") == F.col(c)).cast("int")) / BLOCK).cast("int").alias(f"of_{c}") for c in ("low", "high"))
    ).where("of_low > 0 and of_high > 0")
    placed = facing.join(side, ["low", "high"])
    first = F.col("component") == F.col("low")
    part = F.pmod(F.xxhash64("rep"), F.when(first, F.col("of_low")).otherwise(F.col("of_high"))).cast("int")
    placed = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("of_high")).otherwise(F.col("of_low")) - 1)))
    placed = placed.withColumns({"i": F.when(first, F.col("part")).otherwise(F.col("other")), "j": F.when(first, F.col("other")).otherwise(F.col("part"))})
    full = placed.select("low", "high", "i", "j", "rep", "component").join(member.select("rep", "n", "vec"), "rep")
    return scratch.keep(full.groupBy("low", "high", "i", "j").applyInArrow(_first_link(least), LINK), "bridges")


def _no_links(table: DataFrame) -> DataFrame:
    return table.sparkSession.createDataFrame([], LINK)


def audit(vectors: DataFrame, counts: DataFrame, least: float, scratch: Scratch) -> float:
    """Recall of links: up to ``AUDIT`` vectors, those of smallest hash, against all vectors."""
    asked = vectors.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT).select("rep", "dim", "vec").collect()
    queries = {d: ([r["rep"] for r in asked if r["dim"] == d], np.array([np.frombuffer(r["vec"]) for r in asked if r["dim"] == d])) for d in {r["dim"] for r in asked}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids, n = (batch.column(c).to_numpy() for c in ("dim", "rep", "n"))
            for dim, (names, x) in queries.items():
                mine = np.flatnonzero(dims == dim)
                if len(mine):
                    near = x @ _matrix(batch.column("vec").take(pa.array(mine))).T >= least
                    near &= np.array(names)[:, None] != ids[mine][None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(near @ n[mine], pa.int64())], names=["rep", "links"])

    true = vectors.select("rep", "dim", "n", "vec").mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("true"))
    got = true.join(counts, "rep", "left").agg(F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return 1.0 if not got["true"] else got["found"] / got["true"]


def near_vectors(table: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``table`` (vec_id, embedding).

    Two rows are linked at a cosine of ``least`` or more in double precision. n_links counts the
    other rows linked with a row, component_id is the smallest vec_id reachable by links, and
    kept says that it is the row's own. Equal vectors meet in one representative with a
    multiplicity; they are linked with each other.

    A vector that is null, empty or zero, or holds a null or non-finite component, is linked
    with nothing, as is a row without vec_id (component_id null, kept). Vectors of different
    lengths aren't compared. Repeated rows count as vectors. Other columns are not read. The
    result is approximate in recall only: no link below ``least`` is reported, and the search
    is repeated from more partitions while the audit finds less than ``ENOUGH`` of the links.
    """
    scratch = Scratch(table.sparkSession, "descent")
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    units = scratch.keep(table.mapInArrow(_unit, "vec_id long, dim int, vec binary").withColumns({"a": F.xxhash64("vec"), "b": F.crc32("vec")}), "units")
    alike = scratch.keep(units.groupBy("dim", "a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "alike")
    vectors = units.join(alike, ["dim", "a", "b"]).where("vec_id = rep").dropDuplicates(["dim", "a", "b"]).select("rep", "dim", "n", "vec")
    vectors = scratch.keep(vectors.mapInArrow(_shortened, "rep long, dim int, n long, vec binary, short binary"), "vectors")
    n = vectors.count()

    graph = None
    for attempt in range(ATTEMPTS):
        start = _start(vectors, range(attempt * TREES, (attempt + 1) * TREES), n, scratch)
        start = start if graph is None else start.union(graph.select("u", "v", "cos"))
        graph = _descend(scratch.keep(_closest(start, None), "graph"), None, vectors, n, ROUNDS, scratch)
        k, lists = K, None
        while k < MOST_K:
            full = graph.groupBy("u").agg(F.count("*").alias("held"), F.min("cos").alias("cos")).where((F.col("held") >= k) & (F.col("cos") >= least - 1e-4))
            full = scratch.keep(full.select("u", F.lit(2 * k).alias("k")), "saturated")
            if full.isEmpty():
                break
            k *= 2
            lists = scratch.keep(_longer(lists, full), "lists")
            graph = _descend(scratch.keep(graph.drop("k").join(lists, "u", "left").withColumn("k", F.coalesce("k", F.lit(K))), "graph"), lists, vectors, n, 2, scratch)
        links = _links(graph, vectors, least, scratch)
        groups = components(links, scratch)
        top = graph.groupBy("u").agg(F.count("*").alias("held"), F.min("cos").alias("cos")).where((F.col("held") >= MOST_K) & (F.col("cos") >= least - 1e-4))
        top = scratch.keep(top.select(F.col("u").alias("node")).join(groups, "node").select(F.col("node").alias("rep"), "component"), "top")
        links = links.union(_bridges(top, vectors, least, scratch))
        groups = components(links, scratch)
        direct = links.select(F.col("a").alias("rep"), F.col("n_b").alias("links")).union(links.select("b", "n_a"))
        held = scratch.keep(direct.groupBy("rep").agg(F.sum("links").alias("links"), F.count("*").alias("held")), "held")
        dense = held.where(F.col("held") >= K).join(groups.withColumnRenamed("node", "rep"), "rep").select("component").distinct()
        members = scratch.keep(groups.join(dense, "component").select(F.col("node").alias("rep"), "component"), "dense")
        inside = _dense_counts(members, vectors, least)
        counts = held.join(members, "rep", "left_anti").select("rep", "links").union(inside)
        counts = scratch.keep(counts, "counts")
        if audit(vectors, counts, least, scratch) >= ENOUGH:
            break

    copies = units.join(alike, ["dim", "a", "b"]).select("vec_id", "rep", "n")
    joined = copies.join(counts, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    joined = joined.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    groups = components(links.select("a", "b").union(copies.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))), scratch)
    out = table.select("vec_id").join(joined, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = pa.array([np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column("vec").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, short], names=[*batch.schema.names, "short"])
