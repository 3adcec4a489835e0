"""Edges, expansion and reports over the knowledge graph.

The graph is one node table: entities and reified relationships, the latter with
``subject_id``, ``predicate``, ``object_id``. ``entity_links`` is an array column.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from mnemograph.functions import columns as C
from mnemograph.operators.skew import top_rows
from mnemograph.operators.vector import has_vector, prune_weighed, weigh
from mnemograph.session import new_path, stage

NOISE = ["log", "response"]
MEMBER_ROWS = 200_000  # nodes that one task of relationship_members sorts


EDGE = "struct<node_id:string,other:string,kind:string,source:string,target:string,predicate:string,pos:int>"


def _own() -> Column:
    """Edges a row gives itself: its object, its subject (reachable, no edge), its links."""
    i, s, o, p = (F.col(c) for c in ("id", "subject_id", "object_id", "predicate"))
    return F.concat(
        _if_set(o, _edge(i, o, "object", i, o, p)),
        _if_set(s, _edge(i, s, "subject", None, None, None)),
        F.transform(_links(), lambda x, n: _edge(i, x, "entity_link", i, x, F.lit("entity_link"), n)),
    )


def _incoming() -> Column:
    """Edges a row gives to others: to its object and to every row it links to."""
    i, o, p = (F.col(c) for c in ("id", "object_id", "predicate"))
    return F.concat(
        _if_set(o, _edge(o, i, "incoming_triple", i, o, p)),
        F.transform(_links(), lambda x: _edge(x, i, "incoming_link", i, x, F.lit("incoming_link"))),
    )


def _links() -> Column:
    return F.filter(F.coalesce("entity_links", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def _edge(node_id, other, kind, source, target, predicate, pos=None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        node_id.alias("node_id"), other.alias("other"), F.lit(kind).alias("kind"), text(source).alias("source"),
        text(target).alias("target"), text(predicate).alias("predicate"),
        (F.lit(0) if pos is None else pos).cast("int").alias("pos"),
    )


def _if_set(key: Column, edge: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) != "", F.array(edge)).otherwise(F.array().cast(f"array<{EDGE}>"))


def _exploded(nodes: DataFrame, part, at: DataFrame | None) -> DataFrame:
    rows = nodes.select(F.coalesce("weight", F.lit(0.0)).alias("weight"), F.explode(part()).alias("e"))
    rows = rows.select("e.*", "weight")
    return rows if at is None else rows.join(at.select("node_id"), "node_id", "left_semi")


def edges(nodes: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """All edges as (node_id, other, kind, source, target, predicate, pos, weight), seen from ``node_id``.

    Kinds: object (own triple), subject (reachable, but no edge), incoming_triple,
    incoming_link, entity_link. ``weight`` is that of the row an edge comes from; ``pos``
    is the place in the link array. ``at`` (node_id) restricts the result to those nodes.
    """
    return _exploded(nodes, _own, at).unionByName(_exploded(nodes, _incoming, at))


@dataclass(frozen=True)
class Layout:
    """A graph laid out for traversals: capped incoming ``edges`` by ``node_id`` and one row of ``own`` references and weight by ``id``, both bucketed and sorted by that key.

    An incoming edge goes from ``other`` to ``node_id``, so it holds no ends of its own; own edges are made of the row when it is met.
    """

    edges: DataFrame
    own: DataFrame
    per_kind: int

    @property
    def weights(self) -> DataFrame:
        return self.own.select("id", "weight", "has_vector")

    def steps(self, frontier: DataFrame) -> DataFrame:
        """Edges of ``frontier(qid, node_id)``: (qid, other, source, target, predicate, is_edge).

        Links of a node beyond ``per_kind`` give no edge but stay reachable.
        """
        met = frontier.join(self.edges, "node_id")
        met = met.select("qid", "other", F.col("other").alias("source"), F.col("node_id").alias("target"), "predicate", F.lit(True).alias("is_edge"))
        held = frontier.withColumnRenamed("node_id", "id").join(self.own.filter("refers"), "id").select("qid", F.explode(_own()).alias("e")).select("qid", "e.*")
        is_edge = (F.col("kind") == "object") | ((F.col("kind") == "entity_link") & (F.col("pos") < self.per_kind))
        return met.unionByName(held.select("qid", "other", "source", "target", "predicate", is_edge.alias("is_edge")))


def lay_out(nodes: DataFrame, per_kind: int, buckets: int | None = None) -> Layout:
    """Write the capped incoming edges and the references of a graph once, for all traversals of it.

    A hop joins its frontier with both by the bucket key, so only the frontier is shuffled. There are at
    least as many ``buckets`` as a shuffle has partitions; otherwise Spark would shuffle the edges to gain tasks.
    At most ``per_kind`` incoming edges of each kind per node stay; that does not depend on the query, so it is done once and
    in each task before the shuffle. Neither table holds vectors. ``nodes`` must not change while the layout is used.
    """
    n = buckets or max(16, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _exploded(nodes, _incoming, None).select("node_id", "kind", "other", "predicate", "weight")
    incoming = top_rows(rows, ["node_id", "kind"], [F.desc("weight"), F.asc("other")], per_kind, "n").select("node_id", "other", "predicate")
    refers = F.size(_own()) > 0
    own = nodes.select(
        "id", "subject_id", "predicate", "object_id", "entity_links", refers.alias("refers"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"), has_vector().alias("has_vector"),
    )
    return Layout(_bucketed(incoming, "node_id", n), _bucketed(own, "id", n), per_kind)


def _bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    path = new_path(df.sparkSession, "layout")
    name = path.rpartition("/")[2].replace("-", "_")
    df.hint("rebalance", key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def expand(
    nodes: DataFrame,
    seeds: DataFrame,
    query_vectors: DataFrame,
    hops: int = 1,
    per_kind: int = 10,
    layout: Layout | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion of many queries at once.

    ``seeds`` holds (qid, id), ``query_vectors`` (qid, embedding). Each hop follows the
    capped edges of the frontier, marks everything found as visited, and continues
    from the ``per_kind`` best new nodes per query. The cap does not depend on the query:
    a ``layout`` made once with the same ``per_kind`` serves all of them; without one it is made here.
    Returns nodes (qid, id, hop) and edges (qid, source, target, predicate, hop).
    """
    layout = lay_out(nodes, per_kind) if layout is None else layout
    if layout.per_kind != per_kind:
        raise ValueError(f"the layout is capped at {layout.per_kind}, not {per_kind}")
    weights = layout.weights
    frontier = stage(seeds.select("qid", "id").distinct(), "seeds")
    visited = frontier
    found = visited.join(nodes.select("id"), "id", "left_semi").select("qid", "id", F.lit(0).alias("hop"))
    walked = None
    for hop in range(1, max(hops, 1) + 1):
        start = frontier.select("qid", F.col("id").alias("node_id"))
        steps = stage(layout.steps(start), "steps")
        here = steps.filter("is_edge").select("qid", "source", "target", "predicate", F.lit(hop).alias("hop"))
        walked = here if walked is None else walked.unionByName(here)
        fresh = steps.select("qid", F.col("other").alias("id")).distinct().join(visited, ["qid", "id"], "left_anti")
        candidates = weigh(fresh, weights, query_vectors, per_kind)
        visited = visited.unionByName(candidates.select("qid", "id"))
        frontier = prune_weighed(candidates, nodes, query_vectors, per_kind)
        found = found.unionByName(frontier.select("qid", "id", F.lit(hop).alias("hop")))
    first_seen = walked.groupBy("qid", "source", "predicate", "target").agg(F.min("hop").alias("hop"))
    return found, first_seen


def resolve_dangling(nodes: DataFrame, found: DataFrame, walked: DataFrame, passes: int | None = None) -> DataFrame:
    """Add the nodes that edges and found relationships refer to, until nothing is new (or ``passes`` times).

    Returns (qid, id, hop); resolved rows have no hop.
    """
    triples = nodes.filter(F.coalesce("object_id", F.lit("")) != "").select("id", "subject_id", "object_id")
    known = nodes.select("id")
    wanted = walked.select("qid", F.explode(F.array("source", "target")).alias("id"))
    have = stage(found, "found")
    newest = have
    for _ in count() if passes is None else range(passes):
        ends = newest.select("qid", "id").join(triples, "id").select(
            "qid", F.explode(F.array("subject_id", "object_id")).alias("id")
        )
        asked = (ends if wanted is None else ends.unionByName(wanted)).filter(F.col("id") != "").distinct()
        wanted = None
        fresh = asked.join(have, ["qid", "id"], "left_anti").join(known, "id", "left_semi")
        newest = stage(fresh.select("qid", "id", F.lit(None).cast("int").alias("hop")), "resolved")
        if newest.isEmpty():
            break
        have = have.unionByName(newest)
    return have


def relationship_edges(nodes: DataFrame) -> DataFrame:
    """Distinct triples of relationship rows that have both ends."""
    rows = nodes.filter(
        (F.col("node_type") == "relationship")
        & (F.coalesce("subject_id", F.lit("")) != "")
        & (F.coalesce("object_id", F.lit("")) != "")
    )
    return rows.select("subject_id", "predicate", "object_id").distinct()


def relationship_members(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that take part in a relationship, with a seed flag.

    There is a task for each ``MEMBER_ROWS`` nodes, so the memory of one doesn't grow with the graph.
    """
    ends = nodes.filter(F.col("node_type") == "relationship").select(
        F.explode(F.array("subject_id", "object_id")).alias("id")
    )
    tasks = -(-nodes.select("id").count() // MEMBER_ROWS)
    dealt = lambda df: df.repartition(max(1, tasks), "id")
    members = dealt(nodes.select("id", "node_type", "content")).join(dealt(ends.filter(F.col("id") != "").distinct()), "id", "left_semi")
    flags = seeds.select("id", F.lit(True).alias("is_seed")).distinct()
    return members.join(flags, "id", "left").select(
        "id", "node_type", "content", F.coalesce("is_seed", F.lit(False)).alias("is_seed")
    )


def node_label(node_type, content):
    short = F.when(F.octet_length(content) > 60, F.concat(C.cut_bytes(content, 57), F.lit("..."))).otherwise(content)
    return F.concat(F.upper(F.substring(node_type, 1, 1)), F.substring(node_type, 2, 1000), F.lit("["), short, F.lit("]"))


def subgraph_report(nodes: DataFrame, members: DataFrame, walked: DataFrame) -> DataFrame:
    """Rows (qid, section, id, text, is_seed) for the entities and relationships of each subgraph.

    ``members`` holds (qid, id, hop) with hop 0 for seeds; ``walked`` the edges.
    Relationships come first; an edge with the same ends and predicate is not repeated.
    """
    info = nodes.select(
        "id", "node_type", node_label(F.col("node_type"), F.coalesce("content", F.lit(""))).alias("label"),
        "subject_id", "predicate", "object_id", F.coalesce("weight", F.lit(0.0)).alias("weight"),
    )
    rows = members.join(info, "id")
    seed = F.coalesce(F.col("hop") == 0, F.lit(False))
    is_rel = F.col("node_type") == "relationship"
    entities = rows.filter(~is_rel & ~F.col("node_type").isin(NOISE)).select(
        "qid", F.lit("entity").alias("section"), "id",
        F.concat(
            "label",
            F.when(F.col("weight") > 0, F.format_string(" (sig:%.1f)", F.col("weight"))).otherwise(""),
        ).alias("text"),
        seed.alias("is_seed"),
    )
    triples = rows.filter(is_rel).groupBy(
        "qid", F.col("subject_id").alias("source"), "predicate", F.col("object_id").alias("target")
    ).agg(F.min("id").alias("id"), F.max(seed).alias("is_seed"))
    plain = walked.select("qid", "source", "predicate", "target").distinct().join(
        triples, ["qid", "source", "predicate", "target"], "left_anti"
    )
    lines = triples.unionByName(
        plain.withColumn("id", F.lit("")).withColumn("is_seed", F.lit(False))
    )
    labels = rows.select("qid", F.col("id").alias("end"), "label")
    for end in ("source", "target"):
        side = labels.select("qid", F.col("end").alias(end), F.col("label").alias(f"{end}_label"))
        lines = lines.join(side, ["qid", end], "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    relations = lines.select(
        "qid", F.lit("relationship").alias("section"), "id",
        F.concat_ws(" -> ", "source_label", "predicate", "target_label").alias("text"), "is_seed",
    )
    return entities.unionByName(relations)
