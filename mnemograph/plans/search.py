"""Hybrid search, entity networks and graph context: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C
from mnemograph.operators import graph, joins
from mnemograph.operators.dedup import merge_neighbours
from mnemograph.operators.filters import in_range
from mnemograph.operators.keywords import search_many, words_of
from mnemograph.operators.rank import decay, external_order, rrf_fuse
from mnemograph.operators.sequences import first_occurrence
from mnemograph.operators.skew import top_rows
from mnemograph.operators.vector import nearest
from mnemograph.session import stage


def knowledge(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type") != "log")


def significant(nodes: DataFrame, floor: float = V.SIGNIFICANCE_FLOOR) -> DataFrame:
    return knowledge(nodes).filter(F.col("weight") >= floor)


def keyword_hits(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    docs = knowledge(nodes).select("id", "ts", F.concat_ws("\n", "content", "metadata").alias("text"))
    return search_many(queries.select("qid", words_of(F.col("query")).alias("words")), docs, k)


def hybrid_search(
    queries: DataFrame, nodes: DataFrame, as_of: Column, limit: int = 10, orders: DataFrame | None = None
) -> DataFrame:
    """Vector and keyword search fused by reciprocal rank, decayed by age: (qid, id, score, rank).

    ``queries`` holds (qid, query, embedding). 5 x limit candidates per list, 2 x limit
    after fusion, then ``limit``. ``orders`` (qid, indices) is a model's order of the
    2 x limit rows, if there is one.
    """
    queries = stage(queries.select("qid", "query", "embedding"), "queries")
    by_vector = nearest(queries, significant(nodes), 5 * limit)
    by_words = keyword_hits(queries, nodes, 5 * limit)
    fused = rrf_fuse([by_vector, by_words], 2 * limit)
    if orders is None:
        return decay(fused, nodes, as_of, limit)
    return external_order(decay(fused, nodes, as_of, 2 * limit), orders, limit)


def seeded_subgraph(
    queries: DataFrame, nodes: DataFrame, limit: int = 10, min_match: float = V.MIN_MATCH, hops: int = 1, per_kind: int = 10,
    layout: graph.Layout | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the nearest significant rows of each query."""
    seeds = stage(nearest(queries, significant(nodes), limit, min_score=min_match), "seeds")
    found, walked = graph.expand(nodes, seeds.select("qid", "id"), queries, hops, per_kind, layout)
    return graph.resolve_dangling(nodes, found, walked), walked


def entity_network(
    queries: DataFrame,
    nodes: DataFrame,
    evidence: DataFrame,
    entries: DataFrame,
    as_of: Column,
    days: int = 90,
    most: int = 50,
    neighbours: int = 20,
) -> DataFrame:
    """Profile rows of the entity each ``queries(qid, name, embedding)`` names.

    Parts: PRIMARY, METADATA (of the entity, if it has any), RELATION (rows with a predicate), FACT (others), ENTRY (recent
    source entries, newest first), OMITTED (how many were left out). ``evidence`` holds
    (id, target_id) from node to entry. Returns (qid, part, id, text).
    """
    root = stage(joins.find_entity(queries, nodes).select("qid", "id"), "roots")
    ids = root.select("id").distinct()
    discovered = joins.discover_related(queries, nodes, 10).join(root.select("qid"), "qid", "left_semi")
    links = nodes.select("id", F.explode("entity_links").alias("other"))
    linked = root.join(links, "id").select("qid", F.col("other").alias("id"))
    near = lambda pairs: top_rows(
        pairs.join(ids.withColumnRenamed("id", "target"), "target", "left_semi"), ["target"], [F.asc("other")], neighbours
    )
    incoming = near(links.select(F.col("other").alias("target"), F.col("id").alias("other")))
    triples = nodes.filter(F.col("object_id") != "")
    objects = near(triples.select(F.col("object_id").alias("target"), F.col("id").alias("other")))
    of_root = lambda pairs: root.join(pairs, root["id"] == pairs["target"]).select("qid", pairs["other"].alias("id"))
    merged = merge_neighbours([discovered, linked, of_root(incoming), of_root(objects)], root)

    info = nodes.select("id", "content", "predicate")
    facts = merged.join(info, "id").select(
        "qid",
        F.when(C.text_or_empty(F.col("predicate")) != "", "RELATION").otherwise("FACT").alias("part"),
        "id",
        "content",
    )
    primary = root.join(info, "id").select("qid", F.lit("PRIMARY").alias("part"), "id", "content")

    sources = root.join(evidence, "id").select("qid", F.col("target_id").alias("id")).distinct()
    dated = sources.join(entries.select("id", "ts", "content"), "id")
    recent = dated.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
    shown = top_rows(recent, ["qid"], [F.desc("ts"), F.asc("id")], most)
    short = F.when(F.length("content") > 200, F.concat(C.cut_runes(F.col("content"), 197), F.lit("..."))).otherwise(F.col("content"))
    log = shown.select(
        "qid", F.lit("ENTRY").alias("part"), "id",
        F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), short).alias("content"),
    )
    counts = dated.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("ts") >= as_of - F.expr(f"INTERVAL '{days}' DAY")).cast("int")).alias("r")
    )
    left_out = F.col("n") - F.least(F.col("r"), F.lit(most))
    omitted = counts.filter(left_out > 0).select(
        "qid", F.lit("OMITTED").alias("part"), F.lit("").alias("id"), left_out.cast("string").alias("content")
    )
    known = nodes.filter(~F.coalesce(C.trim_ws(F.col("metadata")), F.lit("")).isin("", "{}"))
    details = root.join(known.select("id", "metadata"), "id").select("qid", F.lit("METADATA").alias("part"), "id", F.col("metadata").alias("content"))
    out = primary.unionByName(details).unionByName(facts).unionByName(log).unionByName(omitted)
    return out.withColumnRenamed("content", "text")


def rag_context(
    queries: DataFrame,
    nodes: DataFrame,
    evidence: DataFrame,
    entries: DataFrame,
    as_of: Column,
    seeds: DataFrame | None = None,
    hops: int = 2,
    per_kind: int = 8,
    layout: graph.Layout | None = None,
) -> DataFrame:
    """Context rows around each query: (qid, section, pos, id, text).

    Seeds are given, or the ten best of the twenty nearest significant rows after decay.
    Sections: seed and neighbour entities by weight, relationships (one per pair of
    labels and predicate) by relevance, source entries by time.
    """
    if seeds is None:
        hits = nearest(queries, significant(nodes), 20)
        seeds = decay(hits, nodes, as_of, 10)
    seeds = stage(seeds.select("qid", "id"), "seeds")
    found, walked = graph.expand(nodes, seeds, queries, hops, per_kind, layout)
    members = stage(graph.resolve_dangling(nodes, found, walked), "members")
    info = nodes.select("id", "node_type", "content", "weight", "ts", "subject_id", "predicate", "object_id")
    rows = members.join(info, "id")
    is_rel = F.col("node_type") == "relationship"

    entities = rows.filter(~is_rel & ~F.col("node_type").isin(graph.NOISE)).select(
        "qid", F.when(F.col("hop") == 0, "seed").otherwise("neighbour").alias("section"),
        "id", F.col("content").alias("text"), (-F.coalesce("weight", F.lit(0.0))).alias("key"),
    )
    labels = rows.select("qid", "id", F.nullif("content", F.lit("")).alias("label"))
    triples = rows.filter(is_rel)
    for end in ("subject", "object"):
        side = labels.select("qid", F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_name"))
        triples = triples.join(side, ["qid", f"{end}_id"], "left").withColumn(
            f"{end}_label", F.coalesce(f"{end}_name", f"{end}_id")
        )
    relevance = C.temporal_bias(F.lit(1.0), F.col("ts"), as_of)
    distinct = first_occurrence(
        triples.withColumn("key", -F.round(relevance, 6)),
        ["qid", "subject_label", "predicate", "object_label"], ["key", "id"], ["id", "key"],
    )
    relations = distinct.select(
        "qid", F.lit("relationship").alias("section"), "id",
        F.concat_ws(" -> ", "subject_label", "predicate", "object_label").alias("text"), "key",
    )
    sources = members.join(evidence, "id").select("qid", F.col("target_id").alias("id")).distinct()
    preview = F.when(F.octet_length("content") > 120, F.concat(C.cut_bytes(F.col("content"), 117), F.lit("..."))).otherwise(F.col("content"))
    quoted = sources.join(entries.select("id", "ts", "content"), "id").select(
        "qid", F.lit("entry").alias("section"), "id",
        F.concat(F.lit("["), "id", F.lit("] "), F.col("ts").cast("date").cast("string"), F.lit(": "), preview).alias("text"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("key"),
    )
    return entities.unionByName(relations).unionByName(quoted)


def project_timeline(
    queries: DataFrame, nodes: DataFrame, analysed: DataFrame, start: str, end: str, limit: int = 100
) -> DataFrame:
    """(qid, part, id, day, text): status and briefing of the named project, then the entries mentioning it.

    ``queries`` holds (qid, name, embedding). A name meets an entry through the distinct
    entity names of the period, not through every pair.
    """
    project = joins.find_project(queries, nodes)
    info = nodes.select(
        "id", "content", F.coalesce(C.metadata_string(F.col("metadata"), "status"), F.lit("Unknown")).alias("status")
    )
    found = queries.select("qid").join(project, "qid", "left").join(info, "id", "left")
    head = found.select(
        "qid", F.lit("status").alias("part"), F.coalesce("id", F.lit("")).alias("id"), F.lit("").alias("day"),
        F.when(F.col("id").isNull(), "Not found in knowledge").otherwise(F.col("status")).alias("text"),
    )
    briefing = found.select(
        "qid", F.lit("briefing").alias("part"), F.coalesce("id", F.lit("")).alias("id"), F.lit("").alias("day"),
        F.coalesce(C.trim_ws(F.col("content")), F.lit("(No knowledge node for this project.)")).alias("text"),
    )
    doc = C.parse_analysis(F.col("entry_analysis"), F.col("id"))
    rows = in_range(analysed, start, end).withColumn("analysis", doc)
    line = F.coalesce(F.nullif("analysis.summary", F.lit("")), C.cut_runes(F.col("content"), 80))
    named = rows.select("id", "ts", line.alias("text"), F.explode("analysis.entities").alias("e")).select(
        "id", "ts", "text", F.lower("e.name").alias("entity")
    )
    wanted = queries.select("qid", F.lower(C.trim_ws(F.col("name"))).alias("name"))
    pairs = _containing(named.select("entity").distinct(), wanted.select("name").distinct())
    # the newest entries per name first, then per query: queries that share a name share them
    hits = pairs.join(named.dropDuplicates(["id", "entity"]), "entity").select("name", "id", "ts", "text").distinct()
    newest = top_rows(hits, ["name"], [F.desc("ts"), F.asc("id")], limit).join(wanted, "name")
    activity = newest.select(
        "qid", F.lit("activity").alias("part"), "id", F.col("ts").cast("date").cast("string").alias("day"), "text"
    )
    return head.unionByName(briefing).unionByName(activity)


def _containing(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, name) pairs where the entity contains the name.

    Entities are cut into substrings of the lengths that names have (a handful of
    small numbers), then it is an equi join.
    """
    lengths = sorted(r[0] for r in names.filter("name <> ''").select(F.length("name")).distinct().collect())
    entity = F.col("entity")
    cuts = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("entity") - n + 1, F.lit(1))), lambda i: F.substring(entity, i, F.lit(n))
    )
    pieces = F.concat(*[cuts(n) for n in lengths]) if lengths else F.array().cast("array<string>")
    parts = entities.select("entity", F.explode(F.array_distinct(pieces)).alias("name"))
    return parts.join(names, "name")
