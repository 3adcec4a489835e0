"""Lookups between log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemograph.functions import columns as C
from mnemograph.operators import names
from mnemograph.operators.filters import of_type
from mnemograph.operators.keywords import search_many
from mnemograph.operators.skew import top_rows
from mnemograph.operators.vector import nearest
from mnemograph.session import stage


def entry_dates(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """Date of each distinct referenced entry; unknown entries are left out."""
    wanted = refs.filter(F.col("entry_id") != "").select("entry_id").distinct()
    dated = entries.filter(F.col("ts").isNotNull()).select(
        F.col("id").alias("entry_id"), F.col("ts").cast("date").cast("string").alias("entry_date")
    )
    return wanted.join(dated, "entry_id")


def source_dates(refs: DataFrame, entries: DataFrame, per_node: int = 5) -> DataFrame:
    """First ``per_node`` distinct source dates of each node, in the order of its references.

    ``refs`` holds (id, pos, entry_id), one row per reference.
    """
    dated = entries.filter(F.col("ts").isNotNull()).select(
        F.col("id").alias("entry_id"), F.col("ts").cast("date").cast("string").alias("entry_date")
    )
    found = refs.filter(F.col("entry_id") != "").join(dated, "entry_id")
    first = found.groupBy("id", "entry_date").agg(F.min("pos").alias("pos"))
    return top_rows(first, ["id"], [F.asc("pos")], per_node)


def incoming_triples(relationships: DataFrame, targets: DataFrame) -> DataFrame:
    """Relationship rows whose object is one of ``targets(id)``."""
    ids = targets.select(F.col("id").alias("object_id")).distinct()
    return relationships.join(ids, "object_id", "left_semi")


def incoming_links(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, id) for every row that links to one of ``targets(id)``."""
    links = rows.select("id", F.explode("entity_links").alias("target_id")).distinct()
    return links.join(targets.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")


def label_relationships(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships with the content of both ends, or the id where the end is unknown."""
    named = nodes.select("id", F.nullif("content", F.lit("")).alias("label"))
    out = relationships
    for end in ("subject", "object"):
        side = named.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_name"))
        out = out.join(side, f"{end}_id", "left").withColumn(f"{end}_label", F.coalesce(f"{end}_name", f"{end}_id"))
    return out.drop("subject_name", "object_name")


def linked_completed_project(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """First completed project or goal a node refers to: parent goal, project, then its links in order.

    ``links`` holds (id, pos, target_id).
    """
    field = lambda key, prio: nodes.select(
        "id", C.metadata_string(F.col("metadata"), key).alias("project_id"), F.lit(prio).cast("bigint").alias("prio")
    )
    candidates = (
        field("parent_goal", -2)
        .unionByName(field("project_uuid", -1))
        .filter(F.col("project_id").isNotNull())
        .unionByName(links.select("id", F.col("target_id").alias("project_id"), F.col("pos").cast("bigint").alias("prio")))
    )
    done = of_type(nodes, "project", "goal").filter(C.metadata_string(F.col("metadata"), "status") == "completed")
    hits = candidates.join(done.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return hits.groupBy("id").agg(F.min_by("project_id", "prio").alias("project_id"))


def dangling_ids(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of relationships that are not in the node table."""
    ends = relationships.select(F.explode(F.array("subject_id", "object_id")).alias("id"))
    return ends.filter(F.col("id") != "").distinct().join(nodes.select("id"), "id", "left_anti")


def missing_embeddings(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("embedding").isNull() | (F.size("embedding") == 0))


def find_entity(queries: DataFrame, nodes: DataFrame, pool: int = 15) -> DataFrame:
    """Best person per ``queries(qid, name, embedding)``.

    The nearest person whose content contains the name, or is contained in it, goes first,
    wherever it ranks; without one the nearest person. Names are looked for among the ``pool`` nearest,
    and for queries without one there among all persons.
    """
    people = of_type(nodes, "person").select("id", F.lower("content").alias("content"), "embedding")
    asked = queries.select("qid", names.trimmed(F.col("name")).alias("name"), "embedding")
    match = names.holds(F.col("content"), F.col("name")) | names.holds(F.col("name"), F.col("content"))
    # texts come last, so that none is moved with a hit
    named = nearest(queries, people, pool).join(asked.select("qid", "name"), "qid").join(people.select("id", "content"), "id")
    named = named.select("qid", "id", "score", "rank", match.alias("match"))
    order = F.struct(F.when(F.col("match"), 0).otherwise(1), F.col("rank"))
    near = named.groupBy("qid").agg(F.min_by(F.struct("id", "score", "match"), order).alias("b"))
    near = stage(near.select("qid", "b.*"), "entities")
    unnamed = near.filter("not match").select("qid")
    if unnamed.isEmpty():
        return near.select("qid", "id", "score")
    rest = names.named_rows(asked.join(unnamed, "qid", "left_semi"), people)
    rest = rest.select("qid", F.struct("id", "score").alias("far"))
    return near.join(rest, "qid", "left").select("qid", F.coalesce("far.id", "id").alias("id"), F.coalesce("far.score", "score").alias("score"))


def find_project(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest project or goal per query."""
    return nearest(queries, of_type(nodes, "project", "goal"), 1).select("qid", "id", "score")


def discover_related(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Nearest rows per query, without persons whose content contains the name.

    The search among persons goes on, four times as far each round, for the queries that
    have met fewer than ``limit`` others so far.
    """
    people = of_type(nodes, "person").select("id", F.lower("content").alias("content"), "embedding")
    hits = nearest(queries, nodes.filter(~F.col("node_type").isin("log", "person")), limit).select("qid", "id", "score")
    asked, k = queries.select("qid", names.trimmed(F.col("name")).alias("name"), "embedding"), 2 * limit
    while True:
        named = nearest(asked, people, k).join(asked.select("qid", "name"), "qid").join(people.select("id", "content"), "id")
        met = stage(named.select("qid", "id", "score", names.holds(F.col("content"), F.col("name")).alias("self")), "met")
        short = met.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(~F.col("self")).alias("others"))
        short = short.filter((F.col("n") >= k) & (F.col("others") < limit)).select("qid")
        hits = hits.unionByName(met.filter("not self").join(short, "qid", "left_anti").drop("self"))
        if short.isEmpty():
            return top_rows(hits, ["qid"], [F.desc("score"), F.asc("id")], limit).select("qid", "id", "score", "rank")
        asked, k = stage(asked.join(short, "qid", "left_semi"), "asked"), 4 * k


def search_bookmarks(queries: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """Nearest ``k`` bookmarks per ``queries(qid, embedding)``: (qid, id, score, rank, title, url)."""
    marks = of_type(nodes, "bookmark")
    hits = nearest(queries, marks, k)
    shown = marks.select("id", F.regexp_replace("content", "^Bookmark: ", "").alias("title"), F.get_json_object("metadata", "$.url").alias("url"))
    return hits.join(shown, "id")


def question_mentions(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """Newest question that mentions a proper noun of each message(qid, text).

    Terms are searched one by one, so a message meets at most one question per term.
    """
    terms = messages.select("qid", F.explode(C.proper_nouns(F.col("text"))).alias("term"))
    searches = terms.select(F.col("term").alias("qid"), F.array("term").alias("words")).distinct()
    haystack = questions.select(
        "id", F.col("created").alias("ts"), F.concat_ws(" ", "question", "context").alias("text")
    )
    first = search_many(searches, haystack, 1).select(F.col("qid").alias("term"), "id")
    dated = first.join(questions.select("id", F.col("created").alias("ts")), "id")
    best = F.min_by("id", F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), F.col("id")))
    return terms.join(dated, "term").groupBy("qid").agg(best.alias("question_id"))


def project_mentions(analysed: DataFrame, project: str) -> DataFrame:
    """Entries with an extracted entity whose name contains the project name."""
    doc = C.parse_analysis(F.col("entry_analysis"), F.col("id"))
    rows = analysed.filter(F.contains(F.lower("entry_analysis"), F.lit(project.lower()))).withColumn("analysis", doc)
    named = F.exists("analysis.entities", lambda e: F.contains(F.lower(e["name"]), F.lit(project.lower())))
    line = F.coalesce(F.nullif("analysis.summary", F.lit("")), C.cut_runes(F.col("content"), 80))
    return rows.filter(named).select("id", "ts", line.alias("line"))


def active_project(tasks: DataFrame, roots: int | None = None, children: int = 10) -> DataFrame:
    """Newest open root task with open children, and those children; with ``roots`` only of the newest ``roots``."""
    open_tasks = tasks.filter(F.col("status").isin("pending", "active"))
    candidates = open_tasks.filter(F.col("parent_id") == "")
    if roots is not None:
        candidates = candidates.orderBy(F.desc("ts"), F.asc("id")).limit(roots)
    kids = open_tasks.filter(F.col("parent_id") != "")
    parent = (
        candidates.join(kids.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")
        .orderBy(F.desc("ts"), F.asc("id"))
        .limit(1)
    )
    own = kids.join(F.broadcast(parent.select(F.col("id").alias("parent_id"))), "parent_id", "left_semi")
    listed = own.orderBy(F.asc("ts"), F.asc("id")).limit(children)
    cols = ["id", "parent_id", "status", "content", "ts"]
    return parent.select(*cols).unionByName(listed.select(*cols))
