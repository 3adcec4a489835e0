"""Table maintenance as pure functions: (table, changes) -> new table.

Id lists of a row (source entries, linked rows) are kept as link tables
(id, target_id), one row per link, so that a row observed by a third of all
entries is a union and a distinct, not one huge array. ``sources.versioned`` publishes
the result part by part; nothing is overwritten in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C
from mnemograph.operators.dedup import semantic_anti_join
from mnemograph.operators.skew import top_rows
from mnemograph.operators.vector import nearest_one, nearest_one_of_type, smaller_within
from mnemograph.session import stage

DEFAULT_LABELS = ("Assistant asked", "User responded")


def _patched(rows: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with the non-null fields of ``changes`` applied, joined on id."""
    new = changes.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(new, "id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f)) if f in rows.columns else out.withColumn(f, F.col(f"_{f}"))
    return out.drop(*[f"_{f}" for f in fields])


def append_error() -> Column:
    """Why a row (content, source) can't be appended; null if it can."""
    return F.when(C.text_or_empty(F.col("content")) == "", "content is required").when(C.text_or_empty(F.col("source")) == "", "source is required")


def append_entries(new: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) for rows (id, content, source, ts, image_url and maybe audio_url)."""
    checked = new.withColumn("error", append_error())
    accepted = checked.filter(F.col("error").isNull()).select(
        "id", F.lit("log").alias("node_type"), "content", "source", F.coalesce("ts", as_of).alias("ts"),
        F.lit(V.WEIGHTS["log"]).alias("weight"), *[C.text_or_empty(F.col(c)).alias(c) for c in ("image_url", "audio_url") if c in new.columns],
    )
    return accepted, checked.filter(F.col("error").isNotNull()).select("id", "error")


def update_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Set content, and for audio its url and transcription, where given."""
    fields = [f for f in ("content", "audio_url", "transcription") if f in changes.columns]
    return _patched(entries, changes, fields)


def delete_by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def delete_where(table: DataFrame, source: str | None = None, marker: str | None = None, dry_run: bool = False) -> DataFrame:
    """Without the rows of a source, or holding a marker text; ``dry_run`` counts them instead."""
    hit = F.lit(False)
    if source is not None:
        hit = hit | F.coalesce(F.col("source") == source, F.lit(False))
    if marker is not None:
        hit = hit | F.coalesce(F.contains("content", F.lit(marker)), F.lit(False))
    if dry_run:
        return table.filter(hit).agg(F.count(F.lit(1)).alias("n"))
    return table.filter(~hit)


def strip_done(entries: DataFrame) -> DataFrame:
    """Rows whose content loses a trailing "done": (id, content)."""
    new = C.strip_done(F.col("content"))
    return entries.select("id", F.col("content").alias("old"), new.alias("content")).filter(
        F.col("content") != F.col("old")
    ).drop("old")


# facts and entities


def same_fact(new: Column, old: Column) -> Column:
    """Default decision: equal text up to case and spacing means update."""
    return F.when(C.dedup_text(new) == C.dedup_text(old), "update").otherwise("insert")


def upsert_facts(facts: DataFrame, nodes: DataFrame, decide=same_fact, replace: bool = False) -> DataFrame:
    """Write plan for ``facts(qid, content, node_type, metadata, ts, embedding)``.

    The nearest non-log row within 0.25 is updated when ``decide`` says so; all else is
    inserted under the fact's own id. Returns (qid, id, action, content, node_type,
    metadata, ts, weight, domain). Of several facts that update one row, the last one
    by (ts, qid) is kept.
    """
    near = nearest_one(facts, nodes.filter(F.col("node_type") != "log"), V.FACT_DISTANCE)
    old = nodes.select("id", F.col("content").alias("old"), F.col("metadata").alias("old_meta"))
    rows = facts.join(near, "qid", "left").join(old, "id", "left")
    action = F.when(F.col("id").isNotNull(), decide(F.col("content"), F.col("old"))).otherwise("insert")
    identity = F.col("node_type") == "user_identity"
    kept_meta = F.col("metadata") if replace else F.coalesce("metadata", "old_meta")
    planned = rows.withColumn("action", action).select(
        F.when(F.col("action") == "update", F.col("id")).otherwise(F.col("qid")).alias("id"),
        F.struct(
            "qid", "action", "content", "node_type", kept_meta.alias("metadata"), "ts",
            F.when(identity, V.WEIGHTS["user_identity"]).otherwise(V.WEIGHTS["fact"]).alias("weight"),
            F.when(identity, "identity").otherwise("thought").alias("domain"),
        ).alias("r"),
    )
    last = planned.groupBy("id").agg(F.max_by("r", F.struct("r.ts", "r.qid")).alias("r"))
    return last.select("id", "r.*")


def ensure_nodes(mentions: DataFrame, nodes: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Resolve ``mentions(name, node_type, entry_id, ts)`` to node ids.

    In order: nearest node of the same type within 0.15 (``embeddings`` gives
    (name, embedding); skipped without it), the hash id of type and name, a node of any
    type with that name, a new node. Mentions of one new name share the node of the
    first of them, whatever their types. With ``embeddings`` a new node also takes the id of the smallest
    new node of its type within 0.15, and so on down to one that has none. A given ``entity_`` id that does not exist is an
    error. Returns distinct (name, node_type, id, how, error).
    """
    clean = C.trim_ws(F.col("name"))
    at = F.col("ts") if "ts" in mentions.columns else F.lit(None).cast("timestamp_ntz")
    keys = (
        mentions.select(
            clean.alias("name"), F.coalesce(F.nullif("node_type", F.lit("")), F.lit("person")).alias("node_type"), at.alias("at")
        )
        .filter(F.col("name") != "")
        .groupBy("name", "node_type")
        .agg(F.min("at").alias("at"))
        .withColumn("given", F.col("name").startswith("entity_"))
        .withColumn(
            "hash_id",
            F.when(F.col("given"), F.col("name")).otherwise(C.entity_id(F.col("node_type"), F.col("name"))),
        )
        .withColumn("name_key", F.lower("name"))
    )
    by_id = nodes.select(F.col("id").alias("hash_id"), F.lit(True).alias("has_id"))
    by_name = (
        nodes.filter(~F.col("node_type").isin("log", "relationship"))
        .select("id", F.lower(C.trim_ws(F.col("content"))).alias("name_key"))
        .join(keys.select("name_key").distinct(), "name_key", "left_semi")
        .groupBy("name_key")
        .agg(F.min("id").alias("name_id"))
    )
    rows = keys.join(by_id, "hash_id", "left").join(by_name, "name_key", "left")
    if embeddings is None:
        rows = rows.withColumn("near_id", F.lit(None).cast("string"))
    else:
        asked = keys.join(embeddings, "name").select(
            F.concat_ws("\x1f", "node_type", "name").alias("qid"), "node_type", "embedding"
        )
        near = nearest_one_of_type(asked, nodes.filter(F.col("embedding").isNotNull()), V.ENTITY_DISTANCE)
        rows = (
            rows.withColumn("qid", F.concat_ws("\x1f", "node_type", "name"))
            .join(near.select("qid", F.col("id").alias("near_id")), "qid", "left")
        )
    how = (
        F.when(F.col("near_id").isNotNull(), "similar")
        .when(F.col("has_id"), "id")
        .when(F.col("name_id").isNotNull(), "name")
        .when(F.col("given"), "missing")
        .otherwise("new")
    )
    picked = (
        F.when(F.col("how") == "similar", F.col("near_id"))
        .when(F.col("how") == "name", F.col("name_id"))
        .when(F.col("how") == "new", F.coalesce("first_id", "hash_id"))
        .when(F.col("how") != "missing", F.col("hash_id"))
    )
    error = F.when(F.col("how") == "missing", F.concat(F.lit("entity id not found: "), F.col("name")))
    rows = rows.withColumn("how", how)
    firsts = rows.filter(F.col("how") == "new").groupBy("name_key").agg(
        F.min_by("hash_id", F.struct("at", "hash_id")).alias("first_id")
    )
    resolved = rows.join(firsts, "name_key", "left").select(
        "name", "node_type", picked.alias("id"), "how", error.alias("error")
    )
    if embeddings is None:
        return resolved
    resolved = stage(resolved, "resolved")
    fresh = new_nodes(resolved, embeddings)
    pairs = smaller_within(fresh.select(F.col("id").alias("qid"), "node_type", "embedding"), fresh, 1.0 - V.ENTITY_DISTANCE)
    pairs = stage(pairs.select(F.col("qid").alias("a"), F.col("id").alias("b")), "similar")
    return resolved if pairs.isEmpty() else merge_similar_new(resolved, pairs)


def new_nodes(resolved: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, name, node_type, embedding) of the new nodes of ``ensure_nodes``: each by the mention that its id comes from."""
    own = (F.col("how") == "new") & (F.col("id") == C.entity_id(F.col("node_type"), F.col("name")))
    first = resolved.filter(own).groupBy("id").agg(F.min(F.struct("name", "node_type")).alias("r")).select("id", "r.*")
    vectors = embeddings.groupBy("name").agg(F.first("embedding").alias("embedding"))
    return first.join(vectors, "name", "left").select("id", "name", "node_type", "embedding")


def merge_similar_new(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """Give new names that are close to each other one id: the smallest of their component.

    ``pairs`` holds (a, b) ids of new nodes within the threshold. Merging is transitive.
    """
    both = stage(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs"
    )
    label = both.select("a", F.col("a").alias("label")).distinct()
    while True:
        lowest = both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = label.join(lowest, "a", "left").select(
            "a", F.least("label", F.coalesce("low", "label")).alias("new"), "label"
        )
        step = stage(step, "labels")
        label = step.select("a", F.col("new").alias("label"))
        if step.filter(F.col("new") != F.col("label")).isEmpty():
            break
    final = label.select(F.col("a").alias("id"), "label")
    return resolved.join(final, "id", "left").withColumn("id", F.coalesce("label", "id")).drop("label")


def upsert_relationships(
    observed: DataFrame, existing: DataFrame, evidence: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Merge observed triples into (relationships, evidence links).

    ``observed`` holds (subject_id, predicate, object_id, entry_id, ts). One row per
    triple whatever the number of observations; a given time refreshes the stored one.
    """
    pred = C.normalise_predicate(F.col("predicate"))
    rows = observed.withColumn("predicate", pred).filter(
        (F.col("subject_id") != "") & (F.col("object_id") != "") & (F.col("predicate") != "")
    )
    rows = rows.withColumn("id", C.relationship_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    latest = rows.groupBy("id", "subject_id", "predicate", "object_id").agg(F.max("ts").alias("seen"))
    old = existing.select(
        "id", *[F.col(c).alias(f"_{c}") for c in ("subject_id", "predicate", "object_id", "ts")], F.lit(False).alias("_new")
    )
    both = latest.join(old, "id", "full")
    pick = lambda c: F.coalesce(f"_{c}", c).alias(c)
    merged = both.select(
        "id", pick("subject_id"), pick("predicate"), pick("object_id"),
        F.coalesce("seen", "_ts", as_of).alias("ts"),
        F.coalesce("_new", F.lit(True)).alias("is_new"),
    ).withColumn("content", F.concat_ws(" ", "subject_id", "predicate", "object_id")).withColumn(
        "weight", F.lit(V.WEIGHTS["relationship"])
    )
    links = rows.filter(F.col("entry_id") != "").select("id", F.col("entry_id").alias("target_id"))
    return merged, link_union(evidence, links)


def link_union(links: DataFrame, added: DataFrame) -> DataFrame:
    """Distinct (id, target_id) of both; adding twice changes nothing."""
    pairs = links.select("id", "target_id").unionByName(added.select("id", "target_id"))
    return pairs.filter((F.col("id") != "") & (F.col("target_id") != "")).distinct()


def ids_add_remove(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Links after adding, then removing."""
    return link_union(current, added).join(removed.select("id", "target_id").distinct(), ["id", "target_id"], "left_anti")


def hot_edges(relationships: DataFrame, as_of: Column, slots: int = V.HOT_EDGE_SLOTS, relevance: str = "decayed") -> DataFrame:
    """At most ``slots`` relationships per object, by relevance, then newest: (object_id, slot, id, score)."""
    score = F.lit(1.0)
    if relevance == "decayed":
        score = C.temporal_bias(score, F.col("ts"), as_of)
    elif relevance == "stored":
        score = F.coalesce("relevance_score", F.lit(0.0))
    rows = relationships.select("object_id", "id", "ts", F.round(score, 6).alias("score")).filter(F.col("object_id") != "")
    ranked = top_rows(rows, ["object_id"], [F.desc("score"), F.desc("ts"), F.asc("id")], slots, "slot")
    return ranked.select("object_id", "slot", "id", "score")


def boost(nodes: DataFrame, mentions: DataFrame, step: float = 0.05, ceiling: float = 1.0) -> DataFrame:
    """Weight raised by ``step`` per mention up to ``ceiling``: changed rows (id, weight)."""
    counts = mentions.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    raised = F.least(F.lit(ceiling), F.coalesce("weight", F.lit(0.0)) + F.lit(step) * F.col("n"))
    return nodes.select("id", "weight").join(counts, "id").select("id", F.round(raised, 6).alias("weight"))


# tasks and projects


def update_tasks(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Patch the fields that are given; a changed content or prompt asks for a new vector."""
    fields = [f for f in ("content", "parent_id", "due_date", "system_prompt") if f in changes.columns]
    text = [f for f in ("content", "system_prompt") if f in fields]
    flags = changes.select("id", F.greatest(*[F.col(f).isNotNull() for f in text], F.lit(False)).alias("needs_embedding"))
    out = _patched(tasks, changes, fields).join(flags, "id", "left")
    return out.withColumn("needs_embedding", F.coalesce("needs_embedding", F.lit(False)))


def set_task_status(tasks: DataFrame, changes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, reflection log rows, rejected) for ``changes(id, status, reason, summary)``.

    Completing or abandoning needs a reason and leaves a log row whose text is the
    summary, or the reason when the summary is missing or looks like JSON.
    """
    status = C.task_status(F.col("status"))
    closing = status.isin("completed", "abandoned")
    no_reason = closing & (C.text_or_empty(F.col("reason")) == "")
    checked = changes.withColumn("closing", closing).withColumn("no_reason", no_reason).withColumn("status", status)
    valid = checked.filter(~F.col("no_reason"))
    summary = C.cut_runes(C.text_or_empty(F.col("summary")), 500)
    usable = (summary != "") & ~summary.startswith("[") & ~summary.startswith("{")
    logs = valid.filter("closing").join(tasks.select("id"), "id", "left_semi").select(
        F.concat(F.lit("reflection-"), F.sha1(F.concat_ws(":", "id", "status", "reason"))).alias("id"),
        F.col("id").alias("task_id"),
        F.when(usable, summary).otherwise(F.col("reason")).alias("content"),
        F.lit("system:task_engine").alias("source"), as_of.alias("ts"),
    )
    rejected = checked.filter("no_reason").select(
        "id", F.lit("reasoning is required when completing or abandoning a task").alias("error")
    )
    return _patched(tasks, valid.select("id", "status"), ["status"]), logs, rejected


def set_project_status(nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed rows (id, metadata), rejected (id, error)) for ``changes(id, status)``."""
    wanted = changes.select("id", F.lower(C.trim_ws(F.col("status"))).alias("status"))
    rows = wanted.join(nodes.select("id", "node_type", "metadata", F.lit(True).alias("found")), "id", "left")
    error = (
        F.when(F.col("found").isNull(), "not found")
        .when(~F.col("node_type").isin("project", "goal"), "not a project or goal")
        .when(
            (F.col("status") != "") & ~F.col("status").isin(V.PROJECT_STATUSES),
            F.concat(F.lit('invalid status "'), F.col("status"), F.lit('" for project/goal')),
        )
    )
    checked = rows.withColumn("error", error)
    with_status = set_json_field(F.col("metadata"), "status", F.col("status"))
    changed = checked.filter(F.col("error").isNull()).select(
        "id", C.normalise_metadata(F.col("node_type"), with_status).alias("metadata")
    )
    return changed, checked.filter(F.col("error").isNotNull()).select("id", "error")


def set_json_field(metadata: Column, key: str, value: Column) -> Column:
    """JSON object text with one string field set; other fields are kept, keys are sorted."""
    quoted = lambda text: F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"^\{.v.:(.*)\}$", 1)
    fields = F.coalesce(
        F.from_json(metadata, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")
    )
    kept = F.transform(
        F.filter(F.map_entries(fields), lambda e: e["key"] != key),
        lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")),
    )
    new = F.struct(F.lit(key).alias("k"), quoted(value).alias("v"))
    body = F.transform(
        F.array_sort(F.array_append(kept, new)), lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])
    )
    return F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))


def archive_line(line: Column) -> Column:
    cut = F.when(F.octet_length(line) > 200, F.concat(C.cut_bytes(line, 197), F.lit("..."))).otherwise(line)
    return F.concat(F.lit("- "), cut)


def append_archive_lines(projects: DataFrame, lines: DataFrame) -> DataFrame:
    """archive_summary of each project after appending ``lines(id, ts, line)`` in time order: (id, metadata).

    The lines of a project are first joined per day, then the days: the summary is one
    text cell by definition, but no task sorts more than a day of lines at a time.
    """
    day = F.col("ts").cast("date")
    stamped = lines.select("id", day.alias("day"), F.struct("ts", archive_line(F.col("line")).alias("line")).alias("l"))
    per_day = stamped.groupBy("id", "day").agg(F.array_sort(F.collect_list("l")).alias("ls")).select(
        "id", F.struct("day", F.array_join(F.col("ls.line"), "\n").alias("text")).alias("d")
    )
    added = per_day.groupBy("id").agg(F.array_sort(F.collect_list("d")).alias("ds")).select(
        "id", F.array_join(F.col("ds.text"), "\n").alias("added")
    )
    current = C.metadata_string(F.col("metadata"), "archive_summary")
    summary = F.concat_ws("\n", current, F.col("added"))
    return projects.join(added, "id").select("id", set_json_field(F.col("metadata"), "archive_summary", summary).alias("metadata"))


def migrate_metadata(nodes: DataFrame) -> DataFrame:
    """Rows whose metadata changes when a top-level archive summary moves in and fields are normalised: (id, metadata)."""
    project = F.col("node_type").isin("project", "goal")
    moved = C.text_or_empty(F.col("archive_summary")) != ""
    current = C.metadata_string(F.col("metadata"), "archive_summary")
    merged = set_json_field(F.col("metadata"), "archive_summary", F.concat_ws("\n", "archive_summary", current))
    body = F.when(project & moved, merged).otherwise(
        F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")).otherwise("{}")
    )
    new = C.normalise_metadata(F.col("node_type"), body)
    registered = F.col("node_type").isin(list(C.REGISTRY))
    return (
        nodes.filter(registered)
        .withColumn("new", new)
        .filter((F.col("new") != C.text_or_empty(F.col("metadata"))) | moved)
        .select("id", F.col("new").alias("metadata"))
    )


# questions and queries


def record_asked(questions: DataFrame, asked: DataFrame) -> DataFrame:
    """ask_count and last_asked after ``asked(id, ts)``."""
    seen = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))
    return questions.join(seen, "id", "left").select(
        "id", (F.col("ask_count") + F.coalesce("n", F.lit(0))).alias("ask_count"),
        F.coalesce("at", "last_asked").alias("last_asked"),
    )


def resolve_questions(
    questions: DataFrame, answers: DataFrame, labels: tuple[str, str] = DEFAULT_LABELS, source: str = V.ANSWER_SOURCE
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(resolved questions, new facts, new log rows, new tasks) for ``answers(id, answer, ts)``.

    Onboarding answers become identity facts and the owner's name; gap answers become
    a log row "<asked>: question / <responded>: answer" of ``source``; a proposal that is
    confirmed becomes a pending task with the text of the proposal's context.
    """
    rows = questions.select("id", "question", "kind", "context").join(answers, "id")
    resolved = rows.select("id", "kind", F.col("ts").alias("resolved"), "answer")
    told = F.col("answer") != ""
    facts = rows.filter((F.col("kind") == "onboarding") & told).select(
        F.concat(F.lit("fact-"), "id").alias("id"), F.col("answer").alias("content"),
        F.lit("user_identity").alias("node_type"), F.lit("selfmodel").alias("domain"), F.lit(1.0).alias("weight"), "ts",
    )
    text = F.concat(F.lit(f"{labels[0]}: "), "question", F.lit(f"\n{labels[1]}: "), "answer")
    logs = rows.filter((F.col("kind") == "gap") & told).select(
        F.concat(F.lit("answer-"), "id").alias("id"), text.alias("content"), F.lit(source).alias("source"), "ts"
    )
    confirmed = (F.col("kind") == "task_proposal") & told & C.affirmative(F.col("answer")) & (C.text_or_empty(F.col("context")) != "")
    tasks = rows.filter(confirmed).select(
        F.concat(F.lit("task-"), "id").alias("id"), C.trim_ws(F.col("context")).alias("content"), F.lit("pending").alias("status"), "ts"
    )
    return resolved, facts, logs, tasks


def insert_questions(candidates: DataFrame, existing: DataFrame, as_of: Column, **opts) -> DataFrame:
    """New question rows: semantic duplicates of existing ones dropped, defaults filled in."""
    kept = semantic_anti_join(candidates, existing, **opts)
    return kept.select(
        F.coalesce("qid", F.concat(F.lit("pq-"), F.sha1("question"))).alias("id"), "question", "kind", "context",
        F.coalesce("created", as_of).alias("created"), F.lit(None).cast("timestamp_ntz").alias("resolved"),
        F.lit("").alias("answer"), F.lit(0).alias("ask_count"), F.lit(None).cast("timestamp_ntz").alias("last_asked"),
        F.lit(V.WEIGHTS["question"]).alias("weight"),
    )


def save_queries(queries: DataFrame) -> DataFrame:
    """Gap answers get the gap note unless it is there already."""
    noted = F.contains(F.lower("answer"), F.lit(V.GAP_NOTE_MARK))
    answer = F.when(F.col("is_gap") & ~noted, F.concat("answer", F.lit("\n\n" + V.GAP_NOTE))).otherwise(F.col("answer"))
    return queries.withColumn("answer", answer)


def extend_ontology(stored: DataFrame, proposals: DataFrame) -> DataFrame:
    """Allowed predicates after NEW: proposals; an empty list starts from the defaults."""
    spark = stored.sparkSession
    defaults = spark.createDataFrame([(p,) for p in V.PREDICATES], "predicate string")
    current = defaults if stored.isEmpty() else stored.select("predicate")
    new = proposals.select(C.proposed_predicate(F.col("predicate")).alias("predicate")).filter(F.col("predicate").isNotNull())
    return current.unionByName(new).distinct()


def owner_identity(names: DataFrame) -> DataFrame:
    """Latest non-empty name per owner(owner, name, ts)."""
    rows = names.withColumn("name", C.trim_ws(F.col("name"))).filter(F.col("name") != "")
    return rows.groupBy("owner").agg(F.max_by("name", F.struct("ts", "name")).alias("name"))


# vectors


def backfill_embeddings(entries: DataFrame, embed, limit: int | None = None, window: int | None = None) -> DataFrame:
    """Vectors (id, embedding) for rows without one; oldest first when limited."""
    rows = entries
    if window:
        rows = rows.orderBy("ts", "id").limit(window)
    rows = rows.filter(F.col("embedding").isNull() & (C.text_or_empty(F.col("content")) != ""))
    if limit:
        rows = rows.orderBy("ts", "id").limit(limit)
    done = embed(rows.select("id", F.col("content").alias("text")))
    return done.filter(F.col("embedding").isNotNull()).select("id", "embedding")


def attach_media_vectors(media: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """(vectors, rejected ids) for ``media(id, bytes)``; empty bytes are rejected."""
    empty = F.coalesce(F.octet_length("bytes"), F.lit(0)) == 0
    return embed(media.filter(~empty)).select("id", "embedding"), media.filter(empty).select("id")
