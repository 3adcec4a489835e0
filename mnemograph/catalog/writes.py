"""Named queries: table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph import schema as V
from mnemograph.catalog.graphs import AS_OF_SQL, DECAYED
from mnemograph.catalog.registry import query
from mnemograph.catalog.relations import REPLAYED, knn_sql, long
from mnemograph.catalog.texts import NORMALISED
from mnemograph.functions import columns as C, model
from mnemograph.operators import merge
from mnemograph.plans.search import knowledge
from mnemograph.session import new_path, stage
from mnemograph.sources import media
from mnemograph.sources.versioned import Versioned
from mnemograph.sources.views import AS_OF, Views, ntz, shifted


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), column)


@query(
    "append_entries",
    """SELECT id, source, CAST(ts AS VARCHAR) AS ts, '' AS error FROM v_entries
       UNION ALL SELECT 'new-' || conv_id || '-' || turn, role, CASE WHEN turn % 2 = 0 THEN '2024-02-01 00:00:00' ELSE '2024-01-31 00:00:00' END, '' FROM conversations WHERE role <> 'system' AND text <> ''
       UNION ALL SELECT 'new-' || conv_id || '-' || turn, NULL, NULL, CASE WHEN text = '' THEN 'content is required' ELSE 'source is required' END FROM conversations WHERE role = 'system' OR text = ''""",
)
def append_entries(v: Views):
    new = v.table("conversations").select(
        F.concat_ws("-", F.lit("new"), "conv_id", "turn").alias("id"), F.col("text").alias("content"),
        F.when(F.col("role") != "system", F.col("role")).otherwise("").alias("source"),
        F.when(F.col("turn") % 2 == 1, ntz("2024-01-31 00:00:00")).alias("ts"), F.lit(None).cast("string").alias("image_url"),
    )
    accepted, rejected = merge.append_entries(new, ntz(AS_OF))
    both = v.entries.select("id", "source", "ts").unionByName(accepted.select("id", "source", "ts"))
    good = both.select("id", "source", F.col("ts").cast("string").alias("ts"), F.lit("").alias("error"))
    none = F.lit(None).cast("string")
    return good.unionByName(rejected.select("id", none.alias("source"), none.alias("ts"), "error"))


@query(
    "update_entries",
    """SELECT id, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || quality ELSE content END AS content, CASE WHEN toxic = 1 THEN 'audio-' || l.doc_id END AS audio_url
       FROM v_entries LEFT JOIN labels l ON id = 'log-' || l.doc_id""",
)
def update_entries(v: Views):
    changes = v.table("labels").select(
        key("log-", "doc_id").alias("id"), F.concat(F.lit("quality "), "quality").alias("content"),
        F.when(F.col("toxic") == 1, key("audio-", "doc_id")).alias("audio_url"),
    )
    return merge.update_entries(v.entries, changes).select("id", "content", "audio_url")


@query("delete_by_ids", "SELECT id, source FROM v_entries WHERE id NOT IN (SELECT 'log-' || doc_id FROM labels)")
def delete_by_ids(v: Views):
    return merge.delete_by_ids(v.entries, v.table("labels").select(key("log-", "doc_id").alias("id"))).select("id", "source")


@query(
    "delete_where",
    """SELECT id, source, 0 AS n FROM v_entries WHERE source <> 'src3' AND NOT contains(content, 'Ent')
       UNION ALL SELECT '', '', count(*) FROM v_entries WHERE source = 'src3' OR contains(content, 'Ent')""",
)
def delete_where(v: Views):
    kept = merge.delete_where(v.entries, "src3", "Ent").select("id", "source", F.lit(0).cast("bigint").alias("n"))
    count = merge.delete_where(v.entries, "src3", "Ent", dry_run=True)
    return kept.unionByName(count.select(F.lit("").alias("id"), F.lit("").alias("source"), "n"))


@query(
    "publish_versions",
    """WITH p AS (SELECT 'node-' || (user_id % (SELECT count(*) FROM embeddings)) AS id, count(*) AS c FROM events GROUP BY 1)
       SELECT 0 AS version, id, node_type, weight FROM v_nodes
       UNION ALL SELECT 1, id, node_type, CASE WHEN node_type IN ('project', 'goal') THEN round(least(1.0, weight + 0.05 * coalesce(c, 0)), 6) ELSE weight END
       FROM v_nodes LEFT JOIN p USING (id) WHERE node_type <> 'tool'""",
)
def publish_versions(v: Views):
    """Nodes by type: a second version raises projects and goals and drops tools; both versions are read."""
    table = Versioned(v.spark, new_path(v.spark, "nodes"), "id string, weight double, node_type string", "node_type")
    table.publish(v.nodes.select("id", "weight", "node_type"), 0)
    first = table.read()
    mentions = v.table("events").select(F.concat(F.lit("node-"), F.col("user_id") % v.n_vectors).alias("id"))
    part = table.read(only=["project", "goal"])
    raised = merge.boost(part, mentions).withColumnRenamed("weight", "raised")
    changed = part.join(raised, "id", "left").select("id", F.coalesce("raised", "weight").alias("weight"), "node_type")
    table.publish(changed, 1, replaced=["tool"])
    rows = lambda df, n: df.select(F.lit(n).alias("version"), "id", "node_type", "weight")
    return rows(first, 0).unionByName(rows(table.read(), 1))


@query(
    "strip_done",
    r"""SELECT id, content FROM (SELECT id, old, CASE WHEN regexp_matches(lower(t), 'done\.?$') THEN regexp_replace(regexp_replace(t, '(?i)done\.?$', ''), '^\s+|\s+$', '', 'g') ELSE old END AS content
         FROM (SELECT id, old, regexp_replace(old, '^\s+|\s+$', '', 'g') AS t FROM (
           SELECT id, CASE right(id, 1) WHEN '1' THEN content || ' Done. ' WHEN '2' THEN content || chr(10) || 'DONE' WHEN '3' THEN 'done' ELSE content END AS old FROM v_entries)))
       WHERE content <> old""",
)
def strip_done(v: Views):
    last = F.right("id", F.lit(1))
    content = (
        F.when(last == "1", F.concat("content", F.lit(" Done. "))).when(last == "2", F.concat("content", F.lit("\nDONE")))
        .when(last == "3", "done").otherwise(F.col("content"))
    )
    return merge.strip_done(v.entries.withColumn("content", content))


@query(
    "upsert_facts",
    f"""WITH near AS ({knn_sql(1, queries='v_near', low=0.75)}),
        p AS (SELECT q.qid, q.node_type, n.id AS old_id, coalesce(d.text, '') AS content,
                CASE WHEN n.id IS NOT NULL AND regexp_replace(regexp_replace(lower(coalesce(d.text, '')), '\\s+', ' ', 'g'), '^ | $', '', 'g') = regexp_replace(regexp_replace(lower(n.content), '\\s+', ' ', 'g'), '^ | $', '', 'g') THEN 'update' ELSE 'insert' END AS action
              FROM v_near q LEFT JOIN documents d ON doc_id = q.vec_id LEFT JOIN near ON near.qid = q.qid LEFT JOIN v_nodes n ON n.id = near.id)
        SELECT CASE WHEN action = 'update' THEN old_id ELSE qid END AS id, arg_max(qid, qid) AS qid, arg_max(action, qid) AS action, arg_max(node_type, qid) AS node_type FROM p GROUP BY 1""",
)
def upsert_facts(v: Views):
    docs = v.table("documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    facts = v.near.join(docs, "vec_id", "left").select(
        "qid", F.coalesce("content", F.lit("")).alias("content"), "node_type", F.lit(None).cast("string").alias("metadata"),
        ntz(AS_OF).alias("ts"), "embedding",
    )
    return merge.upsert_facts(facts, v.nodes).select("id", "qid", "action", "node_type")


@query(
    "ensure_nodes",
    f"""WITH m AS (SELECT DISTINCT node_type, ['known ', 'other ', 'entity_missing '][vec_id % 3 + 1] || vec_id AS name, vec_id FROM v_near),
        near AS ({knn_sql(1, "n.node_type = q.node_type", "(SELECT m.name AS qid, q.node_type, q.embedding FROM m JOIN v_near q USING (vec_id))", low=0.85)})
        SELECT m.name, m.node_type, CASE WHEN near.id IS NOT NULL THEN near.id WHEN vec_id % 3 = 0 THEN 'known-' || vec_id
            WHEN vec_id % 3 = 2 THEN NULL ELSE 'entity_' || sha1(m.node_type || ':' || m.name) END AS id,
          CASE WHEN near.id IS NOT NULL THEN 'similar' WHEN vec_id % 3 = 0 THEN 'name' WHEN vec_id % 3 = 2 THEN 'missing' ELSE 'new' END AS how
        FROM m LEFT JOIN near ON near.qid = m.name""",
)
def ensure_nodes(v: Views):
    vec = F.col("vec_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, ["known ", "other ", "entity_missing "])), (vec % 3 + 1).cast("int")), vec)
    mentions = v.near.select(F.concat(F.lit(" "), name).alias("name"), "node_type", F.lit("log-1").alias("entry_id"))
    vectors = v.near.select(name.alias("name"), "embedding")
    known = v.nodes.select("id", "node_type", F.lit("").alias("content"), "embedding").unionByName(
        v.near.filter(vec % 3 == 0).select(
            key("known-", "vec_id").alias("id"), F.lit("other").alias("node_type"), F.concat(F.lit("Known "), vec).alias("content"),
            F.lit(None).cast("array<float>").alias("embedding"),
        )
    )
    return merge.ensure_nodes(mentions, known, vectors).drop("error")


@query(
    "upsert_relationships",
    """SELECT id, subject_id, predicate, object_id, CAST(max(ts) AS VARCHAR) AS ts, bool_and(is_new) AS is_new FROM (
         SELECT id, subject_id, predicate, object_id, CASE WHEN predicate = 'lives_in' AND subject_id IN (SELECT subject_id FROM v_observations) THEN NULL ELSE ts END AS ts, false AS is_new FROM v_relationships
         UNION ALL SELECT 'rel_' || sha1(subject_id || ':lives_in:' || object_id), subject_id, 'lives_in', object_id, ts, true FROM v_observations) GROUP BY ALL""",
)
def upsert_relationships(v: Views):
    no_links = v.relationships.select("id", F.lit("").alias("target_id")).limit(0)
    merged, _ = merge.upsert_relationships(v.observations, v.relationships, no_links, ntz(AS_OF))
    return merged.select("id", "subject_id", "predicate", "object_id", F.col("ts").cast("string").alias("ts"), "is_new")


@query(
    "relationship_evidence",
    """SELECT DISTINCT 'rel_' || sha1(subject_id || ':lives_in:' || object_id) AS id, entry_id AS target_id FROM v_observations
       UNION SELECT id, object_id FROM v_relationships WHERE predicate = 'owns'""",
)
def relationship_evidence(v: Views):
    stored = v.relationships.filter(F.col("predicate") == "owns").select("id", F.col("object_id").alias("target_id"))
    return merge.upsert_relationships(v.observations, v.relationships, stored, ntz(AS_OF))[1]


@query(
    "link_union",
    """SELECT subject_id AS id, 'rel_' || sha1(subject_id || ':lives_in:' || object_id) AS target_id FROM v_observations
       UNION SELECT object_id, id FROM v_relationships""",
)
def link_union(v: Views):
    rel = C.relationship_id(F.col("subject_id"), F.lit("lives_in"), F.col("object_id"))
    added = v.observations.select(F.col("subject_id").alias("id"), rel.alias("target_id"))
    return merge.link_union(v.relationships.select(F.col("object_id").alias("id"), F.col("id").alias("target_id")), added)


@query(
    "ids_add_remove",
    """(SELECT id, 'entry-' || (length(id) % 3) AS target_id FROM v_tasks UNION SELECT id, entry_id FROM v_tasks)
       EXCEPT SELECT id, entry_id FROM v_tasks WHERE status = 'completed'""",
)
def ids_add_remove(v: Views):
    t = v.tasks
    current = t.select("id", F.concat(F.lit("entry-"), F.length("id") % 3).alias("target_id"))
    entry = F.col("entry_id").alias("target_id")
    return merge.ids_add_remove(current, t.select("id", entry), t.filter(F.col("status") == "completed").select("id", entry))


@query(
    "update_tasks",
    """SELECT t.id, CASE WHEN l_orderkey IS NOT NULL AND n % 2 = 0 THEN 'items ' || n ELSE content END AS content,
         CASE WHEN l_orderkey IS NOT NULL THEN d END AS due_date, l_orderkey IS NOT NULL AND n % 2 = 0 AS needs_embedding
       FROM v_tasks t LEFT JOIN (SELECT l_orderkey, count(*) AS n, strftime(max(l_shipdate), '%Y-%m-%d') AS d FROM lineitem GROUP BY 1) ON t.id = 'task-' || l_orderkey""",
)
def update_tasks(v: Views):
    changes = v.table("lineitem").groupBy(key("task-", "l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_shipdate").cast("date").cast("string").alias("due_date")
    )
    changes = changes.withColumn("content", F.when(F.col("n") % 2 == 0, F.concat(F.lit("items "), "n"))).drop("n")
    return merge.update_tasks(v.tasks, changes).select("id", "content", "due_date", "needs_embedding")


@query(
    "set_task_status",
    """WITH c AS (SELECT 'task-' || o_orderkey AS id, ['completed','abandoned','active','odd'][o_orderkey % 4 + 1] AS s,
              CASE WHEN o_orderkey % 8 = 1 THEN '' ELSE 'reason ' || o_orderpriority END AS reason, CASE WHEN o_orderkey % 3 = 0 THEN '[ 1 ]' ELSE 'did it' END AS summary, o_orderkey FROM orders),
       v AS (SELECT *, CASE WHEN s = 'odd' THEN 'pending' ELSE s END AS status, s IN ('completed', 'abandoned') AS closing FROM c)
       SELECT 'task' AS part, t.id, CASE WHEN closing AND reason = '' THEN t.status ELSE v.status END AS text FROM v_tasks t JOIN v USING (id)
       UNION ALL SELECT 'log', id, CASE WHEN summary LIKE '[%' THEN reason ELSE summary END FROM v WHERE closing AND reason <> ''
       UNION ALL SELECT 'rejected', id, 'reasoning is required when completing or abandoning a task' FROM v WHERE closing AND reason = ''""",
)
def set_task_status(v: Views):
    o = F.col("o_orderkey")
    changes = v.table("orders").select(
        key("task-", "o_orderkey").alias("id"),
        F.element_at(F.array(*map(F.lit, ["completed", "abandoned", "active", "odd"])), (o % 4 + 1).cast("int")).alias("status"),
        F.when(o % 8 == 1, "").otherwise(F.concat(F.lit("reason "), "o_orderpriority")).alias("reason"),
        F.when(o % 3 == 0, "[ 1 ]").otherwise("did it").alias("summary"),
    )
    tasks, logs, rejected = merge.set_task_status(v.tasks, changes, ntz(AS_OF))
    row = lambda df, part, i, text: df.select(F.lit(part).alias("part"), F.col(i).alias("id"), F.col(text).alias("text"))
    return row(tasks, "task", "id", "status").unionByName(row(logs, "log", "task_id", "content")).unionByName(row(rejected, "rejected", "id", "error"))


@query(
    "set_project_status",
    """WITH c AS (SELECT id, node_type, ['done','Active ','bogus'][vec_id % 3 + 1] AS s, lower(trim(['done','Active ','bogus'][vec_id % 3 + 1])) AS status FROM v_nodes)
       SELECT id, CASE WHEN node_type IN ('project', 'goal') AND status <> 'bogus' THEN '{"status":"' || status || '"}' END AS metadata,
         CASE WHEN node_type NOT IN ('project', 'goal') THEN 'not a project or goal' WHEN status = 'bogus' THEN 'invalid status "bogus" for project/goal' END AS error FROM c""",
)
def set_project_status(v: Views):
    status = F.element_at(F.array(*map(F.lit, ["done", "Active ", "bogus"])), (F.col("vec_id") % 3 + 1).cast("int"))
    changed, rejected = merge.set_project_status(v.nodes, v.nodes.select("id", status.alias("status")))
    return changed.unionByName(rejected, allowMissingColumns=True)


@query(
    "append_archive_line",
    """SELECT n.id, '{"archive_summary":"' || string_agg('- ' || l.line, '\\n' ORDER BY l.ts, l.line) || '","status":"' || json_extract_string(metadata, '$.status') || '"}' AS metadata
       FROM v_nodes n JOIN (SELECT 'node-' || (o_custkey % (SELECT count(*) FROM embeddings)) AS id, o_orderdate AS ts, 'order ' || o_orderkey || ' ' || o_orderpriority AS line FROM orders) l ON l.id = n.id
       WHERE node_type IN ('project', 'goal') GROUP BY n.id, metadata""",
)
def append_archive_line(v: Views):
    lines = v.table("orders").select(
        F.concat(F.lit("node-"), F.col("o_custkey") % v.n_vectors).alias("id"), F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("order "), "o_orderkey", F.lit(" "), "o_orderpriority").alias("line"),
    )
    projects = v.nodes.filter(F.col("node_type").isin("project", "goal"))
    return merge.append_archive_lines(projects, lines)


@query(
    "record_asked",
    """SELECT id, CAST(ask_count + coalesce(n, 0) AS BIGINT) AS ask_count, CAST(coalesce(asked_at, last_asked) AS VARCHAR) AS last_asked FROM v_questions
       LEFT JOIN (SELECT 'pq-' || conv_id || '-' || (turn - 1) AS id, count(*) AS n, max(TIMESTAMP '2024-01-20' + to_minutes(turn)) AS asked_at FROM conversations WHERE role = 'assistant' GROUP BY 1) USING (id)""",
)
def record_asked(v: Views):
    asked = v.table("conversations").filter(F.col("role") == "assistant").select(
        F.concat(F.lit("pq-"), "conv_id", F.lit("-"), F.col("turn") - 1).alias("id"), shifted("MINUTE", "turn", "2024-01-20 00:00:00").alias("ts")
    )
    return merge.record_asked(v.questions, asked).withColumn("last_asked", F.col("last_asked").cast("string"))


@query(
    "resolve_questions",
    """WITH q AS (SELECT id, question, context, CASE WHEN kind = 'contradiction' THEN 'onboarding' ELSE kind END AS kind,
                CASE WHEN kind = 'task_proposal' AND ask_count % 2 = 0 THEN 'Yes ' || answer ELSE answer END AS answer, kind = 'task_proposal' AND ask_count % 2 = 0 AS yes
              FROM v_questions WHERE answer <> '')
       SELECT 'resolved' AS part, id, answer AS text FROM q UNION ALL SELECT 'fact', 'fact-' || id, answer FROM q WHERE kind = 'onboarding'
       UNION ALL SELECT 'entry', 'answer-' || id, 'Assistant asked: ' || question || chr(10) || 'User responded: ' || answer FROM q WHERE kind = 'gap'
       UNION ALL SELECT 'task', 'task-' || id, context FROM q
       WHERE kind = 'task_proposal' AND (yes OR regexp_matches(lower(trim(answer)), '^(yes|y|yeah|yep|yup|sure|ok|okay|do it|create it|go ahead|please|absolutely)( |$)'))""",
)
def resolve_questions(v: Views):
    q = v.questions
    open_q = q.withColumn("kind", F.when(F.col("kind") == "contradiction", "onboarding").otherwise(F.col("kind"))).drop("answer")
    yes = (F.col("kind") == "task_proposal") & (F.col("ask_count") % 2 == 0)
    said = F.when(yes, F.concat(F.lit("Yes "), "answer")).otherwise(F.col("answer"))
    answers = q.filter(F.col("answer") != "").select("id", said.alias("answer"), F.col("resolved").alias("ts"))
    resolved, facts, logs, tasks = merge.resolve_questions(open_q, answers)
    row = lambda df, part, text: df.select(F.lit(part).alias("part"), "id", F.col(text).alias("text"))
    return row(resolved, "resolved", "answer").unionByName(row(facts, "fact", "content")).unionByName(row(logs, "entry", "content")).unionByName(row(tasks, "task", "content"))


@query(
    "insert_questions",
    """SELECT qid AS id, 'Question ' || vec_id AS question, 'gap' AS kind FROM v_near q WHERE NOT EXISTS (
         SELECT 1 FROM v_questions x JOIN embeddings n ON n.vec_id = x.vec_id WHERE round(list_cosine_similarity(q.embedding, n.embedding::DOUBLE[]), 6) >= 0.85)""",
)
def insert_questions(v: Views):
    existing = v.questions.join(v.table("embeddings"), "vec_id").select("id", "embedding")
    candidates = v.near.select(
        "qid", F.concat(F.lit("Question "), "vec_id").alias("question"), F.lit("gap").alias("kind"), F.lit("").alias("context"),
        F.lit(None).cast("timestamp_ntz").alias("created"), "embedding",
    )
    return merge.insert_questions(candidates, existing, ntz(AS_OF)).select("id", "question", "kind")


@query(
    "save_queries",
    """SELECT id, CASE WHEN is_gap AND NOT contains(lower(answer), 'looked for this but found nothing') THEN answer || chr(10) || chr(10) || '(I looked for this but found nothing.)' ELSE answer END AS answer FROM v_queries""",
)
def save_queries(v: Views):
    return merge.save_queries(v.queries).select("id", "answer")


@query(
    "boost_significance",
    """SELECT n.id, round(least(1.0, weight + 0.05 * c), 6) AS weight FROM v_nodes n JOIN (
         SELECT 'node-' || (user_id % (SELECT count(*) FROM embeddings)) AS id, count(*) AS c FROM events GROUP BY 1) USING (id)""",
)
def boost_significance(v: Views):
    mentions = v.table("events").select(F.concat(F.lit("node-"), F.col("user_id") % v.n_vectors).alias("id"))
    return merge.boost(v.nodes, mentions)


@query(
    "hot_edges",
    f"""SELECT object_id, slot, id, score FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, ts DESC, id) AS slot FROM (
          SELECT object_id, id, ts, round({DECAYED}, 6) AS score FROM v_relationships)) WHERE slot <= 20""",
)
def hot_edges(v: Views):
    return long(merge.hot_edges(v.relationships, ntz(AS_OF)), "slot")


@query(
    "extend_ontology",
    """SELECT unnest(['works_at','prefers','owns','lives_in','located_in','collaborates_with','reports_to','manages']) AS predicate
       UNION SELECT lower(event_type) || '_of_' || (user_id % 3) FROM events WHERE event_type <> 'view'""",
)
def extend_ontology(v: Views):
    head = F.when(F.col("event_type") != "view", "NEW:").otherwise("")
    text = F.concat(head, F.initcap("event_type"), F.lit(" of-"), F.col("user_id") % 3)
    stored = v.table("events").select(F.lit("").alias("predicate")).limit(0)
    return merge.extend_ontology(stored, v.table("events").select(text.alias("predicate")))


@query(
    "owner_identity",
    """SELECT user_id AS owner, arg_max(event_type || ' ' || event_id, ts) AS name FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def owner_identity(v: Views):
    name = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "), "event_id"))
    return merge.owner_identity(v.table("events").select(F.col("user_id").alias("owner"), name.alias("name"), "ts"))


@query(
    "migrate_metadata",
    f"""SELECT id, CASE WHEN node_type IN ('project', 'goal') AND vec_id % 2 = 0
          THEN '{{"archive_summary":"old ' || vec_id || '","status":"' || json_extract_string(metadata, '$.status') || '"}}' ELSE {NORMALISED} END AS metadata
        FROM v_nodes WHERE node_type <> 'log'""",
)
def migrate_metadata(v: Views):
    archive = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("old "), "vec_id"))
    return merge.migrate_metadata(v.nodes.withColumn("archive_summary", archive))


@query(
    "backfill_embeddings",
    """SELECT id, 64 AS dim FROM v_entries WHERE regexp_replace(content, '\\s', '', 'g') <> '' AND id NOT IN (SELECT 'log-' || vec_id FROM embeddings)""",
)
def backfill_embeddings(v: Views):
    vectors = v.table("embeddings").select(key("log-", "vec_id").alias("id"), "embedding")
    entries = v.entries.join(vectors, "id", "left")
    out = merge.backfill_embeddings(entries, lambda rows: model.embed_column(rows, model.hashed_words()))
    return out.select("id", F.size("embedding").alias("dim"))


@query(
    "attach_media_vector",
    "SELECT 'page-' || page_id AS id, CASE WHEN page_id % 5 > 0 AND html <> '' THEN 64 ELSE 0 END AS dim FROM pages",
)
def attach_media_vector(v: Views):
    media = v.table("pages").select(
        key("page-", "page_id").alias("id"), F.when(F.col("page_id") % 5 > 0, F.col("html")).otherwise("").cast("binary").alias("bytes")
    )
    embed = lambda rows: model.embed_column(rows.select("id", F.base64("bytes").alias("text")), model.hashed_words())
    vectors, rejected = merge.attach_media_vectors(media, embed)
    return vectors.select("id", F.size("embedding").alias("dim")).unionByName(rejected.select("id", F.lit(0).alias("dim")))


@query(
    "attach_media_files",
    """SELECT id, strlen(content) + 1 AS size, CASE WHEN image_url <> '' THEN 64 END AS dim FROM v_entries WHERE image_url <> '' AND content <> ''
       UNION ALL SELECT 'missing-' || id, NULL, NULL FROM v_entries WHERE image_url = ''""",
)
def attach_media_files(v: Views):
    """The texts of entries with an image stand for its bytes, one file each; entries without one have no file."""
    folder = new_path(v.spark, "media")
    v.entries.filter("image_url <> '' AND content <> ''").select(F.col("id").alias("entry"), F.regexp_replace("content", "\n", " ").alias("value")).write.partitionBy("entry").text(folder)
    wanted = v.entries.filter("image_url = '' OR content <> ''").select(F.when(F.col("image_url") != "", F.col("id")).otherwise(F.concat(F.lit("missing-"), "id")).alias("id"))
    files = media.list_media(v.spark, folder, r"entry=([^/]+)/")
    read = stage(media.read_media(wanted, files, folder), "media")
    embed = lambda rows: model.embed_column(rows.select("id", F.base64("bytes").alias("text")), model.hashed_words())
    vectors, _ = merge.attach_media_vectors(read, embed)
    return read.select("id", "size").join(vectors.select("id", F.size("embedding").alias("dim")), "id", "left")


@query(
    "create_tasks",
    "WITH RECURSIVE "
    + REPLAYED.format(key="user_id % 5, event_type", source="SELECT 'new-' || event_id AS id, * FROM events")
    + f""", t AS (SELECT 'task-' || vec_id AS id, vec_id % 3 AS s, embedding FROM embeddings),
       h AS ({knn_sql(1, "n.s < 2", "v_near", "t", 1 - V.TASK_DISTANCE)}),
       c AS (SELECT 'new-' || event_id AS id, h.id AS similar_id
             FROM events JOIN v_near q ON q.vec_id = event_id % (SELECT count(*) FROM embeddings) LEFT JOIN h ON h.qid = q.qid)
       SELECT r.id, CASE WHEN r.created_id <> r.id THEN 'repeat' WHEN c.similar_id IS NOT NULL THEN 'similar' ELSE 'create' END AS action,
              CASE WHEN r.created_id <> r.id THEN coalesce(f.similar_id, r.created_id) ELSE coalesce(c.similar_id, r.id) END AS surviving_id
       FROM replayed r JOIN c ON c.id = r.id LEFT JOIN c f ON f.id = r.created_id""",
)
def create_tasks(v: Views):
    """New tasks from events: exact repeats within the window first, then close open tasks, then inserts."""
    from mnemograph.operators.dedup import create_tasks as create

    n = v.n_vectors
    vectors = v.near.select("vec_id", "embedding")
    new = v.table("events").select(
        key("new-", "event_id").alias("id"), F.concat(F.lit("entry-"), F.col("user_id") % 5).alias("entry_id"),
        F.col("event_type").alias("content"), F.lit("pending").alias("status"), "ts", (F.col("event_id") % n).alias("vec_id"),
    ).join(vectors, "vec_id")
    status = F.element_at(F.array(*map(F.lit, ["pending", "active", "completed"])), (F.col("vec_id") % 3 + 1).cast("int"))
    open_tasks = v.table("embeddings").select(key("task-", "vec_id").alias("id"), status.alias("status"), "embedding")
    return create(new, open_tasks).select("id", "action", "surviving_id")
