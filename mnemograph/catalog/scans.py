"""Named queries: scans, sources, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.catalog.registry import query
from mnemograph.functions import columns as C
from mnemograph.operators import filters, joins
from mnemograph.operators.skew import top_rows
from mnemograph.session import new_path
from mnemograph.sources import logs
from mnemograph.sources.views import AS_OF, Views, ntz
from mnemograph.streaming.replay import ReplayJob, follow_log, read_lines

LEN = F.length
ENTRY = "SELECT id, source, CAST(ts AS VARCHAR) AS ts, length(content) AS n_chars"


def brief(df, *more):
    return df.select("id", "source", F.col("ts").cast("string").alias("ts"), F.length("content").cast("bigint").alias("n_chars"), *more)


@query(
    "entry_scan",
    f"""{ENTRY} FROM v_entries WHERE source <> 'src1' UNION ALL
        SELECT 'broken ' || id, NULL, NULL, NULL FROM v_entries WHERE image_url <> ''""",
)
def entry_scan(v: Views):
    """A stored log of JSON lines, some of them broken: decoded rows, and the rejected lines as ids."""
    path = new_path(v.spark, "log")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    lines = v.entries.select(F.to_json(F.struct("id", "node_type", "content", "source", stamp)).alias("value"))
    broken = v.entries.filter("image_url <> ''").select(F.concat(F.lit("broken "), "id").alias("value"))
    lines.unionByName(broken).write.text(path)
    good, bad = logs.read_json_log(v.spark, path)
    rows = brief(logs.with_time(good).filter(F.col("source") != "src1"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:]]
    return rows.unionByName(bad.select(F.col("line").alias("id"), *nothing))


@query("get_by_ids", "SELECT id, node_type, weight FROM v_nodes WHERE vec_id IN (SELECT doc_id FROM labels)")
def get_by_ids(v: Views):
    ids = v.table("labels").select(F.concat(F.lit("node-"), "doc_id").alias("id"))
    return filters.get_by_ids(v.nodes, ids).select("id", "node_type", "weight")


@query("list_nodes", "SELECT id, node_type FROM v_nodes WHERE node_type <> 'log' ORDER BY id LIMIT 100")
def list_nodes(v: Views):
    return logs.list_nodes(v.nodes, 100).select("id", "node_type")


@query("export_manifest", f"{ENTRY}, image_url FROM v_entries")
def export_manifest(v: Views):
    path = new_path(v.spark, "manifest")
    logs.export_manifest(v.entries, path)
    good, _ = logs.read_manifest(v.spark, path)
    return brief(good, "image_url")


EVEN = "CAST(split_part(id, '-', 2) AS BIGINT) % 2 = 0"
MANIFESTS = f"(SELECT * FROM v_entries UNION ALL SELECT * FROM v_entries WHERE {EVEN})"


@query(
    "replay_manifest",
    f"""{ENTRY} FROM v_entries WHERE content <> '' AND source <> ''
        UNION ALL SELECT 'reject not decodable', NULL, NULL, count(*) FROM {MANIFESTS} WHERE image_url <> '' HAVING count(*) > 0
        UNION ALL SELECT 'reject content is required', NULL, NULL, count(*) FROM {MANIFESTS} WHERE content = '' HAVING count(*) > 0
        UNION ALL SELECT 'reject source is required', NULL, NULL, count(*) FROM {MANIFESTS} WHERE content <> '' AND source = '' HAVING count(*) > 0""",
)
def replay_manifest(v: Views):
    """A first manifest of the entries of even number, then one of all to a second job on the same root, both with broken lines."""
    path, root = new_path(v.spark, "manifests"), new_path(v.spark, "replay")
    number = F.split_part("id", F.lit("-"), F.lit(2)).cast("bigint")
    for name, rows in (("first", v.entries.filter(number % 2 == 0)), ("second", v.entries)):
        logs.export_manifest(rows, f"{path}/{name}")
        rows.filter("image_url <> ''").select(F.concat(F.lit("{broken "), "id").alias("value")).write.mode("append").text(f"{path}/{name}")
        job = ReplayJob(v.spark, root, ntz(AS_OF))
        job.run(read_lines(v.spark, f"{path}/*", per_trigger=8))
    rejects = job.rejected.read().groupBy(F.concat(F.lit("reject "), "reason").alias("id")).agg(F.count("*").alias("n_chars"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source", "ts")]
    return brief(job.entries.read()).unionByName(rejects.select("id", *nothing, "n_chars"))


@query(
    "audit_log_follow",
    """SELECT CAST(ts AS VARCHAR) AS ts, rejected, line FROM (
         SELECT ts, NULL AS rejected, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'LLM_CONTEXT_AUDIT ' || event_id ELSE '[long] LLM_CONTEXT_AUDIT ' || repeat('x', 182) || '...' END
           ELSE '[' || CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END || '] ' || 'LLM_CONTEXT_AUDIT | call ' || event_id || ' trace_id=' || user_id END AS line
         FROM events WHERE event_type IN ('click', 'error', 'signup') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
         UNION ALL SELECT NULL, '{oops ' || event_id, NULL FROM events WHERE event_type = 'view' AND event_id % 3 = 0)""",
)
def audit_log_follow(v: Views):
    """Events as the lines of a structured log, some of them broken, that arrive as files in two halves and are followed from where the first call ended."""
    kind, number = F.col("event_type"), F.col("event_id")
    call = F.concat(F.lit("LLM_CONTEXT_AUDIT | call "), number)
    payload = F.struct(
        F.when(kind == "error", "WARN").alias("level"), F.when(kind == "click", call).when(kind == "purchase", "other").alias("msg"),
        F.when(kind == "error", call).alias("message"), F.col("user_id").cast("string").alias("trace_id"),
    )
    text = F.when(number % 2 == 0, F.concat(F.lit("LLM_CONTEXT_AUDIT "), number)).otherwise(F.concat(F.lit("LLM_CONTEXT_AUDIT "), F.repeat(F.lit("x"), F.lit(500))))
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.when(kind != "signup", payload).alias("jsonPayload"), F.when(kind == "signup", text).alias("textPayload"),
    ))
    broken = (kind == "view") & (number % 3 == 0)
    path, root = new_path(v.spark, "log-in"), new_path(v.spark, "log-followed")
    for half in (0, 1):
        rows = v.table("events").filter(number % 2 == half)
        rows.select(F.when(broken, F.concat(F.lit("{oops "), number)).otherwise(line).alias("value")).write.mode("append").text(path)
        out = follow_log(read_lines(v.spark, path), root, "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    return out.select(F.col("ts").cast("string").alias("ts"), "line", "rejected")


@query(
    "normalise_updates",
    """SELECT event_id AS update_id, event_id * 10 AS message_id, user_id AS chat_id, user_id,
         CASE event_type WHEN 'click' THEN 'said ' || event_type WHEN 'view' THEN 'Photo' WHEN 'error' THEN 'seen ' || event_type
              WHEN 'signup' THEN 'Voice note' ELSE 'Shared location pin' END AS text,
         CASE WHEN event_type IN ('view', 'error') THEN 'large-' || event_id ELSE '' END AS image_file_id,
         CASE WHEN event_type = 'signup' THEN 'voice-' || event_id ELSE '' END AS voice_file_id,
         event_type = 'purchase' AS has_location,
         CASE WHEN event_type = 'purchase' THEN round(value, 2) ELSE 0.0 END AS lat
       FROM events WHERE event_id % 3 <> 2 OR event_id % 2 = 0""",
)
def normalise_updates(v: Views):
    e = v.table("events")
    kind = F.col("event_type")
    files = lambda name: F.struct(F.concat(F.lit(f"{name}-"), "event_id").alias("file_id"))
    message = F.struct(
        (F.col("event_id") * 10).alias("message_id"),
        F.struct(F.col("user_id").alias("id")).alias("chat"),
        F.struct(F.col("user_id").alias("id")).alias("from"),
        F.when(kind == "click", F.concat(F.lit("said "), kind)).alias("text"),
        F.when(kind == "error", F.concat(F.lit("seen "), kind)).alias("caption"),
        F.when(kind.isin("view", "error"), F.array(files("small"), files("large"))).alias("photo"),
        F.when(kind == "signup", files("voice")).alias("voice"),
        F.when(
            kind == "purchase", F.struct(F.round("value", 2).alias("latitude"), F.lit(1.5).alias("longitude"))
        ).alias("location"),
    )
    i = F.col("event_id")
    raw = e.select(
        F.to_json(
            F.struct(
                i.alias("update_id"),
                F.when(i % 3 != 2, message).alias("message"),
                F.when(i % 2 == 0, message).alias("edited_message"),
            )
        ).alias("raw")
    )
    return logs.normalise_updates(raw).drop("lng")


@query(
    "audit_log_scan",
    """SELECT CAST(ts AS VARCHAR) AS ts,
         '[' || CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END || '] '
         || CASE WHEN event_type = 'click' THEN 'LLM_CONTEXT_AUDIT | call ' || event_id ELSE 'event=LLM_CONTEXT_AUDIT' END
         || ' trace_id=' || user_id AS line
       FROM events WHERE event_type IN ('click', 'view', 'error')
         AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'""",
)
def audit_log_scan(v: Views):
    kind = F.col("event_type")
    rows = v.table("events").select(
        "ts",
        F.when(kind == "error", "WARN").otherwise("INFO").alias("level"),
        F.when(kind == "click", F.concat(F.lit("LLM_CONTEXT_AUDIT | call "), "event_id")).when(kind == "signup", "other").alias("msg"),
        F.when(kind.isin("view", "error"), "LLM_CONTEXT_AUDIT").otherwise("OTHER").alias("event"),
        F.col("user_id").cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("path"),
    )
    out = logs.audit_lines(rows, "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    return out.select(F.col("ts").cast("string").alias("ts"), "line")


@query(
    "page_text",
    r"""SELECT page_id, text, length(text) AS n_chars FROM (
         SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
           regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', '', 'gis'), '<style.*?</style>', '', 'gis'), '<[^>]*>', ' ', 'g'),
           '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\s+', ' ', 'g')) AS text FROM pages)""",
)
def page_text(v: Views):
    rows = v.table("pages").select("page_id", C.page_text(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))


@query("entries_recent", f"{ENTRY} FROM v_entries ORDER BY v_entries.ts DESC, id LIMIT 50")
def entries_recent(v: Views):
    return brief(filters.newest(v.entries, 50))


@query("entries_oldest", f"{ENTRY} FROM v_entries ORDER BY v_entries.ts, id LIMIT 50")
def entries_oldest(v: Views):
    return brief(filters.oldest(v.entries, 50))


@query(
    "entries_by_date",
    f"""{ENTRY} FROM v_entries WHERE v_entries.ts >= TIMESTAMP '2024-01-03' AND v_entries.ts < TIMESTAMP '2024-01-11'
        ORDER BY v_entries.ts DESC, id LIMIT 200""",
)
def entries_by_date(v: Views):
    return brief(filters.by_date(v.entries, "2024-01-03", "2024-01-10", 200))


@query(
    "queries_by_date",
    """SELECT id, question, CAST(ts AS VARCHAR) AS ts FROM v_queries
       WHERE v_queries.ts >= TIMESTAMP '2024-01-02' AND v_queries.ts < TIMESTAMP '2024-01-05'
       ORDER BY v_queries.ts DESC, id LIMIT 50""",
)
def queries_by_date(v: Views):
    rows = filters.by_date(v.queries, "2024-01-02", "2024-01-04", 50)
    return rows.select("id", "question", F.col("ts").cast("string").alias("ts"))


@query(
    "entries_since",
    f"{ENTRY} FROM v_entries WHERE v_entries.ts > TIMESTAMP '2024-01-04 12:00:00'",
)
def entries_since(v: Views):
    return brief(filters.since(v.entries, "2024-01-04 12:00:00"))


@query(
    "search_entries",
    f"""{ENTRY} FROM v_entries WHERE contains(lower(content), 'the') AND contains(lower(content), 'er')
        ORDER BY v_entries.ts DESC, id LIMIT 100""",
)
def search_entries(v: Views):
    return brief(filters.search_entries(v.entries, "The er", 100))


@query(
    "search_knowledge",
    """SELECT id, node_type, CAST(ts AS VARCHAR) AS ts FROM v_nodes WHERE node_type <> 'log'
       AND (contains(lower(content), 'the') OR contains(lower(metadata), 'the'))
       AND (contains(lower(content), 'software') OR contains(lower(metadata), 'software'))
       ORDER BY v_nodes.ts DESC, id LIMIT 50""",
)
def search_knowledge(v: Views):
    rows = filters.search_knowledge(v.nodes, "the Software", 50)
    return rows.select("id", "node_type", F.col("ts").cast("string").alias("ts"))


@query(
    "search_queries",
    """SELECT id, question, is_gap FROM v_queries WHERE contains(lower(question), 'de')
       ORDER BY ts DESC, id LIMIT 50""",
)
def search_queries(v: Views):
    return filters.search_entries(v.queries, "de", 50, text="question").select("id", "question", "is_gap")


@query(
    "scan_window",
    f"""{ENTRY} FROM (SELECT * FROM v_entries ORDER BY ts DESC, id LIMIT 500) v_entries
        WHERE contains(lower(content), 'the') ORDER BY v_entries.ts DESC, id LIMIT 20""",
)
def scan_window(v: Views):
    return brief(filters.search_entries(v.entries, "the", 20, window=500))


@query(
    "search_entries_category",
    """SELECT id, category, CAST(ts AS VARCHAR) AS ts FROM v_analysed
       WHERE category = '1-URGENT' AND contains(lower(content), 'priority') ORDER BY v_analysed.ts DESC, id LIMIT 200""",
)
def search_entries_category(v: Views):
    rows = filters.search_category(v.analysed, "Priority", "1-URGENT", 200)
    return rows.select(
        "id", F.get_json_object("entry_analysis", "$.category").alias("category"), F.col("ts").cast("string").alias("ts")
    )


@query(
    "activity_history",
    f"""{ENTRY} FROM (SELECT * FROM v_entries WHERE contains(lower(content), 'ent')
         AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-21') v_entries""",
)
def activity_history(v: Views):
    return brief(filters.activity_history(v.entries, "Ent", "2024-01-02", "2024-01-20"))


@query(
    "entries_by_source",
    f"{ENTRY} FROM v_entries WHERE contains(lower(source), 'src1') ORDER BY v_entries.ts DESC, id LIMIT 100",
)
def entries_by_source(v: Views):
    return brief(filters.by_source(v.entries, "SRC1", 100))


@query(
    "entries_with_image",
    f"{ENTRY}, image_url FROM v_entries WHERE image_url <> '' ORDER BY v_entries.ts DESC, id LIMIT 20",
)
def entries_with_image(v: Views):
    return brief(filters.with_image(v.entries, 20), "image_url")


@query("queries_recent", "SELECT id, question, answer, is_gap FROM v_queries ORDER BY ts DESC, id LIMIT 50")
def queries_recent(v: Views):
    return filters.newest(v.queries, 50).select("id", "question", "answer", "is_gap")


@query("gap_queries", "SELECT id, question FROM v_queries WHERE is_gap ORDER BY ts DESC, id LIMIT 20")
def gap_queries(v: Views):
    return filters.newest(v.queries.filter("is_gap"), 20).select("id", "question")


@query(
    "open_root_tasks",
    """SELECT id, status, content FROM v_tasks WHERE parent_id = '' AND status IN ('pending', 'active')
       ORDER BY ts DESC, id LIMIT 25""",
)
def open_root_tasks(v: Views):
    return filters.open_roots(v.tasks).select("id", "status", "content")


@query(
    "child_tasks",
    """SELECT id, parent_id, status, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY ts, id) AS rank FROM v_tasks
         WHERE parent_id <> '' AND status IN ('pending', 'active')) WHERE rank <= 20""",
)
def child_tasks(v: Views):
    return filters.open_children(v.tasks).select("id", "parent_id", "status", F.col("rank").cast("bigint").alias("rank"))


@query("tasks_by_status", "SELECT id, status FROM v_tasks WHERE status = 'active' ORDER BY ts DESC, id LIMIT 20")
def tasks_by_status(v: Views):
    return filters.tasks_by_status(v.tasks, "active", 20).select("id", "status")


def identity_view(v: Views):
    """Preference rows stand for identity statements, events for self-model thoughts, generics for summaries."""
    n = v.nodes
    kind = F.col("node_type")
    return n.withColumn("domain", F.when(kind == "event", "selfmodel").otherwise("thought")).withColumn(
        "node_type",
        F.when(kind == "preference", "user_identity").when(kind == "event", "thought").when(kind == "generic", "summary").otherwise(kind),
    )


@query(
    "identity_nodes",
    "SELECT id, length(content) AS n_chars FROM v_nodes WHERE node_type = 'preference' ORDER BY ts DESC, id LIMIT 20",
)
def identity_nodes(v: Views):
    rows = filters.newest(filters.of_type(identity_view(v), "user_identity"), 20)
    return rows.select("id", F.length("content").cast("bigint").alias("n_chars"))


@query(
    "active_signals",
    """SELECT id, '- [' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || content AS line FROM v_nodes
       WHERE node_type = 'event' AND content <> '' ORDER BY ts DESC, id LIMIT 5""",
)
def active_signals(v: Views):
    return filters.signals(identity_view(v), 5).select("id", "line")


@query(
    "recent_summaries",
    """SELECT id, '[' || strftime(ts, '%Y-%m-%d') || ']: ' || content AS line FROM v_nodes
       WHERE node_type = 'generic' AND content <> '' ORDER BY ts DESC, id LIMIT 5""",
)
def recent_summaries(v: Views):
    return filters.summaries(identity_view(v), 5).select("id", "line")


@query(
    "unresolved_questions",
    "SELECT id, kind, CAST(ask_count AS BIGINT) AS ask_count FROM v_questions WHERE resolved IS NULL ORDER BY created DESC, id LIMIT 20",
)
def unresolved_questions(v: Views):
    return filters.unresolved(v.questions).select("id", "kind", F.col("ask_count").cast("bigint").alias("ask_count"))


@query(
    "resolved_questions",
    """SELECT id, kind, answer FROM v_questions WHERE resolved IS NOT NULL AND created >= TIMESTAMP '2024-01-02'""",
)
def resolved_questions(v: Views):
    return filters.resolved(v.questions, "2024-01-02 00:00:00").select("id", "kind", "answer")


@query(
    "active_goals",
    """SELECT id, node_type, json_extract_string(metadata, '$.status') AS status, weight FROM v_nodes
       WHERE node_type IN ('goal', 'project') AND json_extract_string(metadata, '$.status') IN ('active', 'planning', 'blocked')
       ORDER BY weight DESC, id LIMIT 20""",
)
def active_goals(v: Views):
    return filters.active_goals(v.nodes).select("id", "node_type", "status", "weight")


@query(
    "countdowns",
    """SELECT 'o-' || o_orderkey AS id, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS target,
         CAST(date_diff('day', TIMESTAMP '1998-06-01', o_orderdate) AS BIGINT) AS days
       FROM orders WHERE contains(lower(o_orderpriority), 'urgent')""",
)
def countdowns(v: Views):
    o = v.table("orders")
    nodes = o.select(
        F.concat(F.lit("o-"), "o_orderkey").alias("id"), F.lit("countdown").alias("node_type"),
        F.concat(F.lit("Countdown: "), "o_orderpriority").alias("content"),
        F.concat(F.lit('{"target_date": "'), F.col("o_orderdate").cast("date").cast("string"), F.lit('"}')).alias("metadata"),
    )
    out = filters.countdowns(nodes, ntz("1998-06-01 00:00:00"), "Urgent")
    return out.withColumn("days", F.col("days").cast("bigint"))


@query(
    "bookmarks",
    """SELECT 'page-' || page_id AS id, 'Page ' || page_id AS title, url, unnest(['web', 'p' || (page_id % 3)]) AS tag FROM pages""",
)
def bookmarks(v: Views):
    p = v.table("pages")
    tags = F.array(F.lit("web"), F.concat(F.lit("p"), F.col("page_id") % 3))
    nodes = p.select(
        F.concat(F.lit("page-"), "page_id").alias("id"), F.lit("bookmark").alias("node_type"),
        F.concat(F.lit("Bookmark: Page "), "page_id").alias("content"),
        F.to_json(F.struct("url", tags.alias("tags"))).alias("metadata"),
    )
    return filters.bookmarks(nodes)


@query("list_by_type", "SELECT id, weight FROM v_nodes WHERE node_type = 'person'")
def list_by_type(v: Views):
    return filters.of_type(v.nodes, "person").select("id", "weight")


@query(
    "explicit_override",
    r"""SELECT id FROM (SELECT 'm-' || conv_id || '-' || turn AS id, lower(trim(
          CASE conv_id % 4 WHEN 0 THEN 'Update: ' WHEN 1 THEN 'Please REMEMBER that ' ELSE '' END || text)) AS t FROM conversations)
        WHERE regexp_matches(t, 'remember that|remember this|store that|store this|save that|save this|make sure you remember|please remember|correct this|correction:|actually,|actually |update this fact|that''s wrong|that is wrong|fix that')
           OR regexp_matches(t, '^(remember:|store:|save:|correct:|update:)')""",
)
def explicit_override(v: Views):
    c = v.table("conversations")
    lead = F.when(F.col("conv_id") % 4 == 0, "Update: ").when(F.col("conv_id") % 4 == 1, "Please REMEMBER that ").otherwise("")
    rows = c.select(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), F.concat(lead, "text").alias("text"))
    return rows.filter(C.explicit_override(F.col("text"))).select("id")


@query(
    "affirmative",
    r"""SELECT id, regexp_matches(lower(trim(t)), '^(yes|y|yeah|yep|yup|sure|ok|okay|do it|create it|go ahead|please|absolutely)( |$)') AS yes
        FROM (SELECT 'm-' || conv_id || '-' || turn AS id,
                CASE turn % 3 WHEN 0 THEN ' Yes ' || split_part(text, ' ', 1) WHEN 1 THEN 'Go ahead' ELSE 'yesterday ' || split_part(text, ' ', 1) END AS t
              FROM conversations)""",
)
def affirmative(v: Views):
    word = F.split_part("text", F.lit(" "), F.lit(1))
    turn = F.col("turn") % 3
    text = F.when(turn == 0, F.concat(F.lit(" Yes "), word)).when(turn == 1, "Go ahead").otherwise(F.concat(F.lit("yesterday "), word))
    return v.table("conversations").select(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), C.affirmative(text).alias("yes"))


@query(
    "gap_from_thought",
    r"""SELECT id, coalesce(list_filter(list_transform(string_split(rest, chr(10)), lambda x: trim(regexp_replace(x, '^[-*• \t]+', ''))), lambda x: x <> '')[1]
              NOT IN ('none', 'n/a', 'na', 'nothing', '-', 'no', 'no gaps', 'unknown'), false) AS gap
        FROM (SELECT 'm-' || conv_id || '-' || turn AS id,
                CASE turn % 3 WHEN 0 THEN lower(chr(10) || '- ' || text) WHEN 1 THEN chr(10) || ' - none' ELSE '' END AS rest
              FROM conversations)""",
)
def gap_from_thought(v: Views):
    turn = F.col("turn") % 3
    text = (
        F.when(turn == 0, F.concat(F.lit("Plan.\nIdentified Gaps:\n- "), "text"))
        .when(turn == 1, F.lit("Identified gaps:\n - None"))
        .otherwise(F.col("text"))
    )
    return v.table("conversations").select(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), C.gap_in_thought(text).alias("gap"))


@query(
    "gap_from_result",
    """SELECT 'm-' || conv_id || '-' || turn AS id, turn % 4 = 0 OR contains(lower(text), 'no wikipedia') AS gap FROM conversations""",
)
def gap_from_result(v: Views):
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("No Entries found. "), "text")).otherwise(F.col("text"))
    return v.table("conversations").select(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), C.gap_in_result(text).alias("gap"))


@query(
    "missing_info",
    r"""SELECT id, CASE WHEN turn % 2 = 0 THEN t ELSE trim(t) END AS answer, CASE WHEN turn % 2 = 0 THEN 'date|place ' || conv_id ELSE '' END AS missing
        FROM (SELECT 'm-' || conv_id || '-' || turn AS id, conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)""",
)
def missing_info(v: Views):
    lead = F.concat(F.lit("Missing_Info: date; place "), F.col("conv_id"), F.lit(" ;\n"))
    text = F.when(F.col("turn") % 2 == 0, F.concat(lead, "text")).otherwise(F.col("text"))
    parts = C.missing_info(text)
    return v.table("conversations").select(
        F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), parts["answer"].alias("answer"),
        F.array_join(parts["missing"], "|").alias("missing"),
    )


@query(
    "decision_lines",
    """SELECT run_id, line_no FROM (
         SELECT user_id AS run_id, event_id AS line_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
         FROM events WHERE event_type IN ('click', 'error')) WHERE n <= 50""",
)
def decision_lines(v: Views):
    kind = F.col("event_type")
    text = F.when(kind == "click", "FOH: tool call made").when(kind == "error", "Backoff started").otherwise("other line")
    lines = v.table("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), text.alias("line"))
    return filters.decision_lines(lines).select("run_id", "line_no")
