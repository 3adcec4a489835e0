"""Named queries: model output, triples, metadata, text cleaning, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph import schema as V
from mnemograph.catalog.registry import query
from mnemograph.catalog.relations import long
from mnemograph.functions import columns as C, dates, model, outputs
from mnemograph.operators import aggregates
from mnemograph.operators.filters import of_type
from mnemograph.sources.views import AS_OF, Views, ntz

# the triple lines of the model text view, as SQL rows (doc_id, id, owner, pos, fields)
TRIPLES = """SELECT doc_id, id, owner, 1 AS pos, [w0, 'works at', coalesce(w1, 'x'), 'Person', 'City'] AS f FROM v_model_text
  UNION ALL SELECT doc_id, id, owner, 2, [CASE WHEN doc_id % 4 = 0 THEN 'I' ELSE coalesce(w2, 'x') END, 'based-in', coalesce(w3, 'x')] FROM v_model_text WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, id, owner, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END, [coalesce(w4, 'x'), 'NEW:mentors', 'a', 'b'] FROM v_model_text WHERE doc_id % 3 = 0"""
# a word with pipes or a colon could change the shape of a line; the oracle re-splits the joined line
LINES = f"""SELECT doc_id, id, owner, pos, line, list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS p
  FROM (SELECT *, array_to_string(f, ' | ') AS line FROM ({TRIPLES}))"""
PRONOUN = "lower({0}) IN ('i','me','my','myself','mine','we','us','our','ours','ourselves','you','your','yours','yourself','yourselves')"
ERROR = f"""CASE WHEN len(p) NOT IN (3, 5) THEN 'expected 3 or 5 pipe-separated fields, got ' || len(p)
  WHEN p[1] = '' OR p[2] = '' OR p[3] = '' THEN 'subject, predicate, and object must all be non-empty'
  WHEN owner = '' AND ({PRONOUN.format('p[1]')} OR {PRONOUN.format('p[3]')}) THEN 'pronoun subject or object rejected (owner identity unknown)' END"""
PARSED = f"""SELECT *, {ERROR} AS error FROM ({LINES})"""
GOOD = f"""SELECT id, pos, CASE WHEN {PRONOUN.format('p[1]')} THEN owner ELSE p[1] END AS subject, p[2] AS predicate,
  CASE WHEN {PRONOUN.format('p[3]')} THEN owner ELSE p[3] END AS object, CASE WHEN len(p) = 5 THEN 'person' ELSE 'generic' END AS subject_type,
  CASE WHEN len(p) = 5 THEN 'place' ELSE 'generic' END AS object_type FROM ({PARSED}) WHERE error IS NULL"""
ALIAS = """CASE {0} WHEN 'work_at' THEN 'works_at' WHEN 'works_for' THEN 'works_at' WHEN 'employed_by' THEN 'works_at' WHEN 'moved_to' THEN 'lives_in'
  WHEN 'relocated_to' THEN 'lives_in' WHEN 'resides_in' THEN 'lives_in' WHEN 'live_in' THEN 'lives_in' WHEN 'lives_at' THEN 'lives_in' WHEN 'located_at' THEN 'located_in'
  WHEN 'based_in' THEN 'located_in' WHEN 'collaborates' THEN 'collaborates_with' WHEN 'collaboratesw_with' THEN 'collaborates_with' WHEN 'manage' THEN 'manages' WHEN 'reports' THEN 'reports_to' ELSE {0} END"""


@query(
    "parse_kv",
    f"""SELECT id, 'summary' AS key, 1 AS pos, array_to_string(w[1:5], ' ') AS value, false AS is_section FROM v_model_text
        UNION ALL SELECT id, 'significance', 1, CAST((doc_id % 13) / 10.0::DOUBLE AS VARCHAR), false FROM v_model_text
        UNION ALL SELECT id, 'future_commitment', 1, CAST((doc_id % 11) / 10.0::DOUBLE AS VARCHAR), false FROM v_model_text
        UNION ALL SELECT id, 'commitment_intent', 1, array_to_string(w[1:3], ' '), false FROM v_model_text
        UNION ALL SELECT id, 'triples', pos, line, true FROM ({LINES})
        UNION ALL SELECT id, 'subtasks', 1, w0 || ' | do ' || coalesce(w1, 'x') || ' | ' || coalesce(w2, 'x') || ', ' || coalesce(w3, 'x'), true FROM v_model_text
        UNION ALL SELECT id, 'subtasks', 2, 'no separator here', true FROM v_model_text
        UNION ALL SELECT id, 'questions', 1, 'What is ' || w0 || '? | reason: ' || coalesce(w1, 'x'), true FROM v_model_text
        UNION ALL SELECT id, 'questions', 2, 'Why ' || coalesce(w2, 'x') || '?', true FROM v_model_text""",
)
def parse_kv(v: Views):
    return outputs.parse_kv(v.model_text)


@query("parse_triples", f"SELECT id, pos, line AS raw_line, error FROM ({PARSED})")
def parse_triples(v: Views):
    return outputs.parse_triples(v.model_text).select("id", "pos", "raw_line", "error")


@query(
    "parse_fact_lines",
    """SELECT 'm-' || conv_id || '-' || turn AS id, role AS subject, 'said' AS predicate,
         CASE WHEN turn % 2 = 0 THEN 'a | b' ELSE 'c' END AS object FROM conversations WHERE turn % 3 <> 2""",
)
def parse_fact_lines(v: Views):
    turn = F.col("turn")
    line = F.concat_ws(
        " | ", F.col("role"), F.when(turn % 3 != 2, "said"), F.when(turn % 2 == 0, " a | b ").otherwise("c")
    )
    line = F.when(turn % 3 == 2, F.lit("no separator")).otherwise(line)
    rows = v.table("conversations").select(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), C.parse_fact(line).alias("t"))
    return rows.filter(F.col("t").isNotNull()).select("id", "t.*")


@query("resolve_pronoun", f"SELECT id, pos, subject, object, subject_type, object_type FROM ({GOOD})")
def resolve_pronoun(v: Views):
    rows = outputs.parse_triples(v.model_text).filter(F.col("error").isNull())
    return rows.select("id", "pos", "subject", "object", "subject_type", "object_type")


@query("pronoun_drops", f"SELECT id, count(*) AS n FROM ({PARSED}) WHERE error LIKE 'pronoun%' GROUP BY 1")
def pronoun_drops(v: Views):
    rows = outputs.parse_triples(v.model_text).filter(F.col("error").startswith("pronoun"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def raw_predicates(v: Views):
    """Event kinds spelled in several ways around known and unknown predicates."""
    words = ["Works At", " works-for ", "resides in", "KNOWS well", "collaborates", "likes"]
    pick = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 6 + 1).cast("int"))
    return v.table("events").select("event_id", pick.alias("raw"))


RAW = "(SELECT event_id, ['Works At',' works-for ','resides in','KNOWS well','collaborates','likes'][event_id % 6 + 1] AS raw FROM events)"
NORM = "replace(replace(lower(trim(raw)), ' ', '_'), '-', '_')"


@query("normalise_predicate", f"SELECT event_id, {NORM} AS predicate FROM {RAW}")
def normalise_predicate(v: Views):
    return raw_predicates(v).select("event_id", C.normalise_predicate(F.col("raw")).alias("predicate"))


@query("canonical_predicate", f"SELECT event_id, {ALIAS.format(NORM)} AS predicate FROM {RAW}")
def canonical_predicate(v: Views):
    return raw_predicates(v).select("event_id", C.canonical_predicate(F.col("raw")).alias("predicate"))


@query(
    "snap_predicate",
    f"""SELECT event_id, CASE WHEN p IN ('works_at','prefers','owns','lives_in','located_in','collaborates_with','reports_to','manages') THEN p END AS predicate
        FROM (SELECT event_id, {ALIAS.format(NORM)} AS p FROM {RAW})""",
)
def snap_predicate(v: Views):
    return raw_predicates(v).select("event_id", C.snap_predicate(F.col("raw")).alias("predicate"))


@query(
    "canonical_type",
    """SELECT event_id, ['person','place','asset','event','generic','project','generic'][event_id % 7 + 1] AS node_type FROM events""",
)
def canonical_type(v: Views):
    words = ["Human", " hotel", "Thing", "TRIP", "spaceship", "work", ""]
    pick = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 7 + 1).cast("int"))
    return v.table("events").select("event_id", C.canonical_type(pick).alias("node_type"))


META = "json_extract_string(metadata, '$.{0}')"


@query(
    "validate_metadata",
    f"""SELECT id, node_type, error FROM (SELECT id, node_type, CASE
          WHEN node_type = 'preference' AND lower({META.format('category')}) NOT IN ('food','workflow','tech') THEN 'invalid category "' || {META.format('category')} || '" for preference'
          WHEN node_type = 'event' AND lower({META.format('type')}) NOT IN ('celebration','work','health') THEN 'invalid type "' || {META.format('type')} || '" for event/milestone'
          WHEN node_type = 'place' AND lower({META.format('category')}) NOT IN ('home','office','travel') THEN 'invalid category "' || {META.format('category')} || '" for place'
          WHEN node_type IN ('asset', 'tool') AND lower({META.format('type')}) NOT IN ('software','hardware','account') THEN 'invalid type "' || {META.format('type')} || '" for asset/tool'
        END AS error FROM v_nodes) WHERE error IS NOT NULL""",
)
def validate_metadata(v: Views):
    rows = v.nodes.select("id", "node_type", C.validate_metadata(F.col("node_type"), F.col("metadata")).alias("error"))
    return rows.filter(F.col("error").isNotNull())


NORMALISED = f"""CASE node_type WHEN 'person' THEN '{{}}'
  WHEN 'project' THEN '{{"status":"' || {META.format('status')} || '"}}' WHEN 'goal' THEN '{{"status":"' || {META.format('status')} || '"}}'
  WHEN 'preference' THEN '{{"category":"' || lower({META.format('category')}) || '"}}' WHEN 'event' THEN '{{"type":"' || lower({META.format('type')}) || '"}}'
  WHEN 'place' THEN '{{"category":"' || lower({META.format('category')}) || '"}}'
  WHEN 'asset' THEN '{{"type":"' || lower({META.format('type')}) || '"}}' WHEN 'tool' THEN '{{"type":"' || lower({META.format('type')}) || '"}}'
  WHEN 'generic' THEN '{{"confidence_score":0.0}}' ELSE metadata END"""


@query("normalise_metadata", f"SELECT id, {NORMALISED} AS metadata FROM v_nodes")
def normalise_metadata(v: Views):
    return v.nodes.select("id", C.normalise_metadata(F.col("node_type"), F.col("metadata")).alias("metadata"))


@query(
    "entity_status",
    "SELECT event_id, ['Planned','In-Progress','Stalled','Completed','In-Progress','odd One'][event_id % 6 + 1] AS status FROM events",
)
def entity_status(v: Views):
    words = ["Scheduled", " ongoing", "on HOLD", "done", "", "odd One"]
    pick = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 6 + 1).cast("int"))
    return v.table("events").select("event_id", C.entity_status(pick).alias("status"))


@query(
    "task_status",
    "SELECT event_id, ['pending','active','completed','abandoned','pending','pending'][event_id % 6 + 1] AS status FROM events",
)
def task_status(v: Views):
    words = ["pending", "active", "completed", "abandoned", "Active", ""]
    pick = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 6 + 1).cast("int"))
    return v.table("events").select("event_id", C.task_status(pick).alias("status"))


@query(
    "parse_analysis",
    "SELECT id, category, name, type, status, source_id, CAST(ts AS VARCHAR) AS ts FROM v_entities",
)
def parse_analysis(v: Views):
    return aggregates.entities_of(v.analysed).withColumn("ts", F.col("ts").cast("string"))


@query("entity_id", "SELECT c_custkey, 'entity_' || sha1('person:' || lower(c_name)) AS id FROM customer")
def entity_id(v: Views):
    return v.table("customer").select(
        "c_custkey", C.entity_id(F.lit("person"), F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).alias("id")
    )


@query("relationship_id", "SELECT id, subject_id, object_id FROM v_relationships")
def relationship_id(v: Views):
    return v.relationships.select("id", "subject_id", "object_id")


@query(
    "clean_text",
    """SELECT doc_id, text AS cleaned, substring(text, 1, 100) AS preview, strlen(text) AS n_bytes FROM documents""",
)
def clean_text(v: Views):
    dirty = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3")))
    t = F.col("text")
    return v.table("documents").select(
        "doc_id", C.valid_utf8(dirty).alias("cleaned"), C.cut_runes(t, 100).alias("preview"), F.octet_length("text").cast("bigint").alias("n_bytes")
    )


@query(
    "cut_bytes",
    """SELECT doc_id, array_to_string(list_filter(list_transform(range(1, length(head) + 1),
              lambda i: CASE WHEN strlen(substring(head, 1, i)) <= 120 THEN substring(head, i, 1) END), lambda c: c IS NOT NULL), '') AS head
            FROM (SELECT doc_id, substring(text, 1, 120) AS head FROM documents)""",
)
def cut_bytes(v: Views):
    return v.table("documents").select("doc_id", C.cut_bytes(F.col("text"), 120).alias("head"))


EXPRESSIONS = ["today", "Yesterday", "this morning", "since yesterday", "last week", "last month", "since Monday", "2024-01-15", "1/9/2024", "Jan 5, 2024", "30 days ago", "no date"]


@query(
    "resolve_dates",
    """WITH e AS (SELECT event_id, ts, date_trunc('day', ts)::DATE AS d,
            ['today','Yesterday','this morning','since yesterday','last week','last month','since Monday','2024-01-15','1/9/2024','Jan 5, 2024','30 days ago','no date'][event_id % 12 + 1] AS expr FROM events)
       SELECT event_id, expr, strftime(CASE expr WHEN 'today' THEN d WHEN 'this morning' THEN d WHEN 'Yesterday' THEN d - 1 WHEN 'since yesterday' THEN d - 1
           WHEN 'last week' THEN date_trunc('week', d)::DATE - 7 WHEN 'last month' THEN (date_trunc('month', d) - INTERVAL 1 MONTH)::DATE
           WHEN 'since Monday' THEN date_trunc('week', d)::DATE WHEN '2024-01-15' THEN DATE '2024-01-15' WHEN '1/9/2024' THEN DATE '2024-01-09'
           WHEN 'Jan 5, 2024' THEN DATE '2024-01-05' WHEN '30 days ago' THEN d - 30 END, '%Y-%m-%d') AS start_date,
         strftime(CASE expr WHEN 'today' THEN d WHEN 'this morning' THEN d WHEN 'Yesterday' THEN d - 1 WHEN 'since yesterday' THEN d
           WHEN 'last week' THEN date_trunc('week', d)::DATE - 1 WHEN 'last month' THEN (date_trunc('month', d) - INTERVAL 1 DAY)::DATE
           WHEN 'since Monday' THEN d WHEN '2024-01-15' THEN DATE '2024-01-15' WHEN '1/9/2024' THEN DATE '2024-01-09'
           WHEN 'Jan 5, 2024' THEN DATE '2024-01-05' WHEN '30 days ago' THEN d - 30 END, '%Y-%m-%d') AS end_date FROM e""",
)
def resolve_dates(v: Views):
    expr = F.element_at(F.array(*map(F.lit, EXPRESSIONS)), (F.col("event_id") % 12 + 1).cast("int"))
    rows = v.table("events").select("event_id", expr.alias("expr"), "ts")
    r = dates.resolve_range(F.col("expr"), F.lit(None).cast("string"), F.col("ts"))
    return rows.select("event_id", "expr", r.alias("r")).select("event_id", "expr", "r.*")


@query(
    "image_tokens",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'log-' || doc_id END AS entry_id,
         CASE WHEN doc_id % 3 > 0 THEN trim(lang || '  ' || source || CASE WHEN doc_id % 3 = 2 THEN ' [SEND_IMAGE:x]' ELSE '' END) END AS caption,
         trim(lang || ' ' || CASE WHEN doc_id % 3 > 0 THEN '[Photo sent]' ELSE '' END || ' ' || source || CASE WHEN doc_id % 3 = 2 THEN ' [Photo sent]' ELSE '' END) AS stored
       FROM documents""",
)
def image_tokens(v: Views):
    token = F.concat(F.lit("[SEND_IMAGE: log-"), "doc_id", F.lit("]"))
    d = F.col("doc_id") % 3
    text = F.concat(
        "lang", F.lit(" "), F.when(d > 0, token).otherwise(""), F.lit(" "), "source",
        F.when(d == 2, " [SEND_IMAGE:x]").otherwise(""),
    )
    return v.table("documents").select(
        "doc_id", C.image_token_id(text).alias("entry_id"), C.image_caption(text).alias("caption"),
        C.image_tokens_as_sent(text).alias("stored"),
    )


@query(
    "parse_subtasks",
    """SELECT id, 1 AS pos, trim(p[1]) || ': ' || trim(p[2]) AS content,
         array_to_string(list_filter(list_transform(string_split(trim(array_to_string(p[3:], ' | ')), ','), lambda x: trim(x)), lambda x: x <> ''), ';') AS deps
       FROM (SELECT id, string_split(w0 || ' | do ' || coalesce(w1, 'x') || ' | ' || coalesce(w2, 'x') || ', ' || coalesce(w3, 'x'), ' | ') AS p FROM v_model_text)""",
)
def parse_subtasks(v: Views):
    rows = outputs.parse_subtasks(v.model_text)
    return rows.select("id", "pos", "content", F.array_join("dependencies", ";").alias("deps"))


@query(
    "parse_questions",
    """SELECT id, 1 AS pos, 'What is ' || w0 || '?' AS question, coalesce(w1, 'x') AS reason FROM v_model_text
       UNION ALL SELECT id, 2, 'Why ' || coalesce(w2, 'x') || '?', '' FROM v_model_text""",
)
def parse_questions(v: Views):
    return outputs.parse_questions(v.model_text)


@query(
    "evaluator_fields",
    """SELECT *, CASE WHEN future_commitment >= 0.6 AND strlen(intent) >= 10 THEN 'Should I create a task for: "' || intent || '"?' END AS proposal FROM (
         SELECT id, least(1.0, (doc_id % 13) / 10.0::DOUBLE) AS significance, 'thought' AS domain, (doc_id % 11) / 10.0::DOUBLE AS future_commitment,
           array_to_string(w[1:3], ' ') AS intent FROM v_model_text)""",
)
def evaluator_fields(v: Views):
    return outputs.evaluator_fields(v.model_text)


@query(
    "model_replies",
    """SELECT conv_id, turn, CASE WHEN text LIKE '%?%' THEN NULL ELSE role || ': ' || array_to_string(string_split(text, ' ')[1:5], ' ') END AS reply,
         CASE WHEN text LIKE '%?%' THEN 'no question please' END AS error
       FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL""",
)
def model_replies(v: Views):
    """A stand-in model answers each turn with its first words, and fails on questions; a failing call yields its error, the others their text."""
    turns = v.table("conversations").filter("role is not null and text is not null")
    asked = turns.select(F.to_json(F.struct("conv_id", "turn")).alias("id"), F.col("role").alias("system"), F.col("text").alias("prompt"), "conv_id", "turn")

    def ask(systems, prompts, most):
        if any("?" in p for p in prompts):
            raise ValueError("no question please")
        return [f"{s}: {' '.join(p.split(' ')[:most])}" for s, p in zip(systems, prompts, strict=True)]

    out = model.model_column(asked, ask, max_tokens=5, batch=1)
    key = F.from_json("id", turns.select("conv_id", "turn").schema)
    return out.select(key.alias("k"), F.col("text").alias("reply"), "error").select("k.*", "reply", "error")
