"""Named queries: joins, aggregations, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.catalog.registry import query
from mnemograph.catalog.scans import identity_view
from mnemograph.functions import columns as C
from mnemograph.operators import aggregates, dedup, filters, joins, rank, sequences
from mnemograph.operators.vector import nearest
from mnemograph.plans.search import keyword_hits, knowledge
from mnemograph.session import stage
from mnemograph.sources.views import AS_OF, Views, ntz

COS = "list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[])"


def knn_sql(k: int, where: str = "n.node_type <> 'log'", queries: str = "v_search", corpus: str = "v_nodes", low: float = 0.0) -> str:
    """Ranked hits (qid, id, score, rank) of every query against a filtered corpus."""
    return f"""SELECT qid, id, score, rank FROM (
      SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT q.qid, n.id, round(greatest(0.0, least(1.0, {COS})), 6) AS score
        FROM {queries} q, {corpus} n WHERE {where}) WHERE score >= {low}) WHERE rank <= {k}"""


def long(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


# joins


@query(
    "entry_dates",
    """SELECT DISTINCT e.id AS entry_id, strftime(e.ts, '%Y-%m-%d') AS entry_date FROM v_entries e
       JOIN labels ON e.id = 'log-' || doc_id""",
)
def entry_dates(v: Views):
    refs = v.table("labels").select(F.concat(F.lit("log-"), "doc_id").alias("entry_id"))
    return joins.entry_dates(refs, v.entries)


def references(v: Views):
    """Each order cites the documents its line items' parts point at, in line order."""
    n = v.table("documents").count()
    items = v.table("lineitem")
    return items.select(
        F.concat(F.lit("ord-"), "l_orderkey").alias("id"),
        (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("pos"),
        F.concat(F.lit("log-"), F.col("l_partkey") % n).alias("entry_id"),
    )


@query(
    "node_source_dates",
    """SELECT id, entry_date, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank FROM (
           SELECT 'ord-' || l_orderkey AS id, strftime(e.ts, '%Y-%m-%d') AS entry_date, min(l_linenumber::BIGINT * 1000000 + l_partkey) AS pos
           FROM lineitem JOIN v_entries e ON e.id = 'log-' || (l_partkey % (SELECT count(*) FROM documents)) GROUP BY 1, 2))
       WHERE rank <= 5""",
)
def node_source_dates(v: Views):
    return long(joins.source_dates(references(v), v.entries).drop("pos"), "rank")


@query(
    "incoming_spo",
    """SELECT id, subject_id, object_id FROM v_relationships WHERE object_id IN (SELECT 'nat-' || n_nationkey FROM nation)""",
)
def incoming_spo(v: Views):
    targets = v.table("nation").select(F.concat(F.lit("nat-"), "n_nationkey").alias("id"))
    return joins.incoming_triples(v.relationships, targets).select("id", "subject_id", "object_id")


@query(
    "incoming_links",
    """SELECT DISTINCT target_id, id FROM (SELECT id, unnest(entity_links) AS target_id FROM v_relationships)
       WHERE target_id IN (SELECT 'cust-' || c_custkey FROM customer)""",
)
def incoming_links(v: Views):
    targets = v.table("customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("id"))
    return joins.incoming_links(v.relationships, targets)


@query(
    "label_relationships",
    """SELECT r.id, predicate, coalesce(nullif(s.content, ''), subject_id) AS subject_label, coalesce(nullif(o.content, ''), object_id) AS object_label
       FROM v_relationships r LEFT JOIN v_names s ON s.id = subject_id LEFT JOIN v_names o ON o.id = object_id""",
)
def label_relationships(v: Views):
    out = joins.label_relationships(v.relationships, v.graph_nodes.select("id", "content"))
    return out.select("id", "predicate", "subject_label", "object_label")


@query(
    "active_project",
    """WITH open AS (SELECT * FROM v_tasks WHERE status IN ('pending', 'active')),
       roots AS (SELECT * FROM open WHERE parent_id = ''),
       chosen AS (SELECT * FROM roots WHERE id IN (SELECT parent_id FROM open) ORDER BY ts DESC, id LIMIT 1)
       SELECT id, parent_id, status, content FROM chosen
       UNION ALL SELECT * FROM (SELECT id, parent_id, status, content FROM open WHERE parent_id IN (SELECT id FROM chosen) ORDER BY ts, id LIMIT 10)""",
)
def active_project(v: Views):
    return joins.active_project(v.tasks).select("id", "parent_id", "status", "content")


def linked_nodes(v: Views):
    """Nodes with a parent goal in their metadata and links to their two successors."""
    n = v.n_vectors
    vec = F.col("vec_id")
    target = lambda step: F.concat(F.lit("node-"), (vec + step) % n)
    meta = F.when(
        F.col("node_type").isin("project", "goal"),
        F.regexp_replace("metadata", r"\}$", ""),
    )
    with_parent = F.when(vec % 3 == 0, F.concat(meta, F.lit(', "parent_goal": "'), target(7), F.lit('"}')))
    nodes = v.nodes.withColumn("metadata", F.coalesce(with_parent, "metadata"))
    links = v.nodes.select("id", F.posexplode(F.array(target(1), target(2), target(3))).alias("pos", "target_id"))
    return nodes, links


@query(
    "linked_completed_project",
    """WITH n AS (SELECT count(*) AS n FROM embeddings),
       done AS (SELECT vec_id FROM v_nodes WHERE node_type IN ('project', 'goal') AND json_extract_string(metadata, '$.status') = 'completed'),
       cand AS (
         SELECT id, (vec_id + 7) % n AS t, -2 AS prio FROM v_nodes, n WHERE node_type IN ('project', 'goal') AND vec_id % 3 = 0
         UNION ALL SELECT id, (vec_id + k) % n, k FROM v_nodes, n, (SELECT unnest([1, 2, 3]) AS k))
       SELECT id, 'node-' || arg_min(t, prio) AS project_id FROM cand WHERE t IN (SELECT vec_id FROM done) GROUP BY id""",
)
def linked_completed_project(v: Views):
    return joins.linked_completed_project(*linked_nodes(v))


@query(
    "missing_embeddings",
    "SELECT id, node_type FROM v_graph_nodes WHERE embedding IS NULL",
)
def missing_embeddings(v: Views):
    return joins.missing_embeddings(v.graph_nodes).select("id", "node_type")


@query(
    "dangling_ids",
    """SELECT DISTINCT id FROM (SELECT unnest([subject_id, object_id]) AS id FROM v_relationships)
       WHERE id NOT IN (SELECT 'cust-' || c_custkey FROM customer) AND id NOT IN (SELECT 'nat-' || n_nationkey FROM nation)""",
)
def dangling_ids(v: Views):
    key = lambda t, c, p: v.table(t).select(F.concat(F.lit(p), c).alias("id"))
    known = key("customer", "c_custkey", "cust-").unionByName(key("nation", "n_nationkey", "nat-"))
    return joins.dangling_ids(v.relationships, known)


SCORED = f"round(greatest(0.0, least(1.0, {COS})), 6)"
NAMED = r"regexp_matches({1}, '\S') AND contains({0}, {1})"
SELF = NAMED.format("lower(n.content)", "lower(q.query)")
FOUND = f"""SELECT qid, id, score FROM (
      SELECT q.qid, n.id, {SCORED} AS score, row_number() OVER (PARTITION BY q.qid ORDER BY
        CASE WHEN {SELF} OR {NAMED.format("lower(q.query)", "lower(n.content)")} THEN 0 ELSE 1 END, {SCORED} DESC, n.id) AS rn
      FROM v_search q, v_nodes n WHERE n.node_type = 'person') WHERE rn = 1"""
DISCOVERED = knn_sql(10, f"n.node_type <> 'log' AND NOT (n.node_type = 'person' AND {SELF})")


@query("find_entity", FOUND)
def find_entity(v: Views):
    return joins.find_entity(v.search_inputs.withColumn("name", F.col("query")), v.nodes)


@query(
    "find_project",
    f"""SELECT qid, id, score FROM ({knn_sql(1, "n.node_type IN ('project', 'goal')")})""",
)
def find_project(v: Views):
    return joins.find_project(v.search_inputs, v.nodes)


@query("discover_related", DISCOVERED)
def discover_related(v: Views):
    return long(joins.discover_related(v.search_inputs.withColumn("name", F.col("query")), v.nodes), "rank")


PAGE_MARKS = """(SELECT 'page-' || page_id AS id, 'Page ' || page_id AS title, url, embedding FROM pages
      JOIN embeddings ON vec_id = page_id % (SELECT count(*) FROM embeddings))"""


@query(
    "search_bookmarks",
    f"""SELECT h.*, m.title, m.url FROM ({knn_sql(10, "TRUE", "v_near", PAGE_MARKS)}) h JOIN {PAGE_MARKS} m USING (id)""",
)
def search_bookmarks(v: Views):
    """Pages as bookmarks, each with a vector of the table."""
    vectors = v.table("embeddings").select("vec_id", "embedding")
    marks = v.table("pages").withColumn("vec_id", F.col("page_id") % v.n_vectors).join(vectors, "vec_id").select(
        F.concat(F.lit("page-"), "page_id").alias("id"), F.lit("bookmark").alias("node_type"),
        F.concat(F.lit("Bookmark: Page "), "page_id").alias("content"), F.to_json(F.struct("url")).alias("metadata"), "embedding",
    )
    return long(joins.search_bookmarks(v.near, marks.unionByName(v.nodes.select(marks.columns))), "rank")


@query(
    "question_mentions",
    r"""WITH terms AS (
          SELECT DISTINCT qid, lower(w) AS term FROM (
            SELECT 'm-' || conv_id || '-' || turn AS qid,
                   unnest(list_transform(regexp_split_to_array(text, '\s+'), lambda w: trim(w, '.,!?;:"''()[]{}'))) AS w
            FROM conversations WHERE role = 'assistant') WHERE strlen(w) >= 3 AND regexp_matches(w, '^[A-Z]')),
        firsts AS (
          SELECT term, arg_min(id, rn) AS id, min(rn) AS rn FROM (SELECT DISTINCT term FROM terms) t
          JOIN (SELECT id, lower(question || ' ' || context) AS hay, row_number() OVER (ORDER BY created DESC, id) AS rn FROM v_questions) q
            ON contains(hay, term) GROUP BY term)
        SELECT qid, arg_min(id, rn) AS question_id FROM terms JOIN firsts USING (term) GROUP BY qid""",
)
def question_mentions(v: Views):
    messages = v.table("conversations").filter(F.col("role") == "assistant").select(
        F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("qid"), "text"
    )
    return joins.question_mentions(messages, v.questions)


@query(
    "project_mentions",
    """SELECT a.id, CAST(a.ts AS VARCHAR) AS ts, summary AS line FROM v_analysed a
       WHERE a.id IN (SELECT id FROM v_entities WHERE contains(lower(name), 'customer#00000012'))""",
)
def project_mentions(v: Views):
    return joins.project_mentions(v.analysed, "Customer#00000012").withColumn("ts", F.col("ts").cast("string"))


@query(
    "code_range_lookup",
    """SELECT label, count(*) AS n FROM (
         SELECT event_id, CASE WHEN c = 0 THEN 'Clear sky' WHEN c = 1 THEN 'Mainly clear' WHEN c = 2 THEN 'Partly cloudy'
           WHEN c = 3 THEN 'Overcast' WHEN c BETWEEN 45 AND 48 THEN 'Foggy' WHEN c BETWEEN 51 AND 55 THEN 'Drizzle'
           WHEN c BETWEEN 56 AND 57 THEN 'Freezing drizzle' WHEN c BETWEEN 61 AND 65 THEN 'Rain' WHEN c BETWEEN 66 AND 67 THEN 'Freezing rain'
           WHEN c BETWEEN 71 AND 77 THEN 'Snow' WHEN c BETWEEN 80 AND 82 THEN 'Rain showers' WHEN c BETWEEN 85 AND 86 THEN 'Snow showers'
           WHEN c = 95 THEN 'Thunderstorm' WHEN c BETWEEN 96 AND 99 THEN 'Thunderstorm with hail' ELSE 'Unknown' END AS label
         FROM (SELECT event_id, event_id % 110 AS c FROM events)) GROUP BY 1""",
)
def code_range_lookup(v: Views):
    rows = v.table("events").select(C.weather_label(F.col("event_id") % 110).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unit_normalise",
    """SELECT event_id, round(CASE event_id % 5
          WHEN 0 THEN value * 9.0 / 5.0 + 32.0 WHEN 1 THEN value * 1000.0 WHEN 2 THEN value * 1000.0 / 453.59237
          WHEN 3 THEN value / 1024.0 END, 4) AS converted FROM events""",
)
def unit_normalise(v: Views):
    pick = lambda *w: F.element_at(F.array(*map(F.lit, w)), (F.col("event_id") % 5 + 1).cast("int"))
    source, target = pick("C", "km", "Kilogram", "MB", "kg"), pick("fahrenheit", "m", "lb", "GB ", "mile")
    return v.table("events").select(
        "event_id", F.round(C.convert_unit(F.col("value"), source, target), 4).alias("converted")
    )


USAGE = """SELECT *, coalesce(prompt_tokens, input_bytes // 4, 0) AS tokens_in, coalesce(completion_tokens, 0) AS tokens_out,
  CASE model WHEN 'gemini-2.5-flash' THEN 'gemini-2.5-flash' WHEN 'models/gemini-1.5-pro' THEN 'gemini-1.5-pro'
    WHEN 'gemini-1.5-flash-8b' THEN 'gemini-1.5-flash-8b' WHEN 'gemini-2.5-flash-lite-preview' THEN 'gemini-2.5-flash-lite'
    ELSE 'gemini-2.5-flash' END AS price_key,
  CASE model WHEN 'models/gemini-1.5-pro' THEN 1.25::DOUBLE WHEN 'gemini-1.5-flash-8b' THEN 0.0375::DOUBLE WHEN 'gemini-2.5-flash-lite-preview' THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS p_in,
  CASE model WHEN 'models/gemini-1.5-pro' THEN 5.0::DOUBLE WHEN 'gemini-1.5-flash-8b' THEN 0.15::DOUBLE WHEN 'gemini-2.5-flash-lite-preview' THEN 0.4::DOUBLE ELSE 2.5::DOUBLE END AS p_out
  FROM v_calls"""


@query(
    "price_join",
    f"SELECT id, price_key, round(tokens_in * p_in + tokens_out * p_out, 6) AS micro_usd FROM ({USAGE})",
)
def price_join(v: Views):
    return aggregates.with_usage(v.calls).select("id", "price_key", F.round(F.col("cost") * 1e6, 6).alias("micro_usd"))


# aggregations


@query(
    "count_entries",
    "SELECT count(*) AS n FROM v_entries WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-11'",
)
def count_entries(v: Views):
    return aggregates.count_entries(v.entries, "2024-01-03", "2024-01-10")


@query("unique_sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def unique_sources(v: Views):
    return aggregates.unique_sources(v.entries)


@query("dates_with_entries", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM v_entries")
def dates_with_entries(v: Views):
    return aggregates.dates_with_entries(v.entries)


@query(
    "local_day_rollup",
    """SELECT owner, strftime(timezone(zone, timezone('UTC', ts)), '%Y-%m-%d') AS local_day, count(*) AS n, round(sum(score), 4) AS score FROM (
         SELECT *, ['America/Los_Angeles','America/New_York','UTC','Asia/Tokyo','Europe/London','Asia/Kolkata','Australia/Sydney'][owner % 7 + 1] AS zone
         FROM v_event_logs) GROUP BY 1, 2""",
)
def local_day_rollup(v: Views):
    alias = F.element_at(F.array(*map(F.lit, ["PST", "new york", "z", "Japan", "uk", "IST", "aedt"])), (F.col("owner") % 7 + 1).cast("int"))
    return aggregates.local_days(v.event_logs, alias).withColumn("score", F.round("score", 4))


@query(
    "daily_summary",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, 'entries' AS part, '' AS key, '' AS value, count(*) AS n FROM v_analysed GROUP BY 1
       UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'summary', id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || summary, 1 FROM v_analysed WHERE summary IS NOT NULL
       UNION ALL SELECT day, 'tag', tag, '', count(*) FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, unnest(tags) AS tag FROM v_analysed) GROUP BY day, tag
       UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'entity', name || '|' || type, arg_max(status, (ts, id, status)), count(*) FROM v_entities GROUP BY 1, 3""",
)
def daily_summary(v: Views):
    return aggregates.daily_summary(v.analysed)


@query(
    "entity_rollup",
    """SELECT name, type, status, source_id, strftime(max(ts), '%Y-%m-%d') AS entry_date FROM v_entities
       WHERE contains(lower(name), 'r#') AND status = 'Completed' AND category = '1-URGENT' GROUP BY 1, 2, 3, 4""",
)
def entity_rollup(v: Views):
    return aggregates.entity_rollup(v.analysed, name_part="R#", status="Completed", category="1-URGENT")


@query(
    "retrieval_quality",
    f"""WITH s AS (SELECT qid, list_sort(list(score)) AS s, count(*) AS n FROM ({knn_sql(20)}) GROUP BY qid),
        m AS (SELECT qid, n, CASE WHEN n % 2 = 0 THEN (s[n // 2] + s[n // 2 + 1]) / 2 ELSE s[n // 2 + 1] END AS median,
              s[least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1] AS p90, s[n] AS top FROM s)
        SELECT qid, n, round(median, 8) AS median, p90, top,
          CASE WHEN p90 >= 0.6 THEN 'HIGH_CONFIDENCE_MATCH' WHEN median >= 0.5 OR top >= 0.6 THEN 'MEDIUM_CONFIDENCE_MATCH' ELSE 'LOW_CONFIDENCE_MATCH' END AS status
        FROM m""",
)
def retrieval_quality(v: Views):
    out = aggregates.retrieval_quality(nearest(v.search_inputs, knowledge(v.nodes), 20))
    return long(out, "n").withColumn("median", F.round("median", 8))


@query(
    "cost_rollup",
    f"""SELECT trace_id, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
          round(sum(tokens_in * p_in + tokens_out * p_out), 5) AS micro_usd FROM ({USAGE}) GROUP BY 1""",
)
def cost_rollup(v: Views):
    return aggregates.cost_rollup(v.calls).withColumn("micro_usd", F.round(F.col("cost") * 1e6, 5)).drop("cost")


@query(
    "token_audit",
    """SELECT model, count(*) AS calls, CAST(sum(st) AS BIGINT) AS static_tokens, CAST(sum(st + recent) AS BIGINT) AS total_tokens,
         CAST(sum(CASE WHEN st > 2048 THEN 1 ELSE 0 END) AS BIGINT) AS cacheable
       FROM (SELECT model, coalesce(completion_tokens, 0) * 5 + 100 + input_bytes AS st, coalesce(prompt_tokens, 0) AS recent FROM v_calls) GROUP BY 1""",
)
def token_audit(v: Views):
    calls = v.calls.select(
        "model", (F.coalesce("completion_tokens", F.lit(0)) * 5).alias("system_tokens"), F.lit(100).alias("tool_tokens"),
        F.col("input_bytes").alias("archive_tokens"), F.coalesce("prompt_tokens", F.lit(0)).alias("recent_tokens"),
    )
    return aggregates.token_audit(calls)


@query(
    "latency_breakdown",
    """SELECT path, count(*) AS requests, round(sum(seconds * 0.5), 4) AS llm_s, round(sum(seconds * 0.05), 4) AS embedding_s,
         round(sum(seconds * 0.3), 4) AS write_s, round(sum(greatest(0.0, seconds - seconds * 0.5 - seconds * 0.05 - seconds * 0.3)), 4) AS overhead_s, max(seconds) AS slowest_s
       FROM v_calls GROUP BY 1""",
)
def latency_breakdown(v: Views):
    s = F.col("seconds")
    requests = v.calls.select(
        "path", s.alias("total_s"), (s * 0.5).alias("llm_s"), (s * 0.05).alias("embedding_s"), (s * 0.3).alias("write_s")
    )
    out = aggregates.latency_breakdown(requests)
    return out.withColumns({c: F.round(c, 4) for c in ("llm_s", "embedding_s", "write_s", "overhead_s")})


@query(
    "latency_quantiles",
    """WITH s AS (SELECT path, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN seconds > 0 THEN ceil(ln(seconds) / ln(1.01::DOUBLE / 0.99::DOUBLE)) END AS bucket, count(*) AS n
              FROM v_calls WHERE seconds IS NOT NULL GROUP BY ALL),
       c AS (SELECT *, sum(n) OVER (PARTITION BY path, day ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY path, day) AS total,
               coalesce(2 * pow(1.01::DOUBLE / 0.99::DOUBLE, bucket) / (1.01::DOUBLE / 0.99::DOUBLE + 1), 0.0) AS middle FROM s)
       SELECT path, day, CAST(max(total) AS BIGINT) AS n, round(min(CASE WHEN upto >= ceil(total * 0.5::DOUBLE) THEN middle END), 6) AS p50,
         round(min(CASE WHEN upto >= ceil(total * 0.9::DOUBLE) THEN middle END), 6) AS p90 FROM c GROUP BY path, day""",
)
def latency_quantiles(v: Views):
    """Median and 90th percentile of the seconds per path and day, from sketches that merge."""
    calls = v.calls.withColumn("day", F.col("ts").cast("date").cast("string"))
    out = aggregates.sketch_quantiles(aggregates.quantile_sketch(calls, ["path", "day"], "seconds"), ["path", "day"], {"p50": 0.5, "p90": 0.9})
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p90")})


@query(
    "text_stats",
    r"""SELECT lang, source, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(strlen(replace(text, ' ', ''))) AS BIGINT) AS n_bytes_no_space,
          CAST(sum(w) AS BIGINT) AS n_words, CAST(sum(CASE WHEN s = 0 AND w > 0 THEN 1 ELSE s END) AS BIGINT) AS n_sentences,
          CAST(sum(p) AS BIGINT) AS n_paragraphs, round(sum(w / 200.0::DOUBLE), 4) AS minutes
        FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w,
                len(regexp_extract_all(text, '[.!?]+')) AS s,
                len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS p FROM documents)
        GROUP BY 1, 2""",
)
def text_stats(v: Views):
    return aggregates.text_stats(v.table("documents"), "text", ["lang", "source"]).withColumn("minutes", F.round("minutes", 4))


@query(
    "tool_usage",
    """WITH a AS (SELECT run_id, tool, coalesce(lower(trim(json_extract_string(arguments, '$.query'))), arguments) AS args, count(*) AS n,
               sum(success::INT) AS ok FROM v_tool_calls GROUP BY 1, 2, 3),
       t AS (SELECT run_id, tool, sum(n) AS n, sum(ok) AS ok, sum((n >= 3)::INT) AS repeats FROM a GROUP BY 1, 2)
       SELECT run_id, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(ok) AS BIGINT) AS successes, count(*) AS tools, CAST(sum(repeats) AS BIGINT) AS repeats FROM t GROUP BY 1""",
)
def tool_usage(v: Views):
    return aggregates.tool_usage(v.tool_calls)


# windows


@query(
    "rank_in_list",
    """SELECT * FROM (SELECT qid, list, id, row_number() OVER (PARTITION BY qid, list ORDER BY score DESC, id) AS rank FROM (
         SELECT user_id AS qid, event_type AS list, 'ev-' || event_id AS id, value AS score FROM events))""",
)
def rank_in_list(v: Views):
    hits = v.event_logs.select(F.col("owner").alias("qid"), F.col("source").alias("list"), "id", "score")
    return long(sequences.rank_in_list(hits).drop("score"), "rank")


def budget_sql(lines: str, budget: int, gap: int, noun: str | None) -> str:
    fits = f"""WITH l AS ({lines}), r AS (SELECT ctx, line, row_number() OVER w AS pos,
        sum(length(line) + {gap}) OVER (PARTITION BY ctx ORDER BY ts DESC, id ROWS UNBOUNDED PRECEDING) AS used
        FROM l WINDOW w AS (PARTITION BY ctx ORDER BY ts DESC, id)),
      f AS (SELECT ctx, pos, line FROM r WHERE used <= {budget})
      SELECT ctx, pos, line FROM f"""
    if noun is None:
        return fits
    return fits + f""" UNION ALL SELECT ctx, shown + 1, '... and ' || (n - shown) || ' more {noun} (truncated)' FROM (
        SELECT l.ctx, count(*) AS n, coalesce((SELECT max(pos) FROM f WHERE f.ctx = l.ctx), 0) AS shown FROM l GROUP BY l.ctx) WHERE n > shown"""


@query(
    "char_budget",
    budget_sql(
        """SELECT source AS ctx, id, ts, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] (' || source || ') ' || content ||
             CASE WHEN image_url <> '' THEN chr(10) || '[Attached image]' || chr(10) || '[Entry UUID: ' || id || ']' ELSE '' END AS line FROM v_entries""",
        10000, 1, "entries",
    ),
)
def char_budget(v: Views):
    e = v.entries
    line = sequences.entry_line(F.col("ts"), F.col("source"), F.col("content"), F.col("image_url"), F.lit(""), F.col("id"))
    rows = e.select(F.col("source").alias("ctx"), "id", "ts", line.alias("line"))
    return long(sequences.char_budget(rows, 10000, [F.desc("ts"), F.asc("id")]), "pos")


@query(
    "char_budget_queries",
    budget_sql(
        """SELECT 'c' || (conv_id % 10) AS ctx, id, ts, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] (chat)' || chr(10) || '  Q: ' || question || chr(10) || '  A: ' ||
             CASE WHEN length(answer) > 300 THEN substring(answer, 1, 300) || '...' ELSE answer END AS line FROM v_queries""",
        10000, 2, "queries",
    ),
)
def char_budget_queries(v: Views):
    line = sequences.query_line(F.col("ts"), F.col("source"), F.col("question"), F.col("answer"))
    rows = v.queries.select(F.concat(F.lit("c"), F.col("conv_id") % 10).alias("ctx"), "id", "ts", line.alias("line"))
    return long(sequences.char_budget(rows, 10000, [F.desc("ts"), F.asc("id")], gap=2, noun="queries"), "pos")


@query(
    "char_budget_tasks",
    budget_sql(
        """SELECT entry_id AS ctx, id, ts, '[' || id || '] status=' || status || ' due=(not set) | ' || substring(content, 1, 120) AS line FROM v_tasks""",
        400, 0, None,
    ),
)
def char_budget_tasks(v: Views):
    line = sequences.task_line(F.col("id"), F.col("status"), F.lit(""), F.col("content"))
    rows = v.tasks.select(F.col("entry_id").alias("ctx"), "id", "ts", line.alias("line"))
    return long(sequences.char_budget(rows, 400, [F.desc("ts"), F.asc("id")], gap=0, noun=None), "pos")


@query(
    "first_occurrence",
    """SELECT subject_id, predicate, object_id, arg_min(entry_id, (ts, entry_id)) AS entry_id FROM v_observations GROUP BY 1, 2, 3""",
)
def first_occurrence(v: Views):
    return sequences.first_occurrence(
        v.observations, ["subject_id", "predicate", "object_id"], ["ts", "entry_id"], ["entry_id"]
    )


@query(
    "recent_turns",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY back DESC) AS pos, strftime(ts, '%H:%M') AS at,
         substring(question, 1, 100) AS question, substring(answer, 1, 150) AS answer FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, id DESC) AS back FROM v_queries) WHERE back <= 5""",
)
def recent_turns(v: Views):
    return long(sequences.recent_turns(v.queries, ["conv_id"]), "pos")


@query(
    "repeat_signature",
    """SELECT run_id, iteration, repeated_at, signature FROM (
         SELECT run_id, iteration, tool AS signature, lead(iteration) OVER w AS repeated_at, lead(tool) OVER w AS nxt
         FROM v_tool_calls WINDOW w AS (PARTITION BY run_id ORDER BY iteration)) WHERE signature = nxt""",
)
def repeat_signature(v: Views):
    return sequences.repeat_signature(v.tool_calls.select("run_id", "iteration", F.col("tool").alias("signature")))


@query(
    "next_question",
    """SELECT client, arg_min(id, (CASE WHEN hit THEN 0 ELSE 1 END, -epoch_us(created), id)) AS id,
         bool_or(hit) AS hit FROM (
         SELECT *, kind = 'contradiction' AND ask_count > 3 AS hit,
           ask_count = 0 OR epoch_us(TIMESTAMP '2024-01-06') - epoch_us(last_asked) >= least(30, pow(2, ask_count - 1)) * 86400000000 AS due
         FROM v_questions WHERE resolved IS NULL) WHERE hit OR due GROUP BY client""",
)
def next_question(v: Views):
    q = v.questions
    mentioned = q.filter((F.col("kind") == "contradiction") & (F.col("ask_count") > 3)).select("client", "id")
    return sequences.next_question(q, ntz("2024-01-06 00:00:00"), mentioned)


@query("qa_pairs", "SELECT id, conv_id, turn, question, answer, is_gap FROM v_queries")
def qa_pairs(v: Views):
    return v.queries.select("id", "conv_id", "turn", "question", "answer", "is_gap")


# top-k


@query("top_by_weight", "SELECT id, weight FROM v_nodes WHERE node_type <> 'log' ORDER BY weight DESC, id LIMIT 20")
def top_by_weight(v: Views):
    return filters.top_by_weight(knowledge(v.nodes), 20).select("id", "weight")


ORDERS = "list_transform(range(0, 8), lambda i: ((vec_id * 7 + i * 5) % 14) - 1)"


@query(
    "apply_external_order",
    f"""WITH h AS ({knn_sql(10)}), o AS (
          SELECT qid, idx, min(pos) AS pos FROM (
            SELECT qid, unnest({ORDERS}) AS idx, generate_subscripts({ORDERS}, 1) AS pos FROM v_search WHERE vec_id % 4 > 0) GROUP BY 1, 2),
        j AS (SELECT h.qid, h.id, h.rank, pos, max(pos) OVER (PARTITION BY h.qid) AS any_pos FROM h LEFT JOIN o ON o.qid = h.qid AND o.idx = h.rank)
        SELECT qid, id, old_rank, rank FROM (
          SELECT qid, id, rank AS old_rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN any_pos IS NULL THEN rank ELSE pos END) AS rank
          FROM j WHERE any_pos IS NULL OR pos IS NOT NULL) WHERE rank <= 5""",
)
def apply_external_order(v: Views):
    s = v.search_inputs
    hits = nearest(s, knowledge(v.nodes), 10)
    i = F.sequence(F.lit(0), F.lit(7))
    indices = F.transform(i, lambda k: (((F.col("vec_id") * 7 + k * 5) % 14) - 1).cast("int"))
    orders = s.filter(F.col("vec_id") % 4 > 0).select("qid", indices.alias("indices"))
    return long(rank.external_order(hits, orders, 5), "rank", "old_rank")


# set operations

#: Rows of a key in time order: a row is created unless the last created one is at most 30 s older.
REPLAYED = """
  numbered AS (SELECT id, epoch_us(ts) AS us, row_number() OVER w AS n, dense_rank() OVER (ORDER BY {key}) AS k
               FROM ({source}) WINDOW w AS (PARTITION BY {key} ORDER BY ts, id)),
  replayed AS (
    SELECT id, k, n, us AS last_us, id AS created_id FROM numbered WHERE n = 1
    UNION ALL
    SELECT x.id, x.k, x.n, CASE WHEN x.us - r.last_us > 30000000 THEN x.us ELSE r.last_us END,
           CASE WHEN x.us - r.last_us > 30000000 THEN x.id ELSE r.created_id END
    FROM replayed r JOIN numbered x ON x.k = r.k AND x.n = r.n + 1) """


@query(
    "recent_questions",
    "SELECT id, question FROM v_questions WHERE resolved IS NULL OR created >= TIMESTAMP '2024-01-02'",
)
def recent_questions(v: Views):
    q = v.questions
    out = dedup.recent_questions(filters.unresolved(q, None), filters.resolved(q, "2024-01-02 00:00:00"))
    return out.select("id", "question")


@query(
    "rrf_fuse",
    f"""WITH a AS ({knn_sql(50, "n.node_type <> 'log' AND n.weight >= 0.5")}),
        b AS (SELECT * FROM (SELECT s.qid, n.id, row_number() OVER (PARTITION BY s.qid ORDER BY n.ts DESC, n.id) AS rank FROM v_search s JOIN v_nodes n
              ON n.node_type <> 'log' AND s.query <> '' AND contains(lower(n.content || chr(10) || n.metadata), lower(split_part(s.query, ' ', 1)))
              AND contains(lower(n.content || chr(10) || n.metadata), lower(split_part(s.query, ' ', 2)))) WHERE rank <= 50),
        f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, id, rank FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
        SELECT qid, id, round(score, 9) AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 20""",
)
def rrf_fuse(v: Views):
    s, n = stage(v.search_inputs.select("qid", "query", "embedding"), "queries"), v.nodes
    vectors = nearest(s, knowledge(n).filter(F.col("weight") >= 0.5), 50)
    out = rank.rrf_fuse([vectors, keyword_hits(s, n, 50)], 20)
    return long(out.withColumn("score", F.round("score", 9)), "rank")


@query(
    "merge_neighbours",
    f"""WITH d AS ({knn_sql(10)}), root AS (SELECT qid, 'node-' || vec_id AS id FROM v_search),
        n AS (SELECT count(*) AS n FROM embeddings),
        u AS (SELECT qid, id, 0 AS part FROM d UNION ALL SELECT qid, 'node-' || ((vec_id + k) % n), 1 FROM v_search, n, (SELECT unnest([1, 2, 3]) AS k))
        SELECT qid, id, min(part) AS part FROM u WHERE (qid, id) NOT IN (SELECT (qid, id) FROM root) GROUP BY 1, 2""",
)
def merge_neighbours(v: Views):
    s = v.search_inputs
    found = nearest(s, knowledge(v.nodes), 10)
    root = s.select("qid", F.concat(F.lit("node-"), "vec_id").alias("id"))
    _, links = linked_nodes(v)
    linked = root.join(links, "id").select("qid", F.col("target_id").alias("id"))
    return dedup.merge_neighbours([found, linked], root)


@query(
    "semantic_anti_join",
    """SELECT qid FROM v_near q WHERE NOT EXISTS (
         SELECT 1 FROM embeddings n WHERE round(list_cosine_similarity(q.embedding, n.embedding::DOUBLE[]), 6) >= 0.85)""",
)
def semantic_anti_join(v: Views):
    existing = v.table("embeddings").select(F.concat(F.lit("pq-"), "vec_id").alias("id"), "embedding")
    return dedup.semantic_anti_join(v.near, existing).select("qid")


@query(
    "similar_open_task",
    f"""WITH t AS (SELECT 'task-' || vec_id AS id, vec_id % 3 AS s, embedding FROM embeddings),
        h AS ({knn_sql(1, "n.s < 2", "v_near", "t", 0.85)})
        SELECT qid, id, score FROM h""",
)
def similar_open_task(v: Views):
    status = F.element_at(F.array(*map(F.lit, ["pending", "active", "completed"])), (F.col("vec_id") % 3 + 1).cast("int"))
    tasks = v.table("embeddings").select(F.concat(F.lit("task-"), "vec_id").alias("id"), status.alias("status"), "embedding")
    return dedup.similar_open_task(v.near, tasks)


@query(
    "recent_duplicate_task",
    "WITH RECURSIVE " + REPLAYED.format(key="user_id % 5, event_type", source="SELECT 'ev-' || event_id AS id, * FROM events") + "SELECT id, created_id AS duplicate_of FROM replayed WHERE id <> created_id",
)
def recent_duplicate_task(v: Views):
    tasks = v.event_logs.select(
        "id", F.concat(F.lit("entry-"), F.col("owner") % 5).alias("entry_id"),
        F.concat(F.lit(" Do  "), "source").alias("content"), "ts",
    )
    return dedup.recent_duplicate_task(tasks)
