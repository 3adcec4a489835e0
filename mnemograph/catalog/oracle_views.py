"""DuckDB twins of the Spark views, as named queries that oracle SQL can refer to."""

import re

NODE_TYPES = "['person','place','project','goal','preference','event','asset','tool','generic','log']"

VIEWS = {
    "v_entries": """
        SELECT 'log-' || doc_id AS id, 'log' AS node_type, text AS content, source,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS ts, 0.3 AS weight,
               CASE WHEN doc_id % 10 = 0 THEN 'img-' || doc_id ELSE '' END AS image_url
        FROM documents""",
    "v_event_logs": """
        SELECT 'ev-' || event_id AS id, event_type AS source, ts, user_id AS owner, value AS score, props AS metadata
        FROM events""",
    "v_queries": """
        SELECT 'qry-' || conv_id || '-' || turn AS id, conv_id, turn, text AS question,
               CASE WHEN nrole = 'assistant' THEN ntext ELSE '' END AS answer, 'chat' AS source,
               coalesce(nrole, '') <> 'assistant' AS is_gap,
               TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS ts
        FROM (SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS ntext
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user'""",
    "v_questions": """
        SELECT 'pq-' || conv_id || '-' || turn AS id, question,
               ['gap','contradiction','task_proposal'][turn % 3 + 1] AS kind,
               'conversation ' || conv_id AS context, conv_id % 6 AS ask_count,
               CASE WHEN conv_id % 6 > 0 THEN TIMESTAMP '2024-01-01' + to_days(turn::INT) END AS last_asked,
               ts AS created, CASE WHEN NOT is_gap THEN ts + INTERVAL 1 HOUR END AS resolved, answer,
               'client-' || (conv_id % 50) AS client,
               conv_id % (SELECT count(*) FROM embeddings) AS vec_id
        FROM v_queries""",
    "v_nodes": f"""
        SELECT 'node-' || vec_id AS id, vec_id, {NODE_TYPES}[label + 1] AS node_type,
               coalesce(text, '') AS content,
               CASE WHEN label IN (2, 3)
                    THEN '{{"status": "' || ['active','archived','blocked','done','planning','pending','completed'][vec_id % 7 + 1] || '"}}'
                    ELSE '{{"category": "' || ['food','Tech','garden','home'][vec_id % 4 + 1] || '", "type": "'
                         || ['work','Software','party'][vec_id % 3 + 1] || '", "extra": ' || vec_id || '}}' END AS metadata,
               round(0.1 * (1 + vec_id % 9), 1)::DOUBLE AS weight,
               TIMESTAMP '2024-01-01' - to_days(vec_id::INT) AS ts, embedding
        FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "v_search": r"""
        SELECT 'q-' || vec_id AS qid, vec_id,
               array_to_string(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')[1:2], ' ') AS query,
               embedding, ts AS query_ts
        FROM v_nodes""",
    "v_near": f"""
        SELECT 'cand-' || a.vec_id AS qid, a.vec_id, {NODE_TYPES}[a.label + 1] AS node_type,
               list_transform(range(1, len(a.embedding) + 1),
                 lambda i: a.embedding[i]::DOUBLE + (0.1::DOUBLE * (1 + a.vec_id % 10)) * b.embedding[i]::DOUBLE) AS embedding
        FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
    "v_relationships": """
        SELECT 'rel_' || sha1(subject_id || ':' || predicate || ':' || object_id) AS id, 'relationship' AS node_type,
               subject_id || ' ' || predicate || ' ' || object_id AS content, subject_id, predicate, object_id,
               [subject_id, object_id] AS entity_links, ts, 0.8::DOUBLE AS weight
        FROM (
          SELECT 'cust-' || c_custkey AS subject_id, 'lives_in' AS predicate, 'nat-' || c_nationkey AS object_id, TIMESTAMP '2024-01-01' AS ts FROM customer
          UNION ALL SELECT 'supp-' || s_suppkey, 'located_in', 'nat-' || s_nationkey, TIMESTAMP '2024-01-01' FROM supplier
          UNION ALL SELECT 'nat-' || n_nationkey, 'located_in', 'reg-' || n_regionkey, TIMESTAMP '2024-01-01' FROM nation
          UNION ALL SELECT 'cust-' || o_custkey, 'owns', 'ord-' || o_orderkey, o_orderdate FROM orders)""",
    "v_names": """
        SELECT 'cust-' || c_custkey AS id, c_name AS content, 'person' AS node_type, 0.55::DOUBLE AS weight, c_custkey AS k FROM customer
        UNION ALL SELECT 'supp-' || s_suppkey, s_name, 'person', 0.55, s_suppkey FROM supplier
        UNION ALL SELECT 'nat-' || n_nationkey, n_name, 'place', 0.55, n_nationkey FROM nation
        UNION ALL SELECT 'reg-' || r_regionkey, r_name, 'place', 0.55, r_regionkey FROM region
        UNION ALL SELECT 'ord-' || o_orderkey, o_orderpriority, 'asset', 0.55, o_orderkey FROM orders""",
    "v_graph_nodes": """
        SELECT e.*, embedding FROM v_names e JOIN embeddings ON vec_id = k % (SELECT count(*) FROM embeddings)
        UNION ALL SELECT id, content, node_type, weight, NULL, NULL FROM v_relationships""",
    "v_observations": """
        SELECT 'cust-' || c_custkey AS subject_id, 'lives in' AS predicate, 'nat-' || c_nationkey AS object_id,
               'ord-' || o_orderkey AS entry_id, o_orderdate AS ts
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_tasks": """
        SELECT 'task-' || o_orderkey AS id,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'task-' || (o_orderkey - o_orderkey % 5) END AS parent_id,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'pending' END AS status,
               o_orderpriority AS content, 'entry-' || o_custkey AS entry_id, o_orderdate AS ts,
               o_orderkey % (SELECT count(*) FROM embeddings) AS vec_id
        FROM orders""",
    "v_entities": """
        SELECT id, ts, category, unnest([name1, category]) AS name, unnest([type1, 'priority']) AS type,
               unnest([status1, 'Planned']) AS status, id AS source_id
        FROM (SELECT 'ord-' || o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS category, c_name AS name1, c_mktsegment AS type1,
                CASE o_orderstatus WHEN 'F' THEN 'Completed' ELSE 'In-Progress' END AS status1
              FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 9 > 0)""",
    "v_analysed": """
        SELECT 'ord-' || o_orderkey AS id, 'order placed, priority ' || o_orderpriority AS content, 'shop' AS source, o_orderdate AS ts,
               CASE WHEN o_orderkey % 9 > 0 THEN [c_mktsegment, o_orderstatus] END AS tags,
               CASE WHEN o_orderkey % 9 > 0 THEN 'order for ' || c_mktsegment END AS summary,
               CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS category
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "v_model_text": r"""
        SELECT 'log-' || doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN 'Owner ' || (doc_id % 5) ELSE '' END AS owner, w,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS ts, doc_id,
               w[1] AS w0, w[2] AS w1, w[3] AS w2, w[4] AS w3, w[5] AS w4
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)""",
    "v_calls": """
        SELECT 'call-' || event_id AS id,
               ['gemini-2.5-flash','models/gemini-1.5-pro','gemini-1.5-flash-8b','gemini-2.5-flash-lite-preview','unlisted-model'][event_id % 5 + 1] AS model,
               CASE WHEN event_id % 7 > 0 THEN round(value * 100)::BIGINT END AS prompt_tokens,
               CASE WHEN event_id % 7 > 0 THEN event_id % 500 END AS completion_tokens,
               strlen(props) * 100 AS input_bytes, user_id AS trace_id, event_type AS path, value AS seconds, ts
        FROM events""",
    "v_tool_calls": """
        SELECT 'run-' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, event_id AS iteration, event_type AS tool,
               CASE WHEN event_id % 2 = 0 THEN '{"query": " Topic ' || (event_id % 3) || ' "}' ELSE props END AS arguments,
               event_type <> 'error' AS success, ts
        FROM events""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    body = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    text = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            return f"{start}{body},\n{text[len(start):]}"
    return f"WITH {body}\n{text}"
