"""Named queries: vector search, ranking, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.catalog.registry import query
from mnemograph.catalog.relations import DISCOVERED, FOUND, knn_sql, long
from mnemograph.catalog.scans import identity_view
from mnemograph.functions import columns as C
from mnemograph.operators import graph, vector
from mnemograph.operators.rank import decay
from mnemograph.operators.skew import top_rows
from mnemograph.plans import reports, search
from mnemograph.session import stage
from mnemograph.sources.views import AS_OF, Views, ntz

AS_OF_SQL = "TIMESTAMP '2024-02-01'"


# vector search


@query(
    "cosine",
    "SELECT qid, round(list_cosine_similarity(q.embedding, n.embedding::DOUBLE[]), 6) AS sim FROM v_near q JOIN embeddings n USING (vec_id)",
)
def cosine(v: Views):
    base = v.table("embeddings").select("vec_id", F.col("embedding").alias("base"))
    return v.near.join(base, "vec_id").select("qid", F.round(vector.cosine(F.col("embedding"), F.col("base")), 6).alias("sim"))


@query("knn", knn_sql(10))
def knn(v: Views):
    return long(vector.nearest(v.search_inputs, search.knowledge(v.nodes), 10), "rank")


@query("knn_significant", knn_sql(20, "n.node_type <> 'log' AND n.weight >= 0.5"))
def knn_significant(v: Views):
    return long(vector.nearest(v.search_inputs, search.significant(v.nodes), 20), "rank")


@query("nearest_within", f"SELECT qid, id, score FROM ({knn_sql(1, queries='v_near', low=0.75)})")
def nearest_within(v: Views):
    return vector.nearest_one(v.near, search.knowledge(v.nodes), 0.25)


@query(
    "nearest_within_type",
    f"SELECT qid, id, score FROM ({knn_sql(1, 'n.node_type = q.node_type', 'v_near', low=0.85)})",
)
def nearest_within_type(v: Views):
    return vector.nearest_one_of_type(v.near, v.nodes, 0.15)


@query("threshold_join", f"SELECT qid, id, score FROM ({knn_sql(1, 'true', 'v_near', low=0.85)})")
def threshold_join(v: Views):
    """As two large sets are joined: balls around pivots, no side broadcast."""
    return vector.nearest(v.near, v.nodes, 1, min_score=0.85, broadcast_bytes=0, cell_rows=512).drop("rank")


@query("threshold_join_work")
def threshold_join_work(v: Views):
    """Pairs of the two sets, those that met in a ball, and those scored in full."""
    return vector.threshold_work(v.near, v.nodes, 0.85, cell_rows=512)


@query("knn_entries", knn_sql(10, "n.node_type = 'log'"))
def knn_entries(v: Views):
    return long(vector.nearest(v.search_inputs, v.nodes.filter(F.col("node_type") == "log"), 10), "rank")


@query("knn_tasks", knn_sql(10, "TRUE", corpus="(SELECT 'task-' || vec_id AS id, embedding FROM embeddings)"))
def knn_tasks(v: Views):
    tasks = v.table("embeddings").select(F.concat(F.lit("task-"), "vec_id").alias("id"), "embedding")
    return long(vector.nearest(v.search_inputs, tasks, 10), "rank")


@query("min_match", f"SELECT qid, id, score FROM ({knn_sql(20, queries='v_near')}) WHERE score >= 0.52")
def min_match(v: Views):
    hits = vector.nearest(v.near, search.knowledge(v.nodes), 20)
    return hits.filter(F.col("score") >= 0.52).select("qid", "id", "score")


@query("knn_lsh")
def knn_lsh(v: Views):
    return long(vector.nearest_lsh(v.near, search.knowledge(v.nodes), 10), "rank")


@query(
    "prune_candidates",
    """WITH n AS (SELECT count(*) AS n FROM embeddings),
        c AS (SELECT 'task-' || (o_custkey % (n + 1)) AS qid, 'ord-' || o_orderkey AS id, 0.1 * (o_orderkey % 7) AS weight,
                CASE WHEN o_orderkey % 97 = 3 THEN NULL ELSE e.embedding END AS embedding
              FROM orders, n, embeddings e WHERE e.vec_id = o_orderkey % n),
        q AS (SELECT 'task-' || vec_id AS qid, embedding FROM embeddings),
        s AS (SELECT c.qid, c.id, weight, CASE WHEN min((c.embedding IS NOT NULL)::INT) OVER (PARTITION BY c.qid) = 1 AND q.embedding IS NOT NULL
                THEN round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) ELSE 0 END AS sim FROM c LEFT JOIN q ON q.qid = c.qid)
        SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, weight DESC, id) AS rn FROM s) WHERE rn <= 8""",
)
def prune_candidates(v: Views):
    o, e, n = v.table("orders"), v.table("embeddings"), v.n_vectors
    k, owner = F.col("o_orderkey"), F.col("o_custkey")
    gap = k % 97 == 3
    rows = o.select(k, owner, (k % n).alias("vec_id")).join(e, "vec_id").select(
        F.concat(F.lit("task-"), owner % (n + 1)).alias("qid"), F.concat(F.lit("ord-"), k).alias("id"),
        (0.1 * (k % 7)).alias("weight"), F.when(~gap, F.col("embedding")).alias("embedding"),
    )
    vectors = e.select(F.concat(F.lit("task-"), "vec_id").alias("qid"), "embedding")
    return vector.prune(rows, None, vectors, 8)


# ranking

DECAYED = f"exp(-ln(2.0::DOUBLE) / 180 * greatest(0.0, (epoch_us({AS_OF_SQL}) - epoch_us(ts)) / 86400000000.0))"


@query(
    "temporal_bias",
    f"""WITH h AS ({knn_sql(20, "n.node_type <> 'log' AND n.weight >= 0.5")})
        SELECT qid, id, round(score, 9) AS score, rank FROM (
          SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (
            SELECT h.qid, h.id, h.score * {DECAYED} AS score FROM h JOIN v_nodes n ON n.id = h.id)) WHERE rank <= 10""",
)
def temporal_bias(v: Views):
    hits = vector.nearest(v.search_inputs, search.significant(v.nodes), 20)
    return long(decay(hits, v.nodes, ntz(AS_OF), 10).withColumn("score", F.round("score", 9)), "rank")


@query(
    "hybrid_search",
    f"""WITH a AS ({knn_sql(50, "n.node_type <> 'log' AND n.weight >= 0.5")}),
        b AS (SELECT * FROM (SELECT s.qid, n.id, row_number() OVER (PARTITION BY s.qid ORDER BY n.ts DESC, n.id) AS rank FROM v_search s JOIN v_nodes n
              ON n.node_type <> 'log' AND s.query <> '' AND contains(lower(n.content || chr(10) || n.metadata), lower(split_part(s.query, ' ', 1)))
              AND contains(lower(n.content || chr(10) || n.metadata), lower(split_part(s.query, ' ', 2)))) WHERE rank <= 50),
        f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, id, rank FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS r FROM f) WHERE r <= 20),
        d AS (SELECT t.qid, t.id, t.score * {DECAYED} AS score FROM t JOIN v_nodes n ON n.id = t.id)
        SELECT qid, id, round(score, 9) AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM d) WHERE rank <= 10""",
)
def hybrid_search(v: Views):
    out = search.hybrid_search(v.search_inputs, v.nodes, ntz(AS_OF))
    return long(out.withColumn("score", F.round("score", 9)), "rank")


# graph

ADJ = """adj AS (
  SELECT id AS node_id, object_id AS other, id AS source, object_id AS target, predicate, TRUE AS is_edge FROM v_relationships
  UNION ALL SELECT id, subject_id, NULL, NULL, NULL, FALSE FROM v_relationships
  UNION ALL SELECT node_id, other, source, target, predicate, TRUE FROM (
    SELECT *, row_number() OVER (PARTITION BY node_id, kind ORDER BY weight DESC, other) AS n FROM (
      SELECT object_id AS node_id, id AS other, id AS source, object_id AS target, predicate, 'spo' AS kind, weight FROM v_relationships
      UNION ALL SELECT link, id, id, link, 'incoming_link', 'link', weight FROM (SELECT id, weight, unnest(entity_links) AS link FROM v_relationships)))
    WHERE n <= {cap}
  UNION ALL SELECT id, link, id, link, 'entity_link', pos <= {cap} FROM (SELECT id, unnest(entity_links) AS link, generate_subscripts(entity_links, 1) AS pos FROM v_relationships))"""


def expand_sql(hops: int, cap: int, seeds: str, vectors: str) -> str:
    """CTEs of an unrolled expansion: found(qid, id, hop) and walked(qid, source, target, predicate, hop)."""
    parts = [
        ADJ.format(cap=cap),
        f"seeds AS ({seeds})",
        f"qvec AS ({vectors})",
        "front0 AS (SELECT DISTINCT qid, id FROM seeds)",
        "vis0 AS (SELECT * FROM front0)",
    ]
    found = ["SELECT f.qid, f.id, 0 AS hop FROM front0 f JOIN v_graph_nodes g ON g.id = f.id"]
    walked = []
    for h in range(1, hops + 1):
        p = h - 1
        parts += [
            f"steps{h} AS (SELECT f.qid, a.* FROM front{p} f JOIN adj a ON a.node_id = f.id)",
            f"cand{h} AS (SELECT DISTINCT s.qid, s.other AS id FROM steps{h} s LEFT JOIN vis{p} v ON v.qid = s.qid AND v.id = s.other WHERE v.id IS NULL)",
            f"vis{h} AS (SELECT * FROM vis{p} UNION ALL SELECT * FROM cand{h})",
            f"""front{h} AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, weight DESC, id) AS rn FROM (
                  SELECT c.qid, c.id, coalesce(g.weight, 0) AS weight, CASE WHEN min((g.embedding IS NOT NULL)::INT) OVER (PARTITION BY c.qid) = 1 AND q.embedding IS NOT NULL
                    THEN round(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) ELSE 0 END AS sim
                  FROM cand{h} c JOIN v_graph_nodes g ON g.id = c.id LEFT JOIN qvec q ON q.qid = c.qid)) WHERE rn <= {cap})""",
        ]
        found.append(f"SELECT qid, id, {h} FROM front{h}")
        walked.append(f"SELECT qid, source, target, predicate, {h} AS hop FROM steps{h} WHERE is_edge")
    parts.append("found AS (" + " UNION ALL ".join(found) + ")")
    parts.append("walked AS (SELECT qid, source, target, predicate, min(hop) AS hop FROM (" + " UNION ALL ".join(walked) + ") GROUP BY 1, 2, 3, 4)")
    return "WITH " + ",\n".join(parts)


def resolve_sql(passes: int = 4) -> str:
    parts = ["res0 AS (SELECT qid, id, hop FROM found)"]
    for i in range(1, passes + 1):
        ends = f"SELECT r.qid, unnest([subject_id, object_id]) AS id FROM res{i-1} r JOIN v_relationships x ON x.id = r.id"
        asked = ends + (" UNION SELECT qid, unnest([source, target]) FROM walked" if i == 1 else "")
        parts.append(
            f"res{i} AS (SELECT * FROM res{i-1} UNION ALL SELECT DISTINCT a.qid, a.id, NULL FROM ({asked}) a "
            f"JOIN (SELECT id FROM v_graph_nodes) g ON g.id = a.id LEFT JOIN res{i-1} r ON r.qid = a.qid AND r.id = a.id WHERE r.id IS NULL)"
        )
    return ",\n".join(parts) + f",\nmembers AS (SELECT * FROM res{passes})"


SEEDS = "SELECT 'cust-' || c_custkey AS qid, 'cust-' || c_custkey AS id FROM customer"
VECTORS = "SELECT id AS qid, embedding FROM v_graph_nodes WHERE id LIKE 'cust-%'"


def customer_seeds(v: Views):
    seeds = v.table("customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("qid"))
    seeds = seeds.withColumn("id", F.col("qid"))
    vectors = v.graph_nodes.filter(F.col("id").startswith("cust-")).select(F.col("id").alias("qid"), "embedding")
    return seeds, vectors


_GRAPHS: dict[tuple[str, str], object] = {}
_LAYOUTS: dict[tuple[str, str, int], graph.Layout] = {}


def graph_table(v: Views):
    """The node table of a folder, written once for all traversals of a session."""
    key = (v.spark.sparkContext.applicationId, v.folder)
    if key not in _GRAPHS:
        _GRAPHS[key] = stage(v.graph_nodes, "graph")
    return _GRAPHS[key]


def layout(v: Views, per_kind: int) -> graph.Layout:
    key = (v.spark.sparkContext.applicationId, v.folder, per_kind)
    if key not in _LAYOUTS:
        _LAYOUTS[key] = graph.lay_out(graph_table(v), per_kind)
    return _LAYOUTS[key]


@query(
    "edges_view",
    """SELECT id AS node_id, object_id AS other, 'object' AS kind, predicate FROM v_relationships
       UNION ALL SELECT id, subject_id, 'subject', NULL FROM v_relationships
       UNION ALL SELECT object_id, id, 'incoming_triple', predicate FROM v_relationships
       UNION ALL SELECT unnest(entity_links), id, 'incoming_link', 'incoming_link' FROM v_relationships
       UNION ALL SELECT id, unnest(entity_links), 'entity_link', 'entity_link' FROM v_relationships""",
)
def edges_view(v: Views):
    return graph.edges(v.graph_nodes).select("node_id", "other", "kind", "predicate")


@query(
    "graph_expand",
    expand_sql(2, 8, SEEDS, VECTORS)
    + " SELECT qid, 'node' AS part, id, '' AS predicate, '' AS target, hop FROM found UNION ALL SELECT qid, 'edge', source, predicate, target, hop FROM walked",
)
def graph_expand(v: Views):
    seeds, vectors = customer_seeds(v)
    found, walked = graph.expand(graph_table(v), seeds, vectors, 2, 8, layout(v, 8))
    blank = F.lit("")
    nodes = found.select("qid", F.lit("node").alias("part"), "id", blank.alias("predicate"), blank.alias("target"), "hop")
    edges = walked.select("qid", F.lit("edge").alias("part"), F.col("source").alias("id"), "predicate", "target", "hop")
    return nodes.unionByName(edges)


@query(
    "resolve_dangling",
    expand_sql(1, 8, SEEDS, VECTORS) + ",\n" + resolve_sql() + " SELECT qid, id, hop FROM members",
)
def resolve_dangling(v: Views):
    nodes = graph_table(v)
    seeds, vectors = customer_seeds(v)
    found, walked = graph.expand(nodes, seeds, vectors, 1, 8, layout(v, 8))
    return graph.resolve_dangling(nodes, found, walked)


@query("relationship_edges", "SELECT DISTINCT subject_id, predicate, object_id FROM v_relationships")
def relationship_edges(v: Views):
    return graph.relationship_edges(v.graph_nodes)


@query(
    "relationship_members",
    """SELECT id, node_type, content, id LIKE 'nat-%' AS is_seed FROM v_graph_nodes
       WHERE id IN (SELECT subject_id FROM v_relationships UNION SELECT object_id FROM v_relationships)""",
)
def relationship_members(v: Views):
    seeds = v.table("nation").select(F.concat(F.lit("nat-"), "n_nationkey").alias("id"))
    return graph.relationship_members(v.graph_nodes, seeds)


LABELLED = """lab AS (SELECT m.qid, m.id, hop, node_type, weight, upper(node_type[1]) || node_type[2:] || '[' ||
    CASE WHEN strlen(content) > 60 THEN left(content, 57) || '...' ELSE content END || ']' AS label FROM members m JOIN v_graph_nodes g ON g.id = m.id)"""


@query(
    "subgraph_report",
    expand_sql(1, 8, SEEDS, VECTORS) + ",\n" + resolve_sql() + ",\n" + LABELLED + """,
      tri AS (SELECT l.qid, subject_id AS source, predicate, object_id AS target, min(l.id) AS id, bool_or(coalesce(hop = 0, false)) AS is_seed
              FROM lab l JOIN v_relationships r ON r.id = l.id GROUP BY 1, 2, 3, 4),
      lines AS (SELECT * FROM tri UNION ALL SELECT w.qid, w.source, w.predicate, w.target, '', false FROM walked w
                LEFT JOIN tri t ON t.qid = w.qid AND t.source = w.source AND t.predicate = w.predicate AND t.target = w.target WHERE t.qid IS NULL)
      SELECT qid, 'entity' AS section, id, label || CASE WHEN weight > 0 THEN format(' (sig:{:.1f})', weight) ELSE '' END AS text, coalesce(hop = 0, false) AS is_seed
      FROM lab WHERE node_type NOT IN ('relationship', 'log', 'response')
      UNION ALL SELECT l.qid, 'relationship', l.id, coalesce(s.label, l.source) || ' -> ' || l.predicate || ' -> ' || coalesce(t.label, l.target), l.is_seed
      FROM lines l LEFT JOIN lab s ON s.qid = l.qid AND s.id = l.source LEFT JOIN lab t ON t.qid = l.qid AND t.id = l.target""",
)
def subgraph_report(v: Views):
    nodes = graph_table(v)
    seeds, vectors = customer_seeds(v)
    found, walked = graph.expand(nodes, seeds, vectors, 1, 8, layout(v, 8))
    return graph.subgraph_report(nodes, graph.resolve_dangling(nodes, found, walked), walked)


HITS = knn_sql(
    5, "n.node_type <> 'log' AND n.weight >= 0.5 AND n.embedding IS NOT NULL",
    "(SELECT qid, embedding FROM v_near)", "v_graph_nodes", 0.52,
)


@query(
    "seeded_subgraph",
    expand_sql(1, 10, f"SELECT qid, id FROM ({HITS})", "SELECT qid, embedding FROM v_near")
    + ",\n" + resolve_sql() + " SELECT qid, id, hop FROM members",
)
def seeded_subgraph(v: Views):
    members, _ = search.seeded_subgraph(v.near, graph_table(v), limit=5, layout=layout(v, 10))
    return members


def rag_tables(v: Views):
    """Graph nodes with times, and the orders a triple or entity was seen in."""
    nodes = graph_table(v)
    evidence = v.relationships.filter(F.col("predicate") == "owns").select("id", F.col("object_id").alias("target_id"))
    entries = v.table("orders").select(
        F.concat(F.lit("ord-"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("content")
    )
    return nodes, evidence, entries


RAG_AS_OF = "2024-02-01 00:00:00"


@query(
    "rag_context",
    expand_sql(2, 8, SEEDS, VECTORS) + ",\n" + resolve_sql() + f""",
      m AS (SELECT mm.qid, mm.id, mm.hop, g.node_type, g.content, g.weight FROM members mm JOIN v_graph_nodes g ON g.id = mm.id),
      rel AS (SELECT m.qid, m.id, coalesce(nullif(s.content, ''), r.subject_id) AS sl, r.predicate, coalesce(nullif(o.content, ''), r.object_id) AS ol,
                -round({DECAYED.replace('epoch_us(ts)', 'epoch_us(r.ts)')}, 6) AS key
              FROM m JOIN v_relationships r ON r.id = m.id LEFT JOIN m s ON s.qid = m.qid AND s.id = r.subject_id LEFT JOIN m o ON o.qid = m.qid AND o.id = r.object_id)
      SELECT qid, CASE WHEN hop = 0 THEN 'seed' ELSE 'neighbour' END AS section, id, content AS text, -weight AS key FROM m WHERE node_type NOT IN ('relationship', 'log', 'response')
      UNION ALL SELECT qid, 'relationship', arg_min(id, (key, id)), sl || ' -> ' || predicate || ' -> ' || ol, min(key) FROM rel GROUP BY qid, sl, predicate, ol
      UNION ALL SELECT qid, 'entry', 'ord-' || o_orderkey, '[ord-' || o_orderkey || '] ' || strftime(o_orderdate, '%Y-%m-%d') || ': ' || o_orderpriority, epoch_us(o_orderdate)::DOUBLE
      FROM (SELECT DISTINCT m.qid, r.object_id FROM m JOIN v_relationships r ON r.id = m.id WHERE r.predicate = 'owns') x JOIN orders ON 'ord-' || o_orderkey = object_id""",
)
def rag_context(v: Views):
    nodes, evidence, entries = rag_tables(v)
    seeds, vectors = customer_seeds(v)
    return search.rag_context(vectors, nodes, evidence, entries, ntz(RAG_AS_OF), seeds, layout=layout(v, 8))


@query(
    "entity_network",
    f"""WITH nn AS (SELECT count(*) AS n FROM embeddings),
      links AS (SELECT id, 'node-' || ((vec_id + k) % n) AS other FROM v_nodes, nn, (SELECT unnest([1, 2, 3]) AS k)),
      root AS (SELECT qid, id FROM ({FOUND})),
      disc AS (SELECT qid, id FROM ({DISCOVERED})),
      inc AS (SELECT target, id FROM (SELECT other AS target, id, row_number() OVER (PARTITION BY other ORDER BY id) AS rn FROM links) WHERE rn <= 20),
      merged AS (SELECT DISTINCT qid, id FROM (
          SELECT d.qid, d.id FROM disc d JOIN root USING (qid)
          UNION SELECT r.qid, l.other FROM root r JOIN links l ON l.id = r.id
          UNION SELECT r.qid, i.id FROM root r JOIN inc i ON i.target = r.id) WHERE (qid, id) NOT IN (SELECT (qid, id) FROM root)),
      ev AS (SELECT DISTINCT r.qid, e.id, e.ts, e.content FROM root r JOIN v_nodes n ON n.id = r.id JOIN v_entries e
          ON e.id IN ('log-' || n.vec_id, 'log-' || ((n.vec_id * 3 + 1) % nn_docs)) , (SELECT 1)),
      rec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ts DESC, id) AS rn FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 20 DAY)
      SELECT r.qid, 'PRIMARY' AS part, r.id, n.content AS text FROM root r JOIN v_nodes n ON n.id = r.id
      UNION ALL SELECT r.qid, 'METADATA', r.id, n.metadata FROM root r JOIN v_nodes n ON n.id = r.id WHERE n.metadata NOT IN ('', '{{}}') AND n.vec_id % 5 > 0
      UNION ALL SELECT m.qid, CASE WHEN n.vec_id % 2 = 0 THEN 'RELATION' ELSE 'FACT' END, m.id, n.content FROM merged m JOIN v_nodes n ON n.id = m.id
      UNION ALL SELECT qid, 'ENTRY', id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || CASE WHEN length(content) > 200 THEN substring(content, 1, 197) || '...' ELSE content END FROM rec WHERE rn <= 50
      UNION ALL SELECT qid, 'OMITTED', '', CAST(n - least(r, 50) AS VARCHAR) FROM (SELECT qid, count(*) AS n, count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 20 DAY) AS r FROM ev GROUP BY qid) WHERE n - least(r, 50) > 0
      """.replace("nn_docs", "(SELECT count(*) FROM documents)").replace(" , (SELECT 1))", ")"),
)
def entity_network(v: Views):
    n, docs = v.n_vectors, v.table("documents").count()
    vec = F.col("vec_id")
    target = lambda step: F.concat(F.lit("node-"), (vec + step) % n)
    nodes = v.nodes.select(
        "id", "vec_id", "node_type", "content", "weight", "embedding", F.when(vec % 5 > 0, F.col("metadata")).otherwise("{}").alias("metadata"),
        F.when(vec % 2 == 0, "knows").alias("predicate"), F.lit("").alias("object_id"),
        F.array(target(1), target(2), target(3)).alias("entity_links"),
    )
    log = lambda x: F.concat(F.lit("log-"), x)
    evidence = nodes.select("id", F.explode(F.array(log(vec), log((vec * 3 + 1) % docs))).alias("target_id"))
    queries = v.search_inputs.withColumn("name", F.col("query"))
    return search.entity_network(queries, nodes, evidence, v.entries, ntz(AS_OF), days=20)


@query(
    "project_timeline",
    f"""WITH q AS (SELECT 'q-' || vec_id AS qid, ['urgent', 'Customer#00000012', ' Medium ', 'bolt'][vec_id % 4 + 1] AS name, embedding FROM embeddings),
      p AS ({knn_sql(1, "n.node_type IN ('project', 'goal')", 'q')}),
      f AS (SELECT q.qid, n.id, n.content, json_extract_string(n.metadata, '$.status') AS status FROM q LEFT JOIN p ON p.qid = q.qid LEFT JOIN v_nodes n ON n.id = p.id),
      act AS (SELECT q.name, a.id, a.ts, a.summary, row_number() OVER (PARTITION BY q.name ORDER BY a.ts DESC, a.id) AS rn
              FROM (SELECT DISTINCT name FROM q) q JOIN v_analysed a ON a.id IN (SELECT id FROM v_entities e WHERE contains(lower(e.name), trim(lower(q.name))))
              WHERE a.ts >= TIMESTAMP '1998-01-01' AND a.ts < TIMESTAMP '1998-07-01')
      SELECT qid, 'status' AS part, coalesce(id, '') AS id, '' AS day, CASE WHEN id IS NULL THEN 'Not found in knowledge' ELSE coalesce(status, 'Unknown') END AS text FROM f
      UNION ALL SELECT qid, 'briefing', coalesce(id, ''), '', coalesce(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '(No knowledge node for this project.)') FROM f
      UNION ALL SELECT q.qid, 'activity', act.id, strftime(act.ts, '%Y-%m-%d'), act.summary FROM q JOIN act ON act.name = q.name WHERE rn <= 100""",
)
def project_timeline(v: Views):
    e = v.table("embeddings")
    name = F.element_at(F.array(*map(F.lit, ["urgent", "Customer#00000012", " Medium ", "bolt"])), (F.col("vec_id") % 4 + 1).cast("int"))
    queries = e.select(F.concat(F.lit("q-"), "vec_id").alias("qid"), name.alias("name"), "embedding")
    return search.project_timeline(queries, v.nodes, v.analysed, "1998-01-01", "1998-06-30")


# periodic inputs


@query(
    "context_blocks",
    """SELECT 'identity' AS section, id, content AS text FROM (SELECT * FROM v_nodes WHERE node_type = 'preference' ORDER BY ts DESC, id LIMIT 20)
       UNION ALL SELECT 'conversation', id, strftime(ts, '%H:%M') || ' User: ' || substring(question, 1, 100) || chr(10) || '      Asst: ' || substring(answer, 1, 150)
         FROM (SELECT * FROM v_queries ORDER BY ts DESC, id LIMIT 5)
       UNION ALL SELECT 'signal', id, '- [' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || content FROM (SELECT * FROM v_nodes WHERE node_type = 'event' AND content <> '' ORDER BY ts DESC, id LIMIT 3)
       UNION ALL SELECT 'gap', id, '- ' || substring(question, 1, 120) FROM (SELECT * FROM v_queries WHERE is_gap ORDER BY ts DESC, id LIMIT 3)
       UNION ALL SELECT 'summary', id, '[' || strftime(ts, '%Y-%m-%d') || ']: ' || content FROM (SELECT * FROM v_nodes WHERE node_type = 'generic' AND content <> '' ORDER BY ts DESC, id LIMIT 3)
       UNION ALL SELECT 'project', id, '[' || status || '] ' || content FROM (
         WITH o AS (SELECT * FROM v_tasks WHERE status IN ('pending', 'active')), roots AS (SELECT * FROM o WHERE parent_id = '' ORDER BY ts DESC, id LIMIT 15),
           c AS (SELECT * FROM roots WHERE id IN (SELECT parent_id FROM o) ORDER BY ts DESC, id LIMIT 1)
         SELECT * FROM c UNION ALL SELECT * FROM (SELECT * FROM o WHERE parent_id IN (SELECT id FROM c) ORDER BY ts, id LIMIT 10))""",
)
def context_blocks(v: Views):
    return reports.context_blocks(identity_view(v), v.queries, v.tasks).drop("key")


@query(
    "briefing_inputs",
    """SELECT 'entry' AS part, id, row_number() OVER (ORDER BY ts, id) AS rank, content AS text FROM (SELECT * FROM v_entries WHERE ts > TIMESTAMP '2024-01-05')
       UNION ALL SELECT 'goal', id, row_number() OVER (ORDER BY weight DESC, id), '[' || node_type || '/' || json_extract_string(metadata, '$.status') || '] ' || content FROM (
         SELECT * FROM v_nodes WHERE node_type IN ('goal', 'project') AND json_extract_string(metadata, '$.status') IN ('active', 'planning', 'blocked') ORDER BY weight DESC, id LIMIT 20)""",
)
def briefing_inputs(v: Views):
    return long(reports.briefing_inputs(v.entries, v.nodes, "2024-01-05 00:00:00"), "rank")


@query(
    "synthesis_inputs",
    """SELECT 'entry' AS part, id, content AS text FROM (SELECT * FROM v_entries WHERE ts > TIMESTAMP '2024-01-05')
       UNION ALL SELECT 'task', id, '[' || status || '] ' || content FROM (SELECT * FROM v_tasks WHERE parent_id = '' AND status IN ('pending', 'active') ORDER BY ts DESC, id LIMIT 10)
       UNION ALL SELECT 'open', id, '[OPEN] ' || question FROM (SELECT * FROM v_questions WHERE resolved IS NULL ORDER BY created DESC, id LIMIT 20)
       UNION ALL SELECT 'answered', id, '[ANSWERED] ' || question || ' → ' || coalesce(nullif(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), ''), '(skipped)')
         FROM (SELECT * FROM v_questions WHERE resolved IS NOT NULL AND created >= TIMESTAMP '2024-01-02')""",
)
def synthesis_inputs(v: Views):
    return reports.synthesis_inputs(v.entries, v.tasks, v.questions, "2024-01-05 00:00:00", "2024-01-02 00:00:00")
