"""Named queries: incremental jobs, run over the driver's files as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.catalog.registry import query
from mnemograph.catalog.relations import REPLAYED
from mnemograph.catalog.texts import GOOD
from mnemograph.session import new_path
from mnemograph.sources.views import Views
from mnemograph.streaming import jobs


def stream(v: Views, table: str):
    return jobs.read_files(v.spark, v.folder, v.table(table), f"{table}.parquet")


def staged_by_day(v: Views, df, label: str) -> str:
    """The rows as one folder of files per day, so that a stream sees several batches."""
    path = new_path(v.spark, label)
    df.withColumn("day", F.col("ts").cast("date")).repartition("day").write.parquet(path)
    return path


@query(
    "task_dedup_stream",
    "WITH RECURSIVE "
    + REPLAYED.format(key="user_id % 40, event_type", source="SELECT 'ev-' || event_id AS id, * FROM events")
    + "SELECT DISTINCT created_id AS id FROM replayed",
)
def task_dedup_stream(v: Views):
    """Events as tasks of 40 entries, in files by day; every file arrives twice."""
    tasks = v.event_logs.select(
        "id", F.concat(F.lit("entry-"), F.col("owner") % 40).alias("entry_id"), F.concat(F.lit(" Do  "), "source").alias("content"), "ts"
    )
    path = staged_by_day(v, tasks.unionByName(tasks), "task-in")
    job = jobs.TaskDedupJob(v.spark, new_path(v.spark, "task-dedup"))
    jobs.run_batches(jobs.read_files(v.spark, path, tasks, per_trigger=8), job.root, job.handle)
    return job.table().select("id")


@query(
    "late_rows",
    """SELECT 'ev-' || event_id AS id, CAST(ts AS VARCHAR) AS ts,
         coalesce(ts < max(CASE WHEN event_id % 2 = 0 THEN ts END) OVER () AND event_id % 2 = 1, false) AS late FROM events""",
)
def late_rows(v: Views):
    """Events of even number arrive first, the others in a second batch."""
    rows = v.event_logs.select("id", "ts")
    path, root = new_path(v.spark, "late-in"), new_path(v.spark, "late")
    out = None
    for half in (0, 1):
        part = rows.filter(F.substring_index("id", "-", -1).cast("bigint") % 2 == half)
        part.write.mode("append").parquet(path)
        out = jobs.late_rows(jobs.read_files(v.spark, path, rows), root)
    return out.select("id", F.col("ts").cast("string").alias("ts"), "late")


@query("cycle_stream", "SELECT 'ev-' || event_id AS id FROM events")
def cycle_stream(v: Views):
    rows = v.event_logs.select("id", "ts")
    path = staged_by_day(v, rows, "cycle-in")
    job = jobs.CycleJob(v.spark, new_path(v.spark, "cycle"))
    jobs.run_batches(jobs.read_files(v.spark, path, rows, per_trigger=8), job.root, lambda b, i: job.handle(b, i, tick=1.0))
    job.close()
    return job.processed().select("id")


VEC = "('0x' || substr(md5(lower({0})), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)"
KNOWN = "'entity_' || sha1(node_type || ':' || lower(name))"
# what the new names of a batch become: the first mention of a name gives the node, and nodes of one type and vector are one
FRESH = """
  first{0} AS (SELECT name_key, arg_min(hash_id, (first_at, hash_id)) AS first_id FROM new{0} GROUP BY 1),
  rep{0} AS (SELECT first_id, node_type, vec, min(n.name) AS name FROM first{0} f JOIN new{0} n ON n.hash_id = f.first_id GROUP BY 1, 2, 3),
  node{0} AS (SELECT node_type, vec, min(first_id) AS id, arg_min(name, first_id) AS name FROM rep{0} GROUP BY 1, 2),
  made{0} AS (SELECT n.name, n.node_type, o.id FROM new{0} n JOIN first{0} USING (name_key) JOIN rep{0} r USING (first_id) JOIN node{0} o ON o.node_type = r.node_type AND o.vec = r.vec)"""
INGESTED = f"""
  good AS (SELECT g.id AS entry_id, CASE predicate WHEN 'works at' THEN 'works_at' ELSE 'located_in' END AS predicate, subject, object, subject_type, object_type,
             m.ts, m.doc_id % 2 AS batch FROM ({GOOD}) g JOIN v_model_text m ON m.id = g.id),
  ends AS (SELECT entry_id, ts, batch, subject AS name, subject_type AS node_type FROM good UNION ALL SELECT entry_id, ts, batch, object, object_type FROM good),
  keys AS (SELECT batch, name, node_type, min(ts) AS first_at, lower(name) AS name_key, {KNOWN} AS hash_id, {VEC.format('name')} AS vec FROM ends GROUP BY batch, name, node_type),
  new0 AS (SELECT * FROM keys WHERE batch = 0), {FRESH.format(0)},
  old1 AS (SELECT k.*, coalesce(s.id, (SELECT min(x.id) FROM node0 x WHERE lower(x.name) = k.name_key)) AS id
           FROM keys k LEFT JOIN node0 s ON s.node_type = k.node_type AND s.vec = k.vec WHERE k.batch = 1),
  new1 AS (SELECT * FROM old1 WHERE id IS NULL), {FRESH.format(1)},
  ids AS (SELECT 0 AS batch, * FROM made0 UNION ALL SELECT 1, name, node_type, id FROM old1 WHERE id IS NOT NULL UNION ALL SELECT 1, * FROM made1),
  seen AS (SELECT e.*, i.id FROM ends e JOIN ids i USING (batch, name, node_type)),
  rel AS (SELECT g.*, s.id AS subject_id, o.id AS object_id, 'rel_' || sha1(s.id || ':' || predicate || ':' || o.id) AS rel_id
          FROM good g JOIN ids s ON s.batch = g.batch AND s.name = subject AND s.node_type = subject_type
          JOIN ids o ON o.batch = g.batch AND o.name = object AND o.node_type = object_type),
  nodes AS (SELECT * FROM node0 UNION ALL SELECT * FROM node1)"""


@query(
    "ingest_stream",
    f"""WITH {INGESTED}
        SELECT 'nodes' AS part, n.id, n.node_type || ' ' || n.name || ' ' || n.vec || ' ' || strftime(max(s.ts), '%Y-%m-%d %H:%M') AS value
        FROM nodes n JOIN seen s ON s.id = n.id GROUP BY n.id, n.node_type, n.name, n.vec
        UNION ALL SELECT DISTINCT 'relationships', rel_id, predicate FROM rel
        UNION ALL SELECT DISTINCT 'evidence', rel_id, entry_id FROM rel UNION ALL SELECT DISTINCT 'evidence', id, entry_id FROM seen
        UNION ALL SELECT DISTINCT 'links', unnest([subject_id, object_id, entry_id]), rel_id FROM rel
        UNION ALL SELECT 'slots', object_id, CAST(least(20, count(DISTINCT rel_id)) AS VARCHAR) FROM rel GROUP BY object_id
        UNION ALL SELECT DISTINCT 'hot_edges', object_id, rel_id FROM rel WHERE object_id IN (SELECT object_id FROM rel GROUP BY 1 HAVING count(DISTINCT rel_id) <= 20)
        UNION ALL SELECT 'proposals', id, 'Should I create a task for: "' || array_to_string(w[1:3], ' ') || '"?' FROM v_model_text
        WHERE (doc_id % 11) / 10.0::DOUBLE >= 0.6 AND strlen(array_to_string(w[1:3], ' ')) >= 10""",
)
def ingest_stream(v: Views):
    """Documents of even number arrive first; the others come to a second job on the same root. A name's vector is one of the table."""
    texts = v.model_text.select("id", "ts", "text", "owner")
    number = F.conv(F.substring(F.md5(F.lower("text")), 1, 8), 16, 10).cast("bigint") % v.n_vectors
    vectors = v.table("embeddings").select("vec_id", "embedding")
    embed = lambda rows: rows.select("id", number.alias("vec_id")).join(vectors, "vec_id").select("id", "embedding")
    path, root, job = new_path(v.spark, "ingest-in"), new_path(v.spark, "ingest"), None
    for half in (0, 1):
        part = texts.filter(F.substring_index("id", "-", -1).cast("bigint") % 2 == half)
        part.write.mode("append").parquet(path)
        job = jobs.IngestJob(v.spark, root, embed)
        jobs.run_batches(jobs.read_files(v.spark, path, texts), root, job.handle)
    rows = lambda part, df, a, b: df.select(F.lit(part).alias("part"), F.col(a).alias("id"), F.col(b).cast("string").alias("value"))
    number = F.conv(F.substring(F.md5("name_key"), 1, 8), 16, 10).cast("bigint") % v.n_vectors
    nodes = job.table("nodes").filter("embedding IS NOT NULL").withColumn("value", F.concat_ws(" ", "node_type", "name", number, F.date_format("ts", "yyyy-MM-dd HH:mm")))
    hot = job.table("hot_edges")
    few = job.table("relationships").groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).filter("n <= 20").select("object_id")
    return (
        rows("nodes", nodes, "id", "value").unionByName(rows("relationships", job.table("relationships"), "id", "predicate"))
        .unionByName(rows("evidence", job.table("evidence"), "id", "target_id")).unionByName(rows("links", job.table("links"), "id", "target_id"))
        .unionByName(rows("slots", hot.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")), "object_id", "n"))
        .unionByName(rows("hot_edges", hot.join(few, "object_id", "left_semi"), "object_id", "id"))
        .unionByName(rows("proposals", job.proposals(), "id", "question"))
    )


@query(
    "hot_edges_stream",
    """SELECT object_id, CASE WHEN n > 20 AND n = total THEN 1 ELSE n END AS slot, id FROM (
         SELECT 'user-' || (user_id % 40) AS object_id, 'ev-' || event_id AS id,
           row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, 'ev-' || event_id) AS n, count(*) OVER (PARTITION BY user_id % 40) AS total FROM events)
       WHERE n = total OR (n <= 20 AND NOT (n = 1 AND total > 20))""",
)
def hot_edges_stream(v: Views):
    """All events of a user as edges: the first twenty stay, the last one holds slot 1."""
    edges = stream(v, "events").select(
        F.concat(F.lit("user-"), F.col("user_id") % 40).alias("object_id"), F.concat(F.lit("ev-"), "event_id").alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_at"),
    )
    job = jobs.HotEdgesJob(v.spark, new_path(v.spark, "hot-edges"))
    jobs.run_batches(edges, job.root, job.handle)
    return job.state().select("object_id", F.col("slot").cast("bigint").alias("slot"), "id")
