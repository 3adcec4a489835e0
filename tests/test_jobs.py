"""Sources, streams and the driver contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemograph.plans.reports import should_skip
from mnemograph.session import new_path
from mnemograph.sources import logs
from mnemograph.streaming import jobs

NTZ = "timestamp_ntz"


def test_manifest_round_trip(spark):
    e = spark.createDataFrame([("a", "x\ny", "s", "2024-01-02 00:00:00", "img/1.jpg"), ("b", "z", "s", "2024-01-01 00:00:00", "")], "id string, content string, source string, t string, image_url string")
    path = new_path(spark, "m")
    logs.export_manifest(e.withColumn("ts", F.col("t").cast(NTZ)), path)
    assert '"audio_file":null' in spark.read.text(path).first()[0]
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    good, bad = logs.read_manifest(spark, path)
    assert {(r.id, r.content, str(r.ts), r.image_url) for r in good.collect()} == {("a", "x\ny", "2024-01-02 00:00:00", "1.jpg"), ("b", "z", "2024-01-01 00:00:00", "")}
    assert [r.line for r in bad.collect()] == ["not json"]


def test_json_log_rejects(spark):
    path = new_path(spark, "j")
    spark.createDataFrame([('{"id": "a", "node_type": "log", "timestamp": "2024-01-01T10:00:00+02:00"}',), ("{oops",), ('{"content": "no id"}',)], "value string").write.text(path)
    good, bad = logs.read_json_log(spark, path)
    row = logs.with_time(good).first()
    assert row.id == "a" and str(row.ts) == "2024-01-01 08:00:00" and bad.count() == 2


def test_updates(spark):
    raw = [
        '{"update_id": 1, "message": {"message_id": 5, "chat": {"id": 7}, "caption": "c", "photo": [{"file_id": "s"}, {"file_id": "l"}]}}',
        '{"update_id": 2, "edited_message": {"message_id": 6, "chat": {"id": 7}, "from": {"id": 9}, "voice": {"file_id": "v"}}}',
        '{"update_id": 3}', '{"update_id": 4, "message": {"message_id": 8, "chat": {"id": 7}, "location": {"latitude": 1.5, "longitude": 2.5}}}',
    ]
    rows = {r.update_id: r for r in logs.normalise_updates(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1].text, rows[1].image_file_id, rows[1].user_id) == ("c", "l", 0)
    assert (rows[2].text, rows[2].voice_file_id, rows[2].user_id) == ("Voice note", "v", 9)
    assert (rows[4].text, rows[4].has_location, rows[4].lat) == ("Shared location pin", True, 1.5)


def test_skip_rule():
    assert not should_skip(5, 1.0, False) and not should_skip(0, None, False) and not should_skip(1, 24.0, False)
    assert should_skip(4, 23.9, False) and not should_skip(4, 1.0, True)


def times(spark, items):
    return spark.createDataFrame(items, "id string, t string").select("id", F.col("t").cast(NTZ).alias("ts")).coalesce(1)


def arrive(spark, folder, frame):
    frame.coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_files(spark, folder, frame, per_trigger=1)


def test_cycle_survives_a_restart(spark):
    rows = lambda ids: times(spark, [(i, "2024-01-01 00:00:00") for i in ids])
    folder, root = new_path(spark, "in"), new_path(spark, "c")
    jobs.CycleJob(spark, root).handle(rows("x"), -1)  # the first cycle never waits
    for ids in ("ab", "cdefg", "h"):
        job = jobs.CycleJob(spark, root)
        jobs.run_batches(arrive(spark, folder, rows(ids)), root, lambda b, i, job=job: job.handle(b, i, tick=1.0))
        if ids == "ab":
            assert {r.id for r in job.pending().collect()} == set("ab")
    assert {r.id for r in job.processed().collect()} == set("xabcdefg") and [r.id for r in job.pending().collect()] == ["h"]
    job.close()
    assert {r.id for r in job.processed().collect()} == set("xabcdefgh")


def test_late_rows_over_two_runs(spark):
    folder, root = new_path(spark, "in"), new_path(spark, "late")
    jobs.late_rows(arrive(spark, folder, times(spark, [("a", "2024-01-05 00:00:00")])), root)
    got = jobs.late_rows(arrive(spark, folder, times(spark, [("b", "2024-01-01 00:00:00"), ("c", "2024-01-06 00:00:00")])), root)
    assert {r.id: r.late for r in got.collect()} == {"a": False, "b": True, "c": False}


def test_task_dedup_keeps_late_files_and_state(spark):
    folder, root = new_path(spark, "in"), new_path(spark, "d")
    task = lambda items: times(spark, items).select("id", F.lit("e").alias("entry_id"), F.lit(" Do  It").alias("content"), "ts")
    for items in ([("a", "2024-01-10 00:00:00")], [("z", "2024-01-10 00:05:00"), ("y", "2024-01-10 00:05:20")], [("late", "2024-01-01 00:00:00")], [("again", "2024-01-10 00:00:10")]):
        job = jobs.TaskDedupJob(spark, root)
        jobs.run_batches(arrive(spark, folder, task(items)), root, job.handle)
    assert {r.id for r in job.table().collect()} == {"a", "z", "late"}


TEXT = "triples:\nAnn | works at | Acme | person | work\nAnn | NEW:mentors | Bob\nbad\nfuture_commitment: 0.9\ncommitment_intent: call the bank"


def test_ingest_is_idempotent(spark):
    batch = spark.createDataFrame([("e1", TEXT, "Ann"), ("e2", TEXT, "Ann")], "id string, text string, owner string").withColumn("ts", F.lit("2024-01-01").cast(NTZ))
    job = jobs.IngestJob(spark, new_path(spark, "ingest"), buckets=2)
    job.handle(batch, 0)
    first = {n: sorted(map(str, job.table(n).collect())) for n in ("nodes", "relationships", "evidence", "links")}
    job.handle(batch, 1)
    assert first == {n: sorted(map(str, job.table(n).collect())) for n in first}
    assert {r.predicate for r in job.table("relationships").collect()} == {"works_at", "mentors"}
    assert job.table("evidence").filter("target_id = 'e1'").count() == 2 + job.table("nodes").count()
    assert {r.context for r in job.proposals().collect()} == {"call the bank"}
    job = jobs.IngestJob(spark, job.root, buckets=2)  # a new process on the same root
    assert first == {n: sorted(map(str, job.table(n).collect())) for n in first}


def line(*triples):
    return "triples:\n" + "\n".join(" | ".join(t) for t in triples)


VECTORS = {"Ann": [1, 0, 0], "Anna": [0.98, 0.1, 0], "Anne": [0.98, 0, 0.1], "Bob": [0, 1, 0], "Robert": [0, 1, 0.05], "Acme": [0, 0, 1], "ACME": [0, 0, 1]}


def test_ingest_merges_similar_names(spark):
    """Names near a stored node of their type take it, new ones near each other share one; a batch reads and writes its buckets only."""
    known = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in VECTORS.items()], "id string, embedding array<float>")
    embed = lambda rows: rows.join(known, "id").select("id", "embedding")
    batch = lambda *rows: spark.createDataFrame(list(rows), "id string, text string, owner string, d string").withColumn("ts", F.col("d").cast(NTZ)).drop("d")
    job = jobs.IngestJob(spark, new_path(spark, "ingest"), embed, buckets=8)
    job.handle(batch(("e1", line(("Ann", "knows", "Bob", "person", "person"), ("Anna", "works at", "Acme", "person", "work")), "o", "2024-01-01")), 0)
    job.handle(batch(("e2", line(("Anne", "knows", "Robert", "person", "person"), ("bob", "works at", "ACME", "tool", "work")), "o", "2024-02-01")), 1)
    nodes = {r.name: r for r in job.table("nodes").collect()}
    assert sorted(r.node_type for r in nodes.values()) == ["person", "person", "project"]
    person = min((r for r in nodes.values() if r.name in ("Ann", "Anna")), key=lambda r: r.id)
    assert len(nodes) == 3 and person.name in nodes and nodes["Bob"].name_key == "bob"
    assert all(str(r.ts) == "2024-02-01 00:00:00" and r.embedding for r in nodes.values())
    rel = {(r.subject_id, r.predicate, r.object_id) for r in job.table("relationships").collect()}
    acme = nodes["Acme"].id
    assert rel == {(person.id, "knows", nodes["Bob"].id), (person.id, "works_at", acme), (nodes["Bob"].id, "works_at", acme)}
    assert {(r.object_id, r.slot) for r in job.table("hot_edges").collect()} == {(nodes["Bob"].id, 1), (acme, 1), (acme, 2)}
    again = {n: sorted(map(str, job.table(n).collect())) for n in job.SCHEMAS}
    job.handle(batch(("e2", line(("Anne", "knows", "Robert", "person", "person"), ("bob", "works at", "ACME", "tool", "work")), "o", "2024-02-01")), 1)
    job.handle(batch(("e3", line(("Nobody", "sees", "Nothing")), "o", "2024-03-01")), 2)
    assert set(again["nodes"]) < set(map(str, job.table("nodes").collect()))
    held = job.stored("nodes").pointer()
    assert set(held.values()) == {0, 1, 2} or set(held.values()) == {1, 2}  # buckets that batch 2 didn't touch stay where they are


def test_hot_edges_stream_matches_sequence(spark):
    frames, cache = [], []
    for b in range(3):
        rows = [("o", f"r{b}{i:02d}", b * 100 + i) for i in range(15)] + [("o", "r000", b * 100 + 50)]
        frames.append(spark.createDataFrame(rows, "object_id string, id string, seen_at bigint"))
        for _, i, _ in sorted(rows, key=lambda r: (r[2], r[1])):
            if i in cache:
                continue
            if len(cache) < 20:
                cache.append(i)
            else:
                cache[0] = i
    job = jobs.HotEdgesJob(spark, new_path(spark, "hot"))
    for n, f in enumerate(frames):
        job.handle(f, n)
    job.handle(frames[-1], 2)  # a replayed batch changes nothing
    got = {r.slot: r.id for r in job.state().collect()}
    assert [got[i + 1] for i in range(20)] == cache


def test_hot_edges_evicts_lowest_first(spark):
    job = jobs.HotEdgesJob(spark, new_path(spark, "hot"), slots=3)
    job.seed(spark.createDataFrame([("o", 1, "a", 0.9), ("o", 2, "b", 0.2), ("o", 3, "c", 0.5), ("p", 1, "z", 1.0)], "object_id string, slot int, id string, score double"))
    new = lambda ids, at: spark.createDataFrame([("o", i, at + n) for n, i in enumerate(ids)], "object_id string, id string, seen_at bigint")
    job.handle(new("defg", 10), 0)
    assert {(r.object_id, r.slot): r.id for r in job.state().collect()} == {("o", 1): "g", ("o", 2): "d", ("o", 3): "e", ("p", 1): "z"}
    job.handle(new("h", 20), 1)
    job.handle(new("ei", 30), 2)
    assert {(r.object_id, r.slot): r.id for r in job.state().collect()} == {("o", 1): "i", ("o", 2): "d", ("o", 3): "e", ("p", 1): "z"}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "id", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", ["graph_expand", "rag_context", "knn_lsh"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
