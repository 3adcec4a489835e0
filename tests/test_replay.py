"""Repeated tasks are measured against the last created one."""

from pyspark.sql import functions as F

from mnemograph.operators import dedup, filters, graph, sequences


def tasks(spark, items):
    rows = spark.createDataFrame(items, "id string, entry_id string, content string, s double")
    return rows.withColumn("ts", F.timestamp_seconds(F.col("s") + 1.7e9).cast("timestamp_ntz")).drop("s")


def replay(items, seconds=30):
    last, out = {}, {}
    for i, entry, text, s in sorted(items, key=lambda x: (x[3], x[0])):
        key = (entry, " ".join(text.lower().split()))
        if not entry or not key[1] or key not in last or s - last[key][1] > seconds:
            last[key] = (i, s)
        out[i] = last[key][0]
    return out


def test_probe_of_four(spark):
    items = [(f"n{i}", "e", "do it", 20.0 * i) for i in range(4)]
    assert {r.id: r.created_id for r in dedup.replay_tasks(tasks(spark, items)).collect()} == {"n0": "n0", "n1": "n0", "n2": "n2", "n3": "n2"}


def test_replay_equals_a_fold_across_spans(spark):
    import random

    rng = random.Random(4)
    items = [(f"t{i:04}", rng.choice(["a", "b", ""]), rng.choice(["x  y", "X y", "z"]), float(rng.choice([rng.randint(0, 900), 3590 + rng.randint(0, 60), 20_000 + 25 * rng.randint(0, 500)]))) for i in range(600)]
    got = {r.id: r.created_id for r in dedup.replay_tasks(tasks(spark, items)).collect()}
    assert got == replay(items)
    wide = {r.id: r.created_id for r in dedup.replay_tasks(tasks(spark, items), 7200).collect()}
    assert wide == replay(items, 7200)


def test_stored_rows_and_long_runs(spark):
    import random

    rng = random.Random(9)
    items = [(f"s{i:04}", "e", "do", float(rng.choice([rng.randint(0, 4000), rng.randint(0, 300)])), rng.random() < 0.1) for i in range(900)]
    want, last = {}, None
    for i, _, _, s, stored in sorted(items, key=lambda x: (x[3], x[0])):
        if stored or last is None or s - last[1] > 30:
            last = (i, s)
        want[i] = last[0]
    df = spark.createDataFrame(items, "id string, entry_id string, content string, s double, stored boolean")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1.7e9).cast("timestamp_ntz"))
    out = dedup.replay_tasks(df)
    assert {r.id: r.created_id for r in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_limits_are_honoured_and_optional(spark):
    rows = spark.createDataFrame([(f"r{i:03}", "", "pending", i) for i in range(100)], "id string, parent_id string, status string, ts int")
    assert filters.open_roots(rows, 60).count() == 60
    hits = spark.createDataFrame([("q", "l", f"i{i}", float(i)) for i in range(150)], "qid string, list string, id string, score double")
    assert sequences.rank_in_list(hits).count() == 150 and sequences.rank_in_list(hits, 100).count() == 100
    lines = spark.createDataFrame([("c", i, "") for i in range(5)], "ctx string, n int, line string")
    assert sequences.char_budget(lines, 2, [F.asc("n")], gap=0).count() == 5


def test_dangling_references_are_followed_to_the_end(spark):
    nodes = spark.createDataFrame([(f"x{i}", f"x{i + 1}", "") for i in range(10)] + [("x10", "", "")], "id string, subject_id string, object_id string")
    nodes = nodes.withColumn("object_id", F.when(F.col("subject_id") == "", "").otherwise(F.col("subject_id")))
    found = spark.createDataFrame([("q", "x0", 0)], "qid string, id string, hop int")
    walked = spark.createDataFrame([], "qid string, source string, target string")
    assert {r.id for r in graph.resolve_dangling(nodes, found, walked).collect()} == {f"x{i}" for i in range(11)}
    assert graph.resolve_dangling(nodes, found, walked, 4).count() == 5


def test_a_dense_run_goes_on_across_spans(spark):
    import random

    rng, at, items = random.Random(2), 0.0, []
    for i in range(2500):
        at += rng.choice([0, 1, 2, 3, 7, 11, 13])
        items.append((f"d{i:04}", "e", "do", at))
    assert at > 3 * 3600
    got = {r.id: r.created_id for r in dedup.replay_tasks(tasks(spark, items)).collect()}
    assert got == replay(items)
