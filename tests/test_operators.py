"""Operators against brute force on small tables, with hot keys where that matters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.functions import columns as C, model
from mnemograph.operators import dedup, filters, graph, joins, keywords, merge, rank, sequences, skew, vector

NTZ = "timestamp_ntz"


def ts(text):
    return F.lit(text).cast(NTZ)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# skew helpers


def test_next_row_across_spans(spark):
    rows = [("a", p) for p in (0, 1, 5, 11, 12, 40)] + [("b", 3)]
    got = skew.next_row(table(spark, rows, "k string, p int"), ["k"], "p", ["p"], "n", span=4)
    assert {(r.k, r.p): (r.n.p if r.n else None) for r in got.collect()} == {
        ("a", 0): 1, ("a", 1): 5, ("a", 5): 11, ("a", 11): 12, ("a", 12): 40, ("a", 40): None, ("b", 3): None,
    }


# vectors


def brute(q, c, k, floor=None):
    out = {}
    for qid, a in q.items():
        scored = []
        for cid, b in c.items():
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            s = 0.0 if len(a) != len(b) or na == 0 or nb == 0 else float(np.dot(a, b) / na / nb)
            scored.append((round(min(1, max(0, s)), 6), cid))
        scored = [x for x in sorted(scored, key=lambda x: (-x[0], x[1])) if floor is None or x[0] >= floor]
        out[qid] = [(cid, s) for s, cid in scored[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 8))
    c = {f"c{i:03d}": base[i % 12] + 0.2 * rng.standard_normal(8) for i in range(300)}
    c.update({f"dup{i:03d}": base[0] for i in range(150)})  # a third of the rows are copies
    q = {f"q{i}": base[i % 12] for i in range(40)}
    frame = lambda d, name: table(spark, [(k, [float(x) for x in v]) for k, v in d.items()], f"{name} string, embedding array<double>")
    return q, c, frame(q, "qid"), frame(c, "id")


def test_nearest_both_ways(vectors):
    q, c, qd, cd = vectors
    want = brute(q, c, 7)
    assert collected(vector.nearest(qd, cd, 7)) == want
    assert collected(vector.nearest(qd, cd, 7, broadcast_bytes=0, cell_rows=32)) == want
    want = brute(q, c, 5, 0.9)
    assert collected(vector.nearest(qd, cd, 5, min_score=0.9)) == {k: v for k, v in want.items() if v}


def test_nearest_same_kind(vectors, spark):
    q, c, qd, cd = vectors
    kind = lambda df, key: df.withColumn("node_type", F.concat(F.lit("t"), F.crc32(F.col(key)) % 3))
    qd, cd = kind(qd, "qid"), kind(cd, "id")
    kinds = {r[0]: r[1] for r in qd.select("qid", "node_type").collect()}
    ckinds = {r[0]: r[1] for r in cd.select("id", "node_type").collect()}
    want = {k: brute({k: v}, {i: x for i, x in c.items() if ckinds[i] == kinds[k]}, 4)[k] for k, v in q.items()}
    assert collected(vector.nearest(qd, cd, 4, same="node_type", min_score=0.0)) == want
    assert collected(vector.nearest(qd, cd, 4, same="node_type", broadcast_bytes=0, cell_rows=16)) == want


def test_lsh_recall(vectors):
    q, c, qd, cd = vectors
    exact = {k: {i for i, _ in v} for k, v in brute(q, c, 10).items()}
    got = collected(vector.nearest_lsh(qd, cd, 10, tables=8, bits=4, cell_rows=64))
    hits = sum(len(exact[k] & {i for i, _ in got.get(k, [])}) for k in q)
    assert hits / sum(map(len, exact.values())) > 0.9


def test_cosine_guards(spark):
    df = table(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_prune(spark):
    nodes = table(spark, [("a", [1.0, 0.0, 0.0], 0.1), ("b", [0.0, 1.0, 0.0], 0.9), ("c", [0.9, 0.1, 0.0], 0.5), ("n", None, 0.95)],
                  "id string, embedding array<double>, weight double")
    q = table(spark, [("x", [1.0, 0.0, 0.0]), ("y", [1.0, 0.0, 0.0]), ("z", None)], "qid string, embedding array<double>")
    cand = table(spark, [("x", i) for i in "abc"] + [("y", i) for i in "abcn"] + [("z", i) for i in "abc"] + [("w", "a"), ("w", "gone")], "qid string, id string")
    got = {}
    for r in vector.prune(cand, nodes, q, 2).collect():
        got.setdefault(r.qid, set()).add(r.id)
    assert got == {"x": {"a", "c"}, "y": {"b", "n"}, "z": {"b", "c"}, "w": {"a"}}


def test_prune_of_candidates_that_carry_their_nodes(spark):
    vectors = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.9, 0.1, 0.0], "n": None}
    weights = {"a": 0.1, "b": 0.9, "c": 0.5, "n": 0.95}
    q = table(spark, [("x", [1.0, 0.0, 0.0]), ("y", [1.0, 0.0, 0.0]), ("z", None)], "qid string, embedding array<double>")
    pairs = [("x", i) for i in "abc"] + [("y", i) for i in "abcn"] + [("z", i) for i in "abc"] + [("w", "a")]
    cand = table(spark, [(x, i, weights[i], vectors[i]) for x, i in pairs], "qid string, id string, weight double, embedding array<double>")
    nodes = table(spark, [(i, weights[i], vectors[i]) for i in "abcn"], "id string, weight double, embedding array<double>")
    got = sorted(map(tuple, vector.prune(cand, None, q, 2).collect()))
    assert got == sorted(map(tuple, vector.prune(cand.select("qid", "id"), nodes, q, 2).collect()))
    assert got == [("w", "a"), ("x", "a"), ("x", "c"), ("y", "b"), ("y", "n"), ("z", "b"), ("z", "c")]


def test_relationship_members_has_a_task_for_each_so_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBER_ROWS", 10)
    rows = [(f"n{i}", "person", f"c{i}", None, None) for i in range(60)] + [(f"r{i}", "relationship", f"r{i}", f"n{i}", "n0") for i in range(30)]
    nodes = table(spark, rows, "id string, node_type string, content string, subject_id string, object_id string")
    out = graph.relationship_members(nodes, table(spark, [("n0",), ("n45",)], "id string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [id") == 2 and ", 9" in plan
    assert sorted(map(tuple, out.collect())) == sorted((f"n{i}", "person", f"c{i}", i == 0) for i in range(30))


# keyword search


def test_keyword_ways_agree(spark):
    rng = np.random.default_rng(5)
    words = ["tea", "teapot", "a", "pot", "green", "Grün", "x|y", "ti"]
    docs = [(f"d{i:03d}", f"2024-01-{1 + i % 28:02d} 00:00:00", " ".join(rng.choice(words, 5))) for i in range(120)]
    df = table(spark, docs, "id string, t string, text string").withColumn("ts", F.col("t").cast(NTZ))
    queries = {"q1": "tea pot", "q2": "A", "q3": "grün ti", "q4": "", "q5": "absent tea", "q6": "TEA  pot tea"}
    qd = table(spark, list(queries.items()), "qid string, query string").select("qid", keywords.words_of(F.col("query")).alias("words"))
    want = {}
    for qid, text in queries.items():
        ws = text.lower().split()
        hits = [d for d in docs if ws and all(w in d[2].lower() for w in ws)]
        hits.sort(key=lambda d: d[0])
        hits.sort(key=lambda d: d[1], reverse=True)
        if hits:
            want[qid] = [d[0] for d in hits[:6]]
    for limit in (1000, 0):
        got = {}
        for r in keywords.search_many(qd, df, 6, broadcast_sets=limit).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == want


# ranking


def test_fusion_prefers_both_lists(spark):
    a = table(spark, [("q", "a", 1), ("q", "b", 2)], "qid string, id string, rank int")
    b = table(spark, [("q", "b", 1), ("q", "c", 2), ("q", "", 3)], "qid string, id string, rank int")
    rows = rank.rrf_fuse([a, b], 10).orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "a", "c"]
    assert abs(rows[0].score - (1 / 62 + 1 / 61)) < 1e-12
    assert all(r.score <= 2 / 61 for r in rows)


def test_decay(spark):
    rows = [("now", "2024-02-01 00:00:00"), ("half", "2023-08-05 00:00:00"), ("old", "2022-02-01 00:00:00"), ("none", None), ("future", "2025-01-01 00:00:00")]
    df = table(spark, rows, "id string, t string").withColumn("ts", F.col("t").cast(NTZ))
    got = {r[0]: r[1] for r in df.select("id", C.temporal_bias(F.lit(1.0), F.col("ts"), ts("2024-02-01 00:00:00"))).collect()}
    assert got["now"] == got["none"] == got["future"] == 1.0
    assert abs(got["half"] - 0.5) < 0.05 and got["old"] < 0.10


def test_external_order(spark):
    hits = table(spark, [(q, f"{q}{i}", i) for q in "xyz" for i in range(1, 5)], "qid string, id string, rank int")
    orders = table(spark, [("x", [3, 3, 9, 0, 1]), ("y", [77])], "qid string, indices array<int>")
    got = {}
    for r in rank.external_order(hits, orders, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {"x": ["x3", "x1"], "y": ["y1", "y2", "y3"], "z": ["z1", "z2", "z3"]}


# sequences


def test_char_budget(spark):
    rows = [("c", i, "x" * 20) for i in range(10)] + [("d", 0, "short")] + [("e", 0, "y" * 99)]
    df = table(spark, rows, "ctx string, id int, line string")
    got = {}
    for r in sequences.char_budget(df, 50, [F.asc("id")]).orderBy("ctx", "pos").collect():
        got.setdefault(r.ctx, []).append(r.line)
    assert got == {"c": ["x" * 20] * 2 + ["... and 8 more entries (truncated)"], "d": ["short"], "e": ["... and 1 more entries (truncated)"]}


def test_backoff_and_next_question(spark, apply):
    assert apply(sequences.backoff_days, [0, 1, 2, 3, 5, 6, 20], "int") == [0, 1, 2, 4, 16, 30, 30]
    rows = [("p", "old", "2024-01-01", 0, None), ("p", "new", "2024-01-03", 2, "2024-01-09"), ("r", "wait", "2024-01-01", 3, "2024-01-08")]
    q = table(spark, rows, "client string, id string, c string, ask_count int, l string").select(
        "client", "id", "ask_count", F.col("c").cast(NTZ).alias("created"), F.col("l").cast(NTZ).alias("last_asked"), F.lit(None).cast(NTZ).alias("resolved"))
    at = ts("2024-01-10 00:00:00")
    assert {r.client: r.id for r in sequences.next_question(q, at).collect()} == {"p": "old"}
    said = table(spark, [("r", "wait"), ("p", "new")], "client string, id string")
    assert {r.client: r.id for r in sequences.next_question(q, at, said).collect()} == {"p": "new", "r": "wait"}


# de-duplication


def test_semantic_anti_join(spark):
    old = table(spark, [("o", [1.0, 0.0, 0.0, 0.0])], "id string, embedding array<double>")
    new = table(spark, [("near", [0.99, 0.1, 0.0, 0.0]), ("far", [0.0, 1.0, 0.0, 0.0])], "qid string, embedding array<double>")
    assert [r.qid for r in dedup.semantic_anti_join(new, old).collect()] == ["far"]


def test_recent_duplicate_task(spark):
    rows = [("t1", "e", "Buy  Milk", "2024-01-01 00:59:50"), ("t2", "e", "buy milk ", "2024-01-01 01:00:10"), ("t3", "e", "buy milk", "2024-01-01 01:02:00"),
            ("t4", "f", "buy milk", "2024-01-01 01:00:11"), ("t5", "", "buy milk", "2024-01-01 01:00:12")]
    df = table(spark, rows, "id string, entry_id string, content string, t string").withColumn("ts", F.col("t").cast(NTZ))
    assert [tuple(r) for r in dedup.recent_duplicate_task(df).collect()] == [("t2", "t1")]


def test_create_tasks(spark):
    rows = [("n1", "e", "a", "2024-01-01 00:00:00", [1.0, 0.0]), ("n2", "e", "A ", "2024-01-01 00:00:05", [1.0, 0.0]), ("n3", "e", "b", "2024-01-01 00:00:05", [0.0, 1.0])]
    new = table(spark, rows, "id string, entry_id string, content string, t string, embedding array<double>").withColumn("ts", F.col("t").cast(NTZ))
    old = table(spark, [("done", "completed", [1.0, 0.0]), ("open", "active", [0.0, 1.0])], "id string, status string, embedding array<double>")
    got = {r.id: (r.action, r.surviving_id) for r in dedup.create_tasks(new, old).collect()}
    assert got == {"n1": ("create", "n1"), "n2": ("repeat", "n1"), "n3": ("similar", "open")}


# graph


def small_graph(spark):
    entity = lambda i, kind="person": (i, i.upper(), kind, 0.5, None, None, None, None)
    rel = lambda i, s, p, o, w=0.8: (i, f"{s} {p} {o}", "relationship", w, s, p, o, [s, o])
    rows = [entity(x) for x in "abcd"] + [rel("r1", "a", "knows", "b"), rel("r2", "b", "knows", "c"), rel("r3", "c", "likes", "gone", 0.2), rel("r4", "d", "knows", "b", 0.9)]
    return table(spark, rows, "id string, content string, node_type string, weight double, subject_id string, predicate string, object_id string, entity_links array<string>").withColumn(
        "embedding", F.lit(None).cast("array<float>"))


def test_expand_and_resolve(spark):
    nodes = small_graph(spark)
    seeds = table(spark, [("q", "a"), ("p", "r3")], "qid string, id string")
    vectors = table(spark, [], "qid string, embedding array<float>")
    found, walked = graph.expand(nodes, seeds, vectors, hops=2, per_kind=5)
    hop = {(r.qid, r.id): r.hop for r in found.collect()}
    assert hop == {("q", "a"): 0, ("q", "r1"): 1, ("q", "b"): 2, ("p", "r3"): 0, ("p", "c"): 1, ("p", "r2"): 2}
    edges = {(r.qid, r.source, r.predicate, r.target) for r in walked.collect()}
    assert ("q", "r1", "incoming_link", "a") in edges and ("q", "r1", "knows", "b") in edges and ("p", "r3", "likes", "gone") in edges
    ids = {(r.qid, r.id) for r in graph.resolve_dangling(nodes, found, walked).collect()}
    assert ("p", "b") in ids and ("p", "gone") not in ids and ("q", "d") not in ids


def test_frontier_is_capped(spark):
    n = 60
    hub = [("hub", "HUB", "person", 0.5, None, None, None, None)] + [
        (f"r{i:02d}", "x", "relationship", i / 100, f"n{i}", "knows", "hub", [f"n{i}", "hub"]) for i in range(n)]
    nodes = table(spark, hub, "id string, content string, node_type string, weight double, subject_id string, predicate string, object_id string, entity_links array<string>").withColumn("embedding", F.lit(None).cast("array<float>"))
    found, walked = graph.expand(nodes, table(spark, [("q", "hub")], "qid string, id string"), table(spark, [], "qid string, embedding array<float>"), 1, 4)
    assert {r.id for r in found.collect()} == {"hub", "r59", "r58", "r57", "r56"}
    assert walked.filter("predicate = 'incoming_link'").count() == 4


# maintenance


def test_relationships_merge_is_idempotent(spark):
    rows = [("a", "works at", "b", "e1", "2024-01-01"), ("a", "Works-At", "b", "e2", "2024-01-05"), ("a", "works_at", "b", "e2", None), ("", "x", "b", "e3", None)]
    obs = table(spark, rows, "subject_id string, predicate string, object_id string, entry_id string, t string").withColumn("ts", F.col("t").cast(NTZ)).drop("t")
    none = table(spark, [], "id string, subject_id string, predicate string, object_id string, ts timestamp_ntz")
    links = table(spark, [], "id string, target_id string")
    once, ev1 = merge.upsert_relationships(obs, none, links, ts("2024-02-01 00:00:00"))
    twice, ev2 = merge.upsert_relationships(obs, once, ev1, ts("2024-02-01 00:00:00"))
    assert once.count() == 1 and str(once.first().ts) == "2024-01-05 00:00:00" and once.first().is_new
    cols = ["id", "subject_id", "predicate", "object_id", "ts"]
    assert once.select(*cols).collect() == twice.select(*cols).collect() and not twice.first().is_new
    assert {r.target_id for r in ev1.collect()} == {r.target_id for r in ev2.collect()} == {"e1", "e2"}
    quiet = obs.filter("entry_id = 'e2' and ts is null")
    kept, _ = merge.upsert_relationships(quiet, once, ev1, ts("2024-02-01 00:00:00"))
    assert str(kept.first().ts) == "2024-01-05 00:00:00"  # an observation without a time does not touch the stored one


def test_ensure_nodes_order(spark):
    nodes = table(spark, [("entity_x", "person", "Ann", [1.0, 0.0]), ("k", "place", "Rome", None)], "id string, node_type string, content string, embedding array<double>")
    m = table(spark, [(" Anne ", "person"), ("ROME", "asset"), ("entity_x", "person"), ("entity_none", "person"), ("New", ""), ("  ", "person")], "name string, node_type string")
    e = table(spark, [("Anne", [0.99, 0.05]), ("ROME", [0.0, 1.0]), ("New", [-1.0, 0.0])], "name string, embedding array<double>")
    got = {r.name: (r.id, r.how) for r in merge.ensure_nodes(m, nodes, e).collect()}
    assert got["Anne"] == ("entity_x", "similar") and got["ROME"] == ("k", "name") and got["entity_x"] == ("entity_x", "id")
    twice = table(spark, [("Milan", "place", "2024-01-02"), ("milan", "person", "2024-01-01"), ("MILAN", "asset", "2024-01-03")], "name string, node_type string, t string")
    ids = {r.id for r in merge.ensure_nodes(twice.withColumn("ts", F.col("t").cast(NTZ)), nodes).collect()}
    assert ids == {spark.range(1).select(C.entity_id(F.lit("person"), F.lit("milan"))).first()[0]}
    assert got["entity_none"] == (None, "missing") and got["New"][1] == "new" and len(got) == 5


def test_merge_similar_new(spark):
    resolved = table(spark, [(n, n) for n in "abcdz"], "name string, id string")
    pairs = table(spark, [("d", "c"), ("c", "b"), ("b", "a")], "a string, b string")
    assert {r.name: r.id for r in merge.merge_similar_new(resolved, pairs).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}


def test_upsert_facts(spark):
    nodes = table(spark, [("n1", "Likes tea", "fact", [1.0, 0.0], "{}"), ("l", "log", "log", [0.0, 1.0], "{}")], "id string, content string, node_type string, embedding array<double>, metadata string")
    f = table(spark, [("f1", "likes  TEA", "fact", [1.0, 0.01]), ("f2", "likes coffee", "fact", [1.0, 0.02]), ("f3", "me", "user_identity", [0.0, 1.0])], "qid string, content string, node_type string, embedding array<double>")
    f = f.withColumn("metadata", F.lit(None).cast("string")).withColumn("ts", ts("2024-01-01"))
    got = {r.qid: (r.id, r.action, r.weight) for r in merge.upsert_facts(f, nodes).collect()}
    assert got == {"f1": ("n1", "update", 0.5), "f2": ("f2", "insert", 0.5), "f3": ("f3", "insert", 0.95)}


def test_archive_lines(spark):
    p = table(spark, [("p", '{"status": "active", "archive_summary": "- first", "n": 1}')], "id string, metadata string")
    lines = table(spark, [("p", "2024-01-02", "b" * 300), ("p", "2024-01-01", 'say "hi"')], "id string, t string, line string").withColumn("ts", F.col("t").cast(NTZ))
    import json
    meta = json.loads(merge.append_archive_lines(p, lines).first().metadata)
    assert meta["n"] == 1 and meta["archive_summary"] == '- first\n- say "hi"\n- ' + "b" * 197 + "..."


def test_resolved_question_rows(spark):
    q = table(spark, [("g", "Who?", "gap"), ("o", "Name?", "onboarding"), ("s", "Skip?", "gap")] + [(f"t{i}", "Do it?", "task_proposal") for i in range(3)], "id string, question string, kind string")
    q = q.withColumn("context", F.when(F.col("id") != "t2", F.concat(F.lit(" work "), "id")))
    a = table(spark, [("g", "Ann"), ("o", "Bob"), ("s", ""), ("t0", "Yes please"), ("t1", "no"), ("t2", "yes")], "id string, answer string").withColumn("ts", ts("2024-01-01"))
    resolved, facts, logs, tasks = merge.resolve_questions(q, a)
    assert [(r.id, r.content, r.status) for r in tasks.collect()] == [("task-t0", "work t0", "pending")]
    assert resolved.count() == 6 and [r.content for r in facts.collect()] == ["Bob"]
    assert [r.content for r in logs.collect()] == ["Assistant asked: Who?\nUser responded: Ann"]


def test_hot_edges_scores(spark):
    rows = [("o", f"r{i:02d}", f"2024-01-{i + 1:02d}") for i in range(25)]
    df = table(spark, rows, "object_id string, id string, t string").withColumn("ts", F.col("t").cast(NTZ))
    got = merge.hot_edges(df, ts("2024-02-01 00:00:00")).orderBy("slot").collect()
    assert len(got) == 20 and got[0].id == "r24" and got[-1].id == "r05"


def test_backfill(spark):
    e = table(spark, [("a", "text", None), ("b", "", None), ("c", "has", [1.0]), ("d", "boom", None)], "id string, content string, embedding array<float>")
    def embed(texts):
        if "boom" in texts:
            raise ValueError("no")
        return [[1.0, 2.0]] * len(texts)
    out = merge.backfill_embeddings(e, lambda rows: model.embed_column(rows, embed, batch=1))
    assert [(r.id, list(r.embedding)) for r in out.collect()] == [("a", [1.0, 2.0])]


def test_model_column(spark):
    rows = table(spark, [("1", "sys", "p")], "id string, system string, prompt string")
    assert model.model_column(rows, lambda s, p, n: [f"{a}-{b}-{n}" for a, b in zip(s, p)], 9).first().text == "sys-p-9"


def test_filters(spark):
    rows = [("a", "2024-01-01 23:59:59"), ("b", "2024-01-02 00:00:00"), ("c", "2024-01-02 23:59:59"), ("d", "2024-01-03 00:00:00")]
    df = table(spark, rows, "id string, t string").withColumn("ts", F.col("t").cast(NTZ))
    assert [r.id for r in filters.by_date(df, "2024-01-02", "2024-01-02", 10).collect()] == ["c", "b"]
    assert [r.id for r in filters.since(df, "2024-01-02 00:00:00", 10).collect()] == ["c", "d"]
    assert [r.id for r in filters.since(df, None, 2).collect()] == ["d", "c"]


def test_question_mentions(spark):
    m = table(spark, [("m1", "did Anna call? ok"), ("m2", "nothing here"), ("m3", "(Rome) trip")], "qid string, text string")
    q = table(spark, [("q1", "Who is anna?", "", "2024-01-01"), ("q2", "Annapolis", "x", "2024-01-02"), ("q3", "Where?", "rome", "2024-01-01")], "id string, question string, context string, t string")
    q = q.withColumn("created", F.col("t").cast(NTZ))
    assert {r.qid: r.question_id for r in joins.question_mentions(m, q).collect()} == {"m1": "q2", "m3": "q3"}


def test_newest_rows_of_common_words_come_first(spark, monkeypatch):
    import random

    from mnemograph.operators import keywords

    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "cat", "dog", "zebra", "heather"]
    texts = [" ".join(rng.choices(vocabulary, [30, 20, 20, 5, 5, 1, 1], k=6)) for _ in range(400)]
    ages = [None if i % 50 == 7 else rng.randint(0, 150) for i in range(400)]
    rows = [(f"d{i:03}", age, t) for i, (age, t) in enumerate(zip(ages, texts))]
    stamp = F.timestamp_seconds(F.col("age") + 1.7e9).cast("timestamp_ntz")
    docs = spark.createDataFrame(rows, "id string, age int, text string").select("id", stamp.alias("ts"), "text")
    sets = [["the"], ["of", "the"], ["cat", "dog"], ["zebra"], ["heather", "zebra"], ["eat"], ["none"]]
    queries = spark.createDataFrame([(str(i), w) for i, w in enumerate(sets)], "qid string, words array<string>")
    met = []
    whole = keywords.rows_with_words
    monkeypatch.setattr(keywords, "rows_with_words", lambda s, d: met.append(whole(s, d).count()) or whole(s, d))
    monkeypatch.setattr(keywords, "NEWEST", 20, raising=False)
    monkeypatch.setattr(keywords._newest_first, "__defaults__", (20,)) if hasattr(keywords, "_newest_first") else None
    got = {(r.qid, r.id): r["rank"] for r in keywords.search_many(queries, docs, 5, broadcast_sets=0).collect()}
    want, pairs = {}, 0
    for i, words in enumerate(sets):
        hits = sorted((age is None, -(age or 0), d) for d, age, t in rows if all(w in t for w in words))
        pairs += len(hits)
        want |= {(str(i), d): n + 1 for n, (_, _, d) in enumerate(hits[:5])}
    assert got == want
    assert sum(met) < 0.5 * pairs


def test_common_words_meet_few_rows_in_the_first_round(spark, monkeypatch):
    met, whole = [], keywords.rows_with_words
    monkeypatch.setattr(keywords, "rows_with_words", lambda s, d: met.append(whole(s, d).count()) or whole(s, d))
    text = F.concat_ws(" ", F.lit("alpha beta"), F.when(F.col("id") % 2 == 0, "gamma"), F.when(F.col("id") % 3 == 0, "delta"))
    docs = spark.range(3000).select(F.concat(F.lit("d"), F.lpad("id", 4, "0")).alias("id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), text.alias("text"))
    sets = {"one": ["alph"], "two": ["beta", "gam"], "three": ["alpha", "amm", "delta"], "none": ["alpha", "omega"]}
    queries = spark.createDataFrame(list(sets.items()), "qid string, words array<string>")
    got = {(r.qid, r["rank"]): r.id for r in keywords.search_many(queries, docs, 3, broadcast_sets=0).collect()}
    want = {"one": [2999, 2998, 2997], "two": [2998, 2996, 2994], "three": [2994, 2988, 2982]}
    assert got == {(q, i + 1): f"d{n}" for q, ids in want.items() for i, n in enumerate(ids)}
    assert met[0] <= 3 * 600
