"""The threshold join of two large vector sets, and tables published in versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.operators import vector
from mnemograph.operators.skew import top_rows
from mnemograph.session import new_path
from mnemograph.sources.versioned import Versioned


def frame(spark, key, matrix, kind=None):
    rows = [(f"{key}{i:04}", v.tolist(), f"t{i % 2}" if kind else "t") for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{'qid' if key == 'q' else 'id'} string, embedding array<double>, node_type string")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    pick = lambda n: centres[rng.integers(0, 40, n)] + 0.12 * rng.standard_normal((n, 24))
    return pick(700), np.concatenate([pick(2000), np.tile(centres[:1], (800, 1)), np.zeros((3, 24))])


@pytest.mark.parametrize("same", [None, "node_type"])
def test_balls_equal_cells(spark, clustered, same):
    q, c = frame(spark, "q", clustered[0], same), frame(spark, "c", clustered[1], same)
    for low in (0.8, 0.99, 1.0):
        exact = {tuple(r) for r in vector.nearest(q, c, 1, min_score=low, same=same).collect()}
        balls = {tuple(r) for r in vector.nearest(q, c, 1, min_score=low, same=same, broadcast_bytes=0, cell_rows=256).collect()}
        assert balls == exact and (exact or low == 1.0)


def test_few_pairs_meet_and_fewer_are_scored(spark, clustered):
    q, c = frame(spark, "q", clustered[0]), frame(spark, "c", clustered[1])
    work = vector.threshold_work(q, c, 0.95, cell_rows=256, ball_rows=32).first()
    assert work.pairs == 700 * 2803 and work.scored <= work.met <= 0.3 * work.pairs and work.scored <= 0.1 * work.pairs


def test_few_random_pairs_are_scored_in_full(spark):
    rng = np.random.default_rng(1)
    c = rng.standard_normal((600, 64))
    q = np.concatenate([c[:50] + 0.2 * rng.standard_normal((50, 64)), rng.standard_normal((200, 64))])
    work = vector.threshold_work(frame(spark, "q", q), frame(spark, "c", c), 0.85).first()
    assert work.scored < 0.05 * work.pairs


def test_nothing_to_join(spark):
    none = frame(spark, "q", np.zeros((0, 4)))
    some = frame(spark, "c", np.eye(4))
    assert vector.nearest(none, some, 1, min_score=0.8, broadcast_bytes=-1).count() == 0
    assert vector.nearest(frame(spark, "q", np.eye(4)), some.limit(0), 1, min_score=0.8, broadcast_bytes=-1).count() == 0


SCHEMA = "id int, text string, kind string"


def test_versions_share_parts(spark):
    table = Versioned(spark, new_path(spark, "v"), SCHEMA, "kind")
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert table.read().count() == 0
    table.publish(rows((1, "a", "x"), (2, "b", "y/ z"), (3, "c", None)), 0)
    held = table.read()
    table.publish(rows((1, "A", "x"), (4, "d", "w")), 1, replaced=["y/ z"])
    got = lambda df: {tuple(r) for r in df.select("id", "text", "kind").collect()}
    old = {(1, "a", "x"), (2, "b", "y/ z"), (3, "c", None)}
    assert got(held) == old == got(table.read(version=0)) == got(table.read(before=1))
    assert got(table.read()) == {(1, "A", "x"), (4, "d", "w"), (3, "c", None)} and got(table.read(only=["x"])) == {(1, "A", "x")}
    assert table.pointer() == {"x": 1, "w": 1, None: 0}
    table.publish(rows((9, "again", "x")), 1)
    assert got(table.read(only=["x"])) == {(1, "A", "x")}
    table.publish(rows(), 2, replaced=["x"])
    table.prune(1)
    assert table.numbers() == [2] and got(table.read()) == {(4, "d", "w"), (3, "c", None)}


def test_an_unfinished_version_is_not_seen(spark):
    table = Versioned(spark, new_path(spark, "v"), SCHEMA, "kind")
    first = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    table.publish(first, 0)
    first.withColumn("text", F.lit("broken")).write.partitionBy("kind").parquet(f"{table.path}/data/version=1")
    assert table.read().first().text == "a"
    table.publish(first.withColumn("text", F.lit("b")), 1)
    assert table.read().first().text == "b" and table.read(version=0).first().text == "a"


def test_a_hop_shuffles_no_edges(spark):
    from mnemograph.operators import graph

    rows = [(f"n{i}", f"n{i % 7}", f"n{(3 * i) % 50}", "p", ["n1"], 0.1 * (i % 9), [1.0, float(i)]) for i in range(300)]
    nodes = spark.createDataFrame(rows, "id string, subject_id string, object_id string, predicate string, entity_links array<string>, weight double, embedding array<double>")
    laid = graph.lay_out(nodes, 3)
    seeds = nodes.select(F.col("id").alias("qid"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hop = seeds.select("qid", F.col("id").alias("node_id")).join(laid.edges, "node_id")
        plan = hop._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        found, walked = graph.expand(nodes, seeds, nodes.select(F.col("id").alias("qid"), "embedding"), 2, 3, laid)
        alone = graph.expand(nodes, seeds, nodes.select(F.col("id").alias("qid"), "embedding"), 2, 3)
        assert sorted(map(str, found.collect())) == sorted(map(str, alone[0].collect()))
        assert sorted(map(str, walked.collect())) == sorted(map(str, alone[1].collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        graph.expand(nodes, seeds, nodes.select(F.col("id").alias("qid"), "embedding"), 2, 4, laid)


def test_quantiles_of_merged_sketches(spark):
    from mnemograph.operators import aggregates

    rng = np.random.default_rng(3)
    values = {"a": rng.lognormal(0, 3, 2001), "b": np.array([0.0, -1.0, 5.0]), "c": np.full(500, 0.25)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None)], "k string, x double")
    parts = [aggregates.quantile_sketch(rows.filter(F.pmod(F.hash("x"), F.lit(2)) == i), ["k"], "x") for i in (0, 1)]
    got = {r.k: r for r in aggregates.sketch_quantiles(parts[0].unionByName(parts[1]), ["k"], {"p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()}
    for k, v in values.items():
        for name, share in (("p50", 0.5), ("p90", 0.9), ("p100", 1.0)):
            exact = max(0.0, float(np.sort(v)[int(np.ceil(len(v) * share)) - 1]))
            assert abs(got[k][name] - exact) <= 0.01 * exact + 1e-12 and got[k].n == len(v)


@pytest.mark.parametrize("k, low", [(7, None), (1, 0.8)])
def test_a_query_is_final_where_it_is_found(spark, clustered, monkeypatch, k, low):
    q, c = frame(spark, "q", clustered[0], True), frame(spark, "c", clustered[1], True)
    found = []
    monkeypatch.setattr(vector, "top_rows", lambda df, *rest: found.append(df.count()) or top_rows(df, *rest))
    opts = dict(min_score=low, broadcast_bytes=0, cell_rows=256)
    got = vector.nearest(q, c, k, **opts).drop("rank").collect()
    assert 0 < found[0] <= 700 * k
    exact = vector.nearest(q, c, k, min_score=low).drop("rank").collect()
    assert sorted(got) == sorted(exact)


def test_stripes_hold_a_bounded_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    q, c = frame(spark, "q", rng.standard_normal((500, 8))), frame(spark, "c", np.round(rng.standard_normal((300, 8)), 0))
    exact = sorted(vector.nearest(q, c, 9).collect())
    monkeypatch.setattr(vector, "STRIPE_HITS", 9 * 12)
    assert sorted(vector.nearest(q, c, 9, broadcast_bytes=0).collect()) == exact
    assert sorted(vector.nearest(q, c, 9, broadcast_bytes=0, cell_rows=10).collect()) == exact


def test_a_layout_holds_a_row_once(spark):
    """Own edges are made of the row where it is met; they are the same as those of ``edges`` under the caps."""
    from mnemograph.operators import graph

    rows = [(f"n{i}", f"n{i % 7}" if i % 3 else None, f"n{(3 * i) % 20}" if i % 4 else "", "p", [f"n{j}" for j in range(i % 5)] + [""], 0.1 * (i % 9), None) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id string, subject_id string, object_id string, predicate string, entity_links array<string>, weight double, embedding array<double>")
    laid = graph.lay_out(nodes, 3)
    assert laid.own.count() == 60 and set(laid.edges.columns) == {"node_id", "other", "predicate"}
    incoming, want = {}, []
    for e in graph.edges(nodes).collect():
        if e.kind.startswith("incoming"):
            incoming.setdefault((e.node_id, e.kind), []).append((-e.weight, e.other, e))
        else:
            want.append((e.node_id, e.other, e.source, e.target, e.predicate, e.kind == "object" or (e.kind == "entity_link" and e.pos < 3)))
    for found in incoming.values():
        want += [(e.node_id, e.other, e.source, e.target, e.predicate, True) for _, _, e in sorted(found, key=lambda x: x[:2])[:3]]
    got = laid.steps(nodes.select(F.col("id").alias("qid"), F.col("id").alias("node_id"))).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(qid=w[0], other=w[1], source=w[2], target=w[3], predicate=w[4], is_edge=w[5])) for w in want)


def test_single_precision_leaves_out_no_row_at_the_threshold():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((600, 48))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q = v[:300] + 0.11 * rng.standard_normal((300, 48))
    q /= np.linalg.norm(q, axis=1)[:, None]
    exact = np.rint(np.clip((q * v[:300]).sum(axis=1), 0, 1) * vector.SCALE).astype(np.int64)
    ids = np.array([f"n{i:03}" for i in range(600)], dtype=object)
    best, _ = vector._best_within(q, ids, v, exact)
    assert [(int(i), n, int(s)) for i, n, s in best[["q", "id", "s"]].to_numpy()] == [(i, ids[i], exact[i]) for i in range(300)]
    none, _ = vector._best_within(q, ids, v, exact + 1)
    assert not len(none)


def test_pairs_that_a_third_of_the_coordinates_leaves_are_not_scored_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    q, v = (rng.standard_normal((n, 64)) for n in (200, 2000))
    q, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (q, v))
    seen, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: seen.append(len(a)) or einsum(how, a, b))
    vector._best_within(q, np.arange(2000).astype(str).astype(object), v, np.full(200, 750_000))
    assert sum(seen) < 0.001 * 200 * 2000


@pytest.mark.parametrize("k", [2, 5])
def test_rows_above_a_score_are_found_without_moving_the_corpus(spark, monkeypatch, k):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16))
    v = np.concatenate([centres[rng.integers(0, 40, 900)] + 0.5 * rng.standard_normal((900, 16)), np.repeat(centres, 5, axis=0), np.zeros((3, 16))])
    ids = rng.permutation(len(v)).tolist()
    corpus = spark.createDataFrame([(f"n{i}", x) for i, x in zip(ids, v.tolist(), strict=True)], "id string, embedding array<double>").repartition(3)
    queries = frame(spark, "q", centres)
    want = {tuple(r) for r in vector.nearest(queries, corpus, k, min_score=0.52).collect()}
    monkeypatch.setattr(vector, "HELD_ROWS", 10)
    monkeypatch.setattr(vector, "_striped", None)
    got = vector.nearest(queries, corpus, k, min_score=0.52)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 40 * k
