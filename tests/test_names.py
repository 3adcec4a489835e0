"""Names that are part of each other, over all rows."""

import random

import pytest

from mnemograph.operators import joins, names
from mnemograph.operators.skew import numbered

WORDS = ["ann", "anna", "bo", "hann", "lee", "al", "na"]


def texts(rng, n):
    return ["".join(rng.choice(WORDS) + rng.choice([" ", "  ", "", "\t"]) for _ in range(rng.randint(0, 4))) for _ in range(n)]


def test_held_texts_equal_all_pairs(spark):
    rng = random.Random(3)
    parts, wholes = [*texts(rng, 60), None, "", " ", "a\x1fb"], [*texts(rng, 80), None, "", "x a\x1fb", "lee" * 3000]
    a = spark.createDataFrame([(x,) for x in parts * 2], "part string")
    b = spark.createDataFrame([(x,) for x in wholes * 2], "whole string")
    got = [tuple(r) for r in names.held_texts(a, b).collect()]
    want = {(p, w) for p in parts for w in wholes if p and w and p.strip() and w.strip() and p in w}
    assert len(got) == len(want) and set(got) == want
    assert names.held_texts(a.limit(0), b).count() == 0 and names.held_texts(a, b.limit(0)).count() == 0


@pytest.fixture(scope="module")
def people(spark):
    """Sixty persons, further and further from (1, 0); the last ones have telling names."""
    rows = [(f"p{i:02}", "person", "Somebody", [1.0, i / 10]) for i in range(60)]
    rows += [("p90", "person", "Dr Ada Byron", [0.1, 1.0]), ("p91", "person", "ada", [0.0, 1.0]), ("p92", "person", " ", [0.0, 1.0])]
    rows += [("p93", "person", None, [1.0, 0.0]), ("p94", "person", "Ada Byron", None), ("t1", "tool", "Ada Byron", [1.0, 0.0])]
    return spark.createDataFrame(rows, "id string, node_type string, content string, embedding array<double>")


def ask(spark, *rows):
    return spark.createDataFrame(rows, "qid string, name string, embedding array<double>")


def test_find_entity_at_any_rank(spark, people):
    east = [1.0, 0.0]
    asked = ask(spark, ("a", " Ada Byron ", east), ("b", "Ada", east), ("c", "the adamant", east), ("d", "nobody", east), ("e", "", east), ("f", None, east), ("g", "somebody", [0.0, 1.0]), ("h", "ada", None))
    got = {r.qid: r.id for r in joins.find_entity(asked, people, pool=3).collect()}
    assert got == {"a": "p90", "b": "p90", "c": "p91", "d": "p00", "e": "p00", "f": "p00", "g": "p59"}
    assert joins.find_entity(asked.limit(0), people).count() == 0


def test_discover_related_looks_past_any_number_of_namesakes(spark, people):
    asked = ask(spark, ("a", "somebody", [1.0, 0.0]), ("b", "ada", [0.0, 1.0]), ("c", " ", [1.0, 0.0]))
    got = {}
    for r in joins.discover_related(asked, people, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got["a"] == ["p93", "t1", "p90"]
    assert got["b"] == ["p92", "p59", "p58"]
    assert got["c"] == ["p00", "p93", "t1"]


def test_numbered_equals_the_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0, 0, 0, rng.randint(0, 99)]), f"{i:04}") for i in range(3000)] + [(None, "z")]
    rng.shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "t int, id string").repartition(7), ["t", "id"], "rank").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.t, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 3002))
    assert numbered(spark.createDataFrame([], "t int, id string"), ["t", "id"], "rank").count() == 0


def test_search_bookmarks(spark):
    rows = [("b1", "bookmark", "Bookmark: One", '{"url": "u1"}', [1.0, 0.1]), ("b2", "bookmark", "Two", "{}", [0.0, 1.0]), ("f", "fact", "x", "{}", [1.0, 0.0]), ("b3", "bookmark", "x", None, None)]
    nodes = spark.createDataFrame(rows, "id string, node_type string, content string, metadata string, embedding array<double>")
    got = joins.search_bookmarks(spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<double>"), nodes, 5).orderBy("rank").collect()
    assert [(r.id, r.title, r.url) for r in got] == [("b1", "One", "u1"), ("b2", "Two", None)]


def test_only_texts_that_hold_a_name_are_met(spark):
    """Texts that hold both words of a name apart from each other are as many as the rows, so they must not be met."""
    parts = spark.createDataFrame([(f"a{i} of",) for i in range(20)] + [("of the a1",)], "part string")
    apart = [(f"of the {' '.join(f'a{i} x' for i in range(20))} {n}",) for n in range(50)]
    wholes = spark.createDataFrame([*apart, ("see a3  of",), ("ba3 offer",), ("of the a11",)], "whole string")
    got = names._held(parts, wholes)
    assert sorted(r[0] for r in got.select("part").collect()) == ["a3 of", "of the a1"]
    pairs = parts.limit(1).select(names._pairs("part").alias("p")).first().p
    assert pairs == ["a0 of"]


def test_nearest_in_groups(spark):
    from mnemograph.operators.vector import nearest_in_groups

    queries = spark.createDataFrame([(g, f"{g}{i:03}", [1.0, i / 50]) for g in "ab" for i in range(100)] + [("c", "c", [1.0, 0.0])], "bucket string, qid string, embedding array<double>")
    rows = spark.createDataFrame([("a", "n1", [1.0, 0.0]), ("a", "n2", [1.0, 2.0]), ("b", "n3", [1.0, 1.0]), ("b", "n0", [1.0, 1.0]), ("d", "n4", [1.0, 0.0])], "bucket string, id string, embedding array<double>")
    got = {r.qid: r.id for r in nearest_in_groups(queries, rows, 7).collect()}
    assert len(got) == 200 and {v for k, v in got.items() if k[0] == "b"} == {"n0"}
    assert got["a000"] == "n1" and got["a099"] == "n2"
