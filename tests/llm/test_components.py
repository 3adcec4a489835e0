import random

from mnemograph.llm.components import components
from mnemograph.llm.scratch import Scratch


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 260)
    edges = list(zip(ids[:100], ids[1:101], strict=True)) + [(ids[150], x) for x in ids[101:200]] + [(ids[0], ids[0])]
    edges += list(zip(ids[200:220], [*ids[201:220], ids[200]], strict=True)) * 2
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    want = {x: min(g) for g in (ids[:101], ids[101:200], ids[200:220]) for x in g}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
