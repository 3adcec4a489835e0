import random

import duckdb
import pytest

#: doc_id, text, lang, source and columns whose names clash with results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, component_id int, rank int, key string"


def rows_of(spark, texts, ids=None, lang="en", source="a"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, None if t is None else len(t), 7, "x", -1, 3, "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, **kw: rows_of(spark, texts, **kw)


@pytest.fixture
def prose():
    """A generator of invented texts: prose(n words)."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def twin():
    """Rows of a DuckDB twin over Spark tables given by name, columns by name."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        return sorted(({n: v for n, v in zip(names, r, strict=True)} for r in got.fetchall()), key=lambda r: repr(sorted(r.items())))

    return run


@pytest.fixture
def same():
    def check(df, expected):
        got = sorted((r.asDict() for r in df.collect()), key=lambda r: repr(sorted(r.items())))
        assert got == expected

    return check
