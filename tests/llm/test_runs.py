import hashlib
import random
import zlib

import pytest

from mnemograph.llm import op12
from mnemograph.llm.runs import collapsed, periodic_runs, runs_of


def brute(words, least=12):
    """All maximal stretches of each period, without those that have a smaller one."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, 2 * q) and not any(all(words[j] == words[j + r] for j in range(s, s + size - r)) for r in range(1, q)):
                found.append((s, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, z, q in runs for i in range(s + q, s + z)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest("".join(f"{s},{z},{q}\n" for s, z, q in runs)),
        digest(" ".join(w.decode() for i, w in enumerate(words) if i not in dropped)),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for least in (2, 5, 12):
        for _ in range(150):
            words = [rng.choice("abcdefgh"[:letters]).encode() for _ in range(rng.randint(0, 60))]
            assert runs_of(words, least) == brute(words, least)


def test_runs_inside_runs():
    rng = random.Random(3)
    for _ in range(150):
        words = []
        while len(words) < 120:
            block = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))] * rng.randint(1, 5)
            words += (block * rng.randint(1, 3)) + [str(rng.random())] * rng.randint(0, 2)
        words = [w.encode() for w in words]
        assert runs_of(words, 12) == brute(words)


def test_many_equal_words_stay_fast():
    assert runs_of([b"a"] * 50_000, 12) == [(0, 50_000, 1)]
    assert collapsed([b"a"] * 50_000, [(0, 50_000, 1)]) == b"a"


def test_query_against_brute_force(spark, docs, prose, tmp_path):
    rng = random.Random(9)
    line = prose(9)
    texts = [prose(rng.randint(1, 90)) for _ in range(60)] + [
        None, "", " \t\n\x0b\x0c\r ", "one", " ".join(["x"] * 11), " ".join(["x"] * 12), "a b " * 6, f"{line}\n{line}  {line}\tend",
        prose(40) + " " + " ".join([line] * 5) + " " + prose(30), " ".join([line] * 3) + " " + " ".join([line] * 3), "long " + prose(3_000),
    ]
    texts += [texts[-1][:2000]] * 3
    df = docs(texts)
    repeated = df.where("doc_id < 3").union(df.where("doc_id = 3").selectExpr("cast(null as long) doc_id", *df.columns[1:]))
    df.union(repeated).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12.query(spark, str(tmp_path)).collect()), key=repr)
    wanted = [expected(i, t) for i, t in enumerate(texts)] + [expected(i, texts[i]) for i in range(3)] + [expected(None, texts[3])]
    assert got == sorted(wanted, key=repr)
    assert sum(r[1] for r in got) > 5


def test_no_rows_and_columns(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12.query(spark, str(tmp_path))
    assert got.count() == 0
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
        ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    out = periodic_runs(docs(["a a a"]), least=3)
    assert [r.asDict(True) for r in out.collect()] == [{"doc_id": 0, "n_words": 3, "runs": [{"start": 0, "length": 3, "period": 1}], "collapsed": "a"}]
