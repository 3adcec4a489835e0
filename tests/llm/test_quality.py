import re
from collections import Counter

from pyspark.sql import functions as F

from mnemograph.llm import op02, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n ", "a b c", "x " * 40, "# * $ % & | < >" * 4, "l1 a\nl2\nl1 a\n\n  \nl2\nl2", "ünï cödé Ä\x0bÖ\x0c! É",
    " ".join(f"w{i % 9}" for i in range(60)), " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(40)),
]


def features(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_features_equal_a_plain_count(docs, prose):
    long = prose(20_000)
    texts = [*TEXTS, long, long + "\n" + long]
    got = {r.doc_id: r for r in quality.features(docs(texts)).collect()}
    for i, text in enumerate(texts):
        want = features(text)
        assert tuple(got[i][c] for c in quality.FEATURES) == want, i
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_limits_adapt_and_junk_goes(spark, docs, prose, tmp_path, twin, same):
    clean = [prose(60) for _ in range(150)]
    code = [" ".join(f"{w}*" if i % 9 == 0 else w for i, w in enumerate(prose(60).split())) for _ in range(150)]
    junk = [" ".join(w + "$$$" for w in prose(60).split()) for _ in range(12)]
    table = docs(clean + junk, source="web").union(docs(code, ids=range(1000, 1150), source="code")).union(docs(TEXTS, ids=range(2000, 2010), lang=None, source=None))
    table = table.union(docs([prose(60)], ids=[3000], lang="fr", source="rare"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = op02.query(spark, str(tmp_path))
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert set(range(150)) <= kept and set(range(1000, 1150)) <= kept and 3000 in kept and not kept & set(range(150, 162))
    assert not kept & {2000, 2001, 2002, 2003, 2004}
    same(out, twin(op02.SQL, documents=table))


def test_a_third_of_junk_does_not_excuse_itself(docs, prose, tmp_path, twin, same):
    clean = [prose(60) for _ in range(400)]
    junk = [" ".join(w + "$$$" for w in prose(60).split()) for _ in range(200)]
    table = docs(clean[:200], source="web").union(docs(clean[200:], ids=range(200, 400), source="news")).union(docs(junk, ids=range(1000, 1200), source="junk"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = op02.query(table.sparkSession, str(tmp_path))
    assert {r.doc_id for r in out.where("kept").collect()} == set(range(400))
    same(out, twin(op02.SQL, documents=table))


def test_sketches_merge(docs, prose):
    texts = [prose(20 + i) for i in range(60)]
    whole = quality.sketches(quality.features(docs(texts)))
    parts = quality.sketches(quality.features(docs(texts[:25]))).union(quality.sketches(quality.features(docs(texts[25:]))))
    keys = ["lang", "source", "metric", "bucket"]
    merged = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_repeated_rows_clashing_columns_and_no_rows(docs):
    table = docs(["a b " * 20, "a b " * 20], ids=[1, 1])
    judged = quality.decide(quality.features(table), quality.thresholds(quality.sketches(quality.features(table))))
    assert [(r.doc_id, r.kept) for r in judged.collect()] == [(1, False)] * 2
    empty = quality.features(docs([]))
    assert quality.decide(empty, quality.thresholds(quality.sketches(empty))).count() == 0
