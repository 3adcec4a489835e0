from collections import Counter

import corpus_pipeline
from mnemograph.llm.words import slices  # noqa: F401


def staged(spark, docs, tmp_path):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        out.append(docs)
    return out


def test_stages_take_effect(spark, docs, prose, tmp_path):
    clean = [prose(80) for _ in range(60)]
    junk = [" ".join(w + "$$$" for w in prose(60).split()) for _ in range(5)]
    near = clean[0].split()
    near[-1] = "changed"
    passage = prose(60)
    texts = clean + junk + [" ".join(near), clean[1], f"{prose(40)} {passage}", f"{passage} {prose(45)}", None, ""]
    table = docs(texts).union(docs([clean[2]], ids=[2])).union(docs([prose(90) for _ in range(20)], ids=range(500, 520), source="b"))
    first, second, third, fourth, last = staged(spark, table, tmp_path)
    assert all(x.columns == table.columns for x in (first, second, third, fourth))
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    assert not set(range(60, 65)) & set(ids(first)) and set(range(60)) <= set(ids(first)) and not {69, 70} & set(ids(first))
    kept = ids(second)
    assert not {65, 66} & set(kept) and max(kept.values()) == 1 and set(range(60)) | {67, 68} <= set(kept)
    texts_left = {r.doc_id: r.text for r in third.collect()}
    assert texts_left[67].endswith(passage) and passage not in texts_left[68] and texts_left[3] == clean[3]
    assert all(n <= 2 for n in ids(fourth).values()) and set(ids(fourth)) <= set(ids(third))
    assert set(ids(last)) == set(ids(fourth))
    ran = corpus_pipeline.run(spark, _write(table, tmp_path))
    assert sorted(map(tuple, ran.select("doc_id", "length").collect())) == sorted(map(tuple, last.select("doc_id", "length").collect()))


def _write(table, tmp_path):
    table.write.parquet(f"{tmp_path}/in/documents.parquet")
    return f"{tmp_path}/in"


def test_no_rows(spark, docs, tmp_path):
    assert [x.count() for x in staged(spark, docs([]), tmp_path)] == [0] * 5


def test_near_dedup_takes_pairs_above_four_fifths(spark, docs, prose, tmp_path):
    base = prose(400).split()
    near = [w + "x" if i % 50 == 20 else w for i, w in enumerate(base)]  # 8 words apart: 356 of 436 shingles, 0.8165
    table = docs([" ".join(base), " ".join(near), prose(400)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, str(tmp_path)).collect()) == [0, 2]


def test_quality_stage_keeps_values_of_clashing_columns(spark, docs, prose):
    from pyspark.sql import functions as F

    import corpus_pipeline

    given = docs([prose(60), prose(80), "x", None, "word " * 30_000]).withColumns({"n_words": F.lit(7), "high_symbols": F.lit("h"), "_lang": F.lit("l"), "_row": F.lit(1)})
    got = corpus_pipeline.quality_rules(spark, given, "")
    assert got.dtypes == given.dtypes and {(r.kept, r.n_words, r.high_symbols, r._lang, r._row) for r in got.collect()} == {("x", 7, "h", "l", 1)}
