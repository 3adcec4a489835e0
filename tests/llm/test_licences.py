from mnemograph.llm import licences, op09

SCHEMA = "page_id long, url string, html string, path int, score string, block long"
MIT = "Released under the MIT License."
ROWS = [
    (0, "http://a.org/x/LICENSE", f"<p>{MIT}</p>"), (1, "http://a.org/x/y/z.html", "<p>text</p>"), (2, "http://a.org/w", "nothing"),
    (3, "http://a.org/x/y/COPYING.txt", "<pre>This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License</pre>"),
    (4, "http://A.org/x/q?z#r", "plain"), (5, "http://a.org/x/own", "<div>Licensed under <b>the Apache</b> License, Version 2.0.</div>"),
    (6, "http://b.org/x/y", "<p>the license of the mit work under version</p>"), (7, None, None), (8, "", ""), (9, "http://c.org", f"<title>{MIT.upper()}</title>"),
    (10, "http://a.org/x/y/z.html", "<p>text</p>"), (10, "http://a.org/x/y/z.html", "<p>text</p>"), (11, "http://c.org/notice-2/", "x " * 60_000 + f"\n{MIT}"),
    (12, "http://d.org/LICENCE", "no licence at all"), (13, "http://d.org/a", "text"),
]


def test_pages_and_twin(spark, tmp_path, twin, same):
    pages = spark.createDataFrame([(*r, 1, "s", 2) for r in ROWS], SCHEMA)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = op09.query(spark, str(tmp_path))
    got = {r.page_id: (r.licence, r.found, r.directory) for r in out.collect()}
    assert got[0] == ("mit", "text", None) and got[1] == ("gpl-3.0", "directory", "a.org/x/y/") and got[2] == (None, None, None)
    assert got[3] == ("gpl-3.0", "text", None) and got[4] == ("mit", "directory", "a.org/x/") and got[5] == ("apache-2.0", "text", None)
    assert got[6] == got[7] == got[8] == got[13] == (None, None, None) and got[9] == ("mit", "text", None) and got[11] == ("mit", "text", None)
    assert out.count() == len(ROWS)
    once = spark.createDataFrame([(*r, 1, "s", 2) for i, r in enumerate(ROWS) if i != 11], SCHEMA)
    once.write.parquet(f"{tmp_path}/once/pages.parquet")
    same(op09.query(spark, f"{tmp_path}/once"), twin(op09.SQL, pages=once))
    assert licences.scan(pages.limit(0)).count() == 0


def test_anchors_miss_no_block_that_reaches_the_cosine():
    rows = licences.weights(licences.TEMPLATES)[2]
    kept = set(licences.anchors(rows, 0.8))
    for i in {r[0] for r in rows}:
        assert sum(w * w for k, _, t, w in rows if k == i and t not in kept) < 0.64
