import random
import re

import numpy as np
import pyarrow as pa

from mnemograph.llm import globs, op01
from mnemograph.llm.words import text_bytes

SCHEMA = "page_id long, url string, html string, host int, rule string, verdict int"
URLS = [
    "http://example.org/es/1", "https://a.example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/", "HTTP://WWW.Example.COM/fr/x?y#z",
    "http://x.com/de/", "http://x.com/de", "http://x.com", "http://cheap-pills.net/a", "http://www.cheap-pills.example.com/en/450?page=2", "nourl", "", None, "://", "http:///es/",
    "ftp://é.org/ß?q", "http://a.b//c://d.org/", "http://ORG/", "http://org", "http://x.com/wp-login.php", "http://spam-farm.a.org/es/", "http://q.x.y.com/", "http://h\n.org/\nx", "x://y.net/" + "p" * 70_000,
]


def plain(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 1
        elif glob[i] == "*":
            out += "[^/]*"
        elif glob[i] == "?":
            out += "[^/]"
        else:
            i += glob[i] == "\\"
            out += re.escape(glob[i])
        i += 1
    return re.compile(out, re.S)


def test_automaton_equals_regular_expressions():
    rng = random.Random(2)
    for _ in range(60):
        patterns = ["".join(rng.choice(["a", "b", "é", "/", "?", "*", "**", "ab", "\\*"]) for _ in range(rng.randint(1, 30))) for _ in range(12)]
        texts = ["".join(rng.choice("ab/éc*") for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None]
        data, offsets = text_bytes(pa.array(texts))
        got = globs.Automaton(patterns).matches(data, offsets)
        want = np.array([[bool(plain(p).fullmatch(t or "")) for p in patterns] for t in texts])
        assert (got == want).all()


def test_verdicts_equal_the_twin(spark, tmp_path, twin, same):
    pages = spark.createDataFrame([(i // 2, u, "<html>", 1, "r", 2) for i, u in enumerate(URLS + URLS)], SCHEMA)
    distinct = spark.createDataFrame([(i, u, "<html>", 1, "r", 2) for i, u in enumerate(URLS)], SCHEMA)
    distinct.write.parquet(f"{tmp_path}/pages.parquet")
    same(op01.query(spark, str(tmp_path)), twin(op01.SQL, pages=distinct))
    assert globs.judge(pages, op01.RULES, op01.BLOCKED).count() == 2 * len(URLS)
    assert globs.judge(pages.limit(0), op01.RULES, []).count() == 0


def test_longest_rule_wins_and_ties_block(spark):
    rules = [globs.Rule("allow", "a.b"), globs.Rule("block", "b", "/x"), globs.Rule("block", "a.b", "/xy"), globs.Rule("allow", "a.b", "/xz"), globs.Rule("block", "a.b", "/xz")]
    pages = spark.createDataFrame([(1, "u://a.b/x"), (2, "u://c.b/xq"), (3, "u://q.a.b/xyz"), (4, "u://a.b/xz"), (5, "u://a.bb/x"), (6, "u://a.b")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in globs.judge(pages, rules, []).collect()}
    assert got == {1: ("b/x", "block"), 2: ("b/x", "block"), 3: ("a.b/xy", "block"), 4: ("a.b/xz", "block"), 5: (None, "allow"), 6: ("a.b", "allow")}
