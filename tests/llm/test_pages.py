import random

import pytest

from mnemograph.llm import mainmatter, op11
from mnemograph.llm.mainmatter import SHARE, SURGE, WINDOW, extract, main_lines, main_text

LONG = "A sentence with some words that goes on for quite a while, so that a window of lines is heavy. "

PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t="</p><article>no";</script></head>
<body class="has-sidebar"><header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- <p>not this</p> --><div class="ad">Buy   now</div><div id="cookieNotice"><p>We use cookies</p></div>
<article class="post has-comments"><header><h1>Head &amp; tail</h1></header>
<p>One <b>bo</b>ld&nbsp;&copy;&#33;
 word<br>next</p><p>Of.<p>Open <i>paragraph<div class="advert-box">x<div>y</div></div>
<ul><li>first</li><li><a href="#">linked</a></li></ul><aside>see also</aside><form>mail <input> <p>send</p></form>
<p>a < b &lt;i&gt; &ampc</p><table><tr><td>1</td><td>2</td></tr></table>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section><p>End.</p></article>
<div class="related"><article><p>{LONG}</p></article></div><footer>&copy; site</footer></body></html>"""


def test_article_page():
    blocks = ["Head & tail", "One bold ©! word next", "Of.", "Open paragraph", "first", "linked", "a < b <i> &c", "1 2", "End."]
    assert extract(PAGE) == "\n\n".join(blocks)


def test_page_of_divs():
    page = f"""<body><div id=top>Site</div><div class=menu-main><a href=/>x</a></div>
    <div><a href=1>{LONG}</a> <a href=2>two</a></div><div><span>tag line</span></div>
    <div id=page><div><h1>Head</h1><p>short<p>{LONG * 3}<p>x</p></div><div><p>mid</p></div><div><p>{LONG * 2}</p><p>last</p></div></div>
    <div><div><p>Contact us in our office</p></div></div><div class=comments><p>{LONG * 9}</p></div></body>"""
    long = LONG.strip()
    assert extract(page).split("\n\n") == ["Head", "short", " ".join([long] * 3), "x", "mid", " ".join([long] * 2), "last"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), (" \n ", ""), ("<p></p>", ""), ("plain  words", "plain words"), ("<p>one<p>two", "one\n\ntwo"), ("<a href=x>only a link</a>", ""),
        ("<article>", ""), ("<article><p>Of", "Of"), ("<div class=ad>never closed<article><p>Kept</p></article>", "Kept"), ("a <b", "a"), ("1 < 2", "1 < 2"),
        ("<script>x", ""), ("<title>t</title>x", "x"), ("<main><nav>n</nav>x</main>", "x"), ("<ARTICLE><P>X</P></ARTICLE><FOOTER>f</FOOTER>", "X"),
        ("<article><p title='a>b'>q</p><![CDATA[c&d]]></article>", "q\n\nc&d"), ("<article>&amp;lt; &#x41; &nosuch; &am</article>", "&lt; A &nosuch; &am"),
    ],
)
def test_small_pages(page, text):
    assert extract(page) == text


def test_windows_against_a_plain_form():
    """A line is kept if its group surges, or between two surging groups without a dive."""
    rng = random.Random(7)
    for _ in range(400):
        lines = [("", 0, False) if rng.random() < 0.4 else (str(i), rng.choice([0, 3, 30, 70, 200, 900]), False) for i in range(rng.randint(0, 25))]
        n = len(lines)

        def group(i, lines=lines):
            a = b = i
            while a and lines[a - 1][0]:
                a -= 1
            while b + 1 < len(lines) and lines[b + 1][0]:
                b += 1
            return a, b

        def heavy(i, lines=lines):
            a, b = group(i)
            return max(sum(w for _, w, _ in lines[j : min(j + WINDOW, b + 1)]) for j in range(a, b + 1))

        most = max((heavy(i) for i in range(n) if lines[i][0]), default=0)
        surges = [bool(lines[i][0]) and heavy(i) > 0 and heavy(i) >= min(max(SURGE, SHARE * most), most) for i in range(n)]
        dives = [all(w == 0 for _, w, _ in lines[i : i + WINDOW]) and i + WINDOW <= n for i in range(n)]
        kept = []
        for i in range(n):
            pairs = ((a, b) for a in range(i) for b in range(i + 1, n) if surges[a] and surges[b])
            if lines[i][0] and (surges[i] or any(not any(dives[a + 1 : b - WINDOW + 1]) for a, b in pairs)):
                kept.append(lines[i][0])
        assert main_lines(lines) == kept, lines


def test_very_long_pages_take_linear_time():
    page = "<article>" + "<p>word &amp; word</p>" * 60_000 + "<div class=ad>" * 3000 + '<a "' * 5000
    assert extract(page).count("word & word") == 60_000
    assert extract("<" * 200_000 + "&" * 200_000).startswith("<<")


def test_rows_and_columns(spark, tmp_path):
    schema = "page_id long, url string, html string, text int, n_chars string, name string"
    rows = [(1, "u", PAGE, 5, "x", "y"), (1, "u", PAGE, 5, "x", "y"), (None, None, None, None, None, None), (2, "v", "", 1, "", ""), (3, "w", "<p>é😀", 1, "", "")]
    pages = spark.createDataFrame(rows, schema)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = op11.query(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = [(i, u, extract(h), len(extract(h))) for i, u, h, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kept = main_text(pages)
    assert kept.columns == ["page_id", "url", "n_chars", "name", "text"] and kept.where("name = 'y' and n_chars = 'x'").count() == 2
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op11.query(spark, f"{tmp_path}/none").count() == 0


def test_batches_stay_small(spark, monkeypatch):
    monkeypatch.setattr(mainmatter, "BATCH", 10)
    pages = spark.createDataFrame([(i, f"<p>page {i} {'x' * i}") for i in range(40)], "id long, html string")
    assert {r.id: r.text for r in main_text(pages).collect()} == {i: f"page {i} {'x' * i}".strip() for i in range(40)}
