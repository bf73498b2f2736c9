"""HTML extraction."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.llm import htmlextract as h
from tests.llm.helpers import prose

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"),
    ("<article><h1>A &amp; B</h1><p>one\n  two</p><p>three</article>", "A & B\none two\nthree"),
    ("<body><nav>menu</nav><header>top</header><main><p>x<b>y</b> z</p></main><footer>f</footer>", "xy z"),
    ("<article><p><b>T.<br><p>a</p></article>", "T.\na"),
    ("<article>a<!-- <p>no</p> -->b<script>if(a<b){'</p>'}</script>c<style>p{}</style></article>", "abc"),
    ('<div class="sidebar">s</div><div id="content"><p>body</p></div><div class="cookie-notice">c</div><form>f<input></form>', "body"),
    ('<article><p>x</p><aside>no</aside><section class="comments"><p>reader</p></section></article>', "x"),
    ('<article><p title="a>b">x</p></article>', "x"), ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<article>&lt;p&gt; &#233;&eacute;&nbsp;&copy</article>", "<p> éé ©"), ("<article><p>cut off", "cut off"), ("<article><p hidden>x</p><p>y</p></article>", "y"),
    ('<body class="has-sidebar"><article class="post"><p>kept</p></article></body>', "kept"), ("a < b and c > d", "a < b and c > d"),
    ("<p title=it's>Hello one</p><p>Second para</p><p>don't stop</p>", "Hello one\nSecond para\ndon't stop"),
    ('<main><p>x</p></main><section class=comments><article>reader</article></section>', "x"), ('<p>x</p><section class="comments"><article>reader</article></section>', "x"),
    ('<article><div class="social-science"><p>a</p></div><p class="alert">b</p><div class="cookie-banner">c</div></article>', "a\nb"),
    ('<article><p title="my class=sidebar">x</p></article>', "x"), ('<div class="nav-wrapper"><article>x</article></div>', "x"), ("<article><p>x<span hidden>no</span>y</p></article>", "xy"),
    ("<article><a href=/x/>link</a><p>y</p></article>", "link\ny"), ("<article><p>cut <b", "cut"), ("<!--><article>x</article>", "x"), ("<article><p>1 &lt;b&gt; &amp;amp; 2</article>", "1 <b> &amp; 2"),
    ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"), ("<ARTICLE><P>X</P></ARTICLE>", "X"),
])
def test_markup(page, text):
    assert h.extract(page) == text


def site(n, k):
    """A page without semantic tags: the same frame, another body."""
    body = "".join(f"<div class=t>{prose(100 * n + i, 8)}</div>" for i in range(k))
    return f"<html><body><div class=a>Site name</div><div class=b>Home</div><div class=b>About us</div><div class=c>{body}</div><div class=d>All rights with the site</div></body></html>"


def extracted(spark, pages, **options):
    df = spark.createDataFrame([(i, url, html_) for i, (url, html_) in enumerate(pages)], SCHEMA)
    return [r.text for r in h.extract_articles(df, **options).orderBy("page_id").collect()]


def body_of(n, k):
    return "\n".join(prose(100 * n + i, 8) for i in range(k))


@pytest.mark.parametrize("most_constants", [h.MOST_CONSTANTS, 0])
def test_constant_nodes_become_template(spark, most_constants):
    """All pages of a host are counted, whatever list of names there is."""
    pages = [("http://a.example/x", site(n, 2 + n % 4)) for n in range(9)]
    got = extracted(spark, pages, marks=False, most_constants=most_constants)
    assert got == [body_of(n, 2 + n % 4) for n in range(9)]
    alone = extracted(spark, [("http://a.example/x", site(1, 2))])
    assert "Site name" in alone[0]


def test_another_layout_and_an_error_page_keep_the_template(spark):
    """One host with two layouts, an empty page and a page of nothing but the frame."""
    other = lambda n: f"<html><body><table><tr><td>Other frame</td></tr></table><section>{prose(500 + n, 9)}</section><div class=z>Imprint</div></body></html>"
    pages = [("http://a.example/x", site(n, 3)) for n in range(6)] + [("http://a.example/o", other(n)) for n in range(5)]
    pages += [("http://a.example/e", ""), ("http://a.example/f", site(0, 0)), ("http://b.example/o", other(77))]
    got = extracted(spark, pages)
    assert got[:6] == [body_of(n, 3) for n in range(6)]
    assert got[6:11] == [prose(500 + n, 9) for n in range(5)]
    assert got[11] == ""
    assert "Imprint" in got[13]  # one page of its host


def test_copies_are_no_template(spark):
    """Copies and near copies of an article, on any share of a host's pages, keep it."""
    page = site(1, 6)
    assert extracted(spark, [("http://a.example/x", page)] * 8) == ["Site name\nHome\nAbout us\n" + body_of(1, 6) + "\nAll rights with the site"] * 8
    near = [page.replace("<div class=c>", f"<div class=c><div class=t>edition {w}</div>") for w in "abcdefgh"]
    got = extracted(spark, [("http://a.example/x", p) for p in near])
    assert all(body_of(1, 6) in text for text in got)
    mixed = extracted(spark, [("http://a.example/x", p) for p in near] + [("http://a.example/y", site(n, 6)) for n in range(20, 26)])
    assert mixed[:8] == [f"edition {w}\n" + body_of(1, 6) for w in "abcdefgh"]
    assert mixed[8:] == [body_of(n, 6) for n in range(20, 26)]


def test_a_line_of_many_articles_stays(spark):
    """A slot that varies holds content, also where one of its texts comes again."""
    pages = [("http://a.example/x", site(n, 4).replace("</div><div class=d>", "<div class=t>To be continued</div></div><div class=d>")) for n in range(12)]
    assert extracted(spark, pages) == [body_of(n, 4) + "\nTo be continued" for n in range(12)]


def slow_constants(rows):
    """From (content, slot, text, characters), with dictionaries."""
    seen = {}
    for c, s, t, n in rows:
        seen.setdefault((s, t), {})[c] = n
    again = {k for k, v in seen.items() if len(v) >= 2}
    every, some = {}, {}
    for k, v in seen.items():
        for c, n in v.items():
            every[c] = every.get(c, 0) + n
            some[c] = some.get(c, 0) + n * (k in again)
    counted = {k: sum(100 * some[c] <= 50 * every[c] for c in v) for k, v in seen.items()}
    out = []
    for slot in {s for s, _ in counted}:
        mine = {k: n for k, n in counted.items() if k[0] == slot}
        total = sum(mine.values())
        for least in ([2] if total >= 20 else []) + [3]:
            if 100 * sum(n for n in mine.values() if n >= least) >= 50 * total > 0:
                out += [k for k, n in mine.items() if n >= least]
                break
    return sorted(out)


def test_constants_against_brute_force(spark):
    r = random.Random(4)
    rows = [(c, s, r.randrange(3) if s < 4 else r.randrange(60), 5 + s) for c in range(60) for s in range(9)]
    rows += [(c, s, 900 + s, 5) for c in range(100, 106) for s in range(9)] + rows[:20]
    rows += [(c, s, 7 if c < 202 + s else c, 5) for c in range(200, 206) for s in range(20, 24)] + [(c, 40, c, 500) for c in range(60)] + [(c, 41, c, 500) for c in range(200, 206)]
    got = h.constants(spark.createDataFrame(rows, "c long, slot long, t long, chars long"))
    assert sorted(map(tuple, got.collect())) == slow_constants(rows)
    assert got.count() > 0


def shapes(*texts):
    return [h.Shape(x, [i], []) for i, x in enumerate(texts)]


def test_matching_keeps_order(monkeypatch):
    a, b = shapes(*"abcd"), shapes(*"xbyd")
    assert [(x.sig, y.sig) for x, y in h.aligned(a, b)] == [("b", "b"), ("d", "d")]
    # The heavier subtree wins where only one of two can be matched.
    a = [h.Shape("u", [0], shapes("k", "l", "m")), h.Shape("v", [1], [])]
    b = [h.Shape("v", [0], []), h.Shape("u", [1], shapes("k", "l", "m"))]
    assert [(x.sig, y.sig) for x, y in h.aligned(a, b)] == [("u", "u")]
    monkeypatch.setattr(h, "MOST_PAIRS", 1)
    assert [(x.sig, y.sig) for x, y in h.aligned(shapes(*"abcd"), shapes(*"xbyd"))] == [("b", "b"), ("d", "d")]


@pytest.mark.parametrize("page", ["<div>" * 3000 + "deep" + "</div>" * 3000, "<span>" * 3000 + "deep", "<div><ul><li>" * 2000 + "deep", "<a" * 5000, "<p title='" * 2000, "</x>" * 3000 + "deep"])
def test_deep_and_broken_pages(spark, page):
    texts = h.extract(page)
    assert texts in ("deep", "")
    got = extracted(spark, [("http://a.example/x", page), ("http://a.example/y", site(1, 2)), ("http://a.example/z", None)])
    assert got[0] == texts


def test_operator(spark):
    rows = [(n, f"https://Site.example/{n}", site(n, 3)) for n in range(30)]
    rows += [(50, None, site(50, 1)), (51, "https://other.example/x", None), (52, "no url", ""), (53, "https://site.example/q", site(53, 1)), (53, "https://site.example/q", site(53, 1)), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("TEXT", F.lit("clash"))
    got = h.extract_articles(df).collect()
    assert len(got) == 36
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 30:
            assert r.text == "\n".join(prose(100 * r.page_id + i, 8) for i in range(3))
    assert {r.text for r in got if r.page_id in (51, 52, None)} == {""}
    assert h.extract_articles(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    """These pages mark their article, so that what is wanted can be cut out by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in h.extract_articles(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert r.text == "\n".join(p for p in parts if p)


def test_host(spark):
    urls = ["https://A.b/c", "http://u:p@x.y:80/z", "HTTPS://Q.r", "no", None, "ftp://h?x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(h.host(F.col("url")).alias("h"))
    assert [r.h for r in df.collect()] == ["a.b", "x.y", "q.r", None, None, "h"]
