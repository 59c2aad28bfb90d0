import html
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetscore.llm import html_extract as hx
from sheetscore.llm.common import prepare
from sheetscore.llm.html_blocks import blocks
from sheetscore.llm.labelled_pages import labelled_pages
from sheetscore.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_broken_html():
    assert blocks("") == []
    assert texts("a < b & c &lt;p&gt; &amp &am; 3&nbsp;€<p>x<p>y") == ["a < b & c <p> & &am; 3 €", "x", "y"]
    assert texts("<div>a<b>b<p>c</b>d</div>e<!-- f <p>") == ["ab", "cd", "e"]
    assert texts("<script>x<p>y</SCRIPT >z<style>p{}") == ["z"]
    assert texts('<a title="x > y">l</a><p class=\'q>t</p>u') [0] == "l"
    assert [b.path for b in blocks("<ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>4<td>5<tr><td>6</table>")] == [
        ("ul", "li"), ("ul", "li"), ("ul", "li", "ul", "li"), ("table", "tr", "td"), ("table", "tr", "td"), ("table", "tr", "td")
    ]
    (b,) = blocks('<DIV id="sideBar-left" class="Ad  box">  x <a href=1>y\n z</a> </DIV>')
    assert b.path == ("div:side,bar,left,ad,box",) and b.text == "x y z" and b.linked == 4


def test_viterbi_finds_the_best_labels():
    r = np.random.default_rng(2)
    for n in range(1, 7):
        for _ in range(20):
            scores, t = r.normal(size=n).tolist(), r.normal(size=(2, 2)).tolist()
            best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(s for s, v in zip(scores, y) if v) + sum(t[a][b] for a, b in zip(y, y[1:])))
            assert hx.viterbi(scores, t) == [bool(v) for v in best]


def test_held_out_pages():
    model, wrong, n = hx.trained(), 0, 0
    for page, labels in labelled_pages(300, seed=99):
        got = model.main(blocks(page))
        assert len(got) == len(labels)
        wrong += sum(a != b for a, b in zip(got, labels))
        n += len(got)
    assert wrong <= n * 0.005


def test_parts_that_name_themselves_otherwise():
    page = """<body><div id=top-nav><a href=/>Home</a> <a href=/b>Blog</a></div><div class="cookie-banner">This site uses cookies. By staying you accept that.</div>
    <div class=post><h1>Rivers in spring</h1><p>The water rises, as it does every year. It carries sand.<p>Short.
    <div class=advert>Buy boats now. They are cheap, and they float.</div><p>And then, in May, it falls again &amp; stays low.</p></div>
    <div id="comments"><h3>2 comments</h3><p>I was there, and it was lovely. Thanks for this.</p></div><footer>© Someone</footer>"""
    want = ["Rivers in spring", "The water rises, as it does every year. It carries sand.", "Short.", "And then, in May, it falls again & stays low."]
    assert hx.trained().text(page) == "\n\n".join(want)


def plain_article(page):
    article = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1]
    parts = (" ".join(html.unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article))
    return "\n\n".join(p for p in parts if p)


def test_query_returns_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    out = QUERIES["op13_html_text"](spark, SMALL)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = plain_article(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_odd_rows(spark):
    prepare(spark)
    long = "<article>" + "<p>One more sentence, as long as the others.</p>" * 20_000 + "</article><nav>" + "<div>" * 5000
    given = [(None, None, "<article><p>Hello there, world.</p></article>"), (1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>Home</a></nav>"), (4, "u", long)]
    given += [(5, "𝄞", "<article><p>A 𝄞 sounds, clear and loud.</p></article>")] * 2
    pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("position", F.lit(1)).repartition(3)
    got = sorted(((r.page_id, r.url, r.text) for r in hx.extract_text(pages).collect()), key=repr)
    want = ["Hello there, world.", "", "", "", "\n\n".join(["One more sentence, as long as the others."] * 20_000), *["A 𝄞 sounds, clear and loud."] * 2]
    assert got == sorted(((p, u, t) for (p, u, _), t in zip(given, want)), key=repr)
    assert hx.extract_text(pages.limit(0)).count() == 0
    found = hx.extract_blocks(pages.filter("page_id = 3 OR page_id = 5")).collect()
    assert {(r.page_id, r.position, r.path, r.main) for r in found} == {(3, 0, "nav", False), (5, 0, "article/p", True)}


@pytest.mark.parametrize("rows", [[], [("<p>x</p>", [True])]])
def test_learning_from_little(rows):
    assert hx.fit(rows).main([]) == []
