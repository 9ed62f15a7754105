"""op13: main texts of the tables' pages and of hand-written ones, exact marginals, the tree builder, edges."""

import html
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import html_text as H
from ledgerline.llm.page_layouts import labelled_pages

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def weights(spark):
    return H.fit_content(spark.read.parquet(f"{SF}/pages.parquet"))


def blocks(page: str) -> list[str]:
    return [x for x in H.Parser().tree(page).texts if x is not None]


def plain(page: str) -> str:
    """Blocks of the one article of a page of the tables."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    found = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(b for b in found if b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pages_of_the_tables(spark, weights):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: (r["url"], plain(r["html"]), len(plain(r["html"]))) for r in pages.collect()}
    got = H.main_text(pages, weights).collect()
    assert len(got) == len(want) and {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got} == want


BLOG = """<html><body class="home"><div id="cookie-banner"><p>We use cookies to improve your visit. By going on you accept them.</p><button>OK</button></div>
<div id="header"><a href="/">My Blog</a><p>Notes on gardens and soil.</p></div><ul class="menu"><li><a href=a>Home</a></li><li><a href=b>About us</a></li><li><a href=c>Contact</a></li></ul>
<div class="container"><div class="post-content"><h1>Growing beans</h1><p>Beans like warm soil, and they like it moist. Wait until May.</p><div class="advert"><p>Buy the best seeds here today, only for a short time!</p></div>
<p>Sow them in rows &amp; water <a href=x>every day</a>, in the evening if you can. After three weeks you will see the first leaves.<h2>Harvest</h2><p>Pick them young.</p></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Thank you, this helped me a lot. My beans are growing well.</p></div><div class="comment"><p>When do I water them? I always forget.</p></div></div></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=1>Growing peas in your garden</a></li><li><a href=2>All about soil</a></li></ul></div><form class="newsletter"><p>Sign up for our weekly letter, it is free.</p><input name=m></form>
<div class="footer">&copy; 2020 My Blog. All rights reserved.</div><script>var x = "<p>no</p>";</script>"""
BLOG_TEXT = "Growing beans\nBeans like warm soil, and they like it moist. Wait until May.\nSow them in rows & water every day, in the evening if you can. After three weeks you will see the first leaves.\nHarvest\nPick them young."
NEWS = """<!doctype html><body><header><h1>The Daily</h1><nav><a href=1>World</a> <a href=2>Sport</a> <a href=3>Money</a></nav></header><div class="alert notice">Our offices are closed on Monday. Please call again on Tuesday.</div>
<main><section class="story"><h1>Bridge opens after two years</h1><p>The new bridge over the river opened on Sunday, after two years of work.</p><p>"We are glad", said the mayor, who cut the ribbon.</p><ul><li>It is 300 metres long.</li><li>It cost ten million.</li></ul></section>
<aside><p>More from this town: read our long report about the old mill.</p></aside></main><section class="reader-comments"><article><p>I have waited so long for this bridge. Great news!</p></article></section><footer><p>Contact | Imprint | Privacy</p></footer></body>"""
NEWS_TEXT = 'Bridge opens after two years\nThe new bridge over the river opened on Sunday, after two years of work.\n"We are glad", said the mayor, who cut the ribbon.\nIt is 300 metres long.\nIt cost ten million.'


@pytest.mark.parametrize(("page", "want"), [(BLOG, BLOG_TEXT), (NEWS, NEWS_TEXT)])
def test_layouts_that_no_label_shows(weights, page, want):
    assert H.model_of(weights).texts([H.Parser().tree(page)]) == [want]


def test_held_out_layouts(weights):
    """Shares of main text found and of found text that is main, by characters, on layouts the model has not seen."""
    parser = H.Parser()
    nodes = H.Nodes([parser.tree(p) for p in labelled_pages(200, seed=9)])
    main = (nodes.labels() == 1) & nodes.leaf
    got = (H.model_of(weights).marginals(nodes)[0][:, 1] >= 0.5) & nodes.leaf
    chars = np.array([len(t or "") for t in nodes.texts])
    assert (chars * (main & got)).sum() / (chars * main).sum() > 0.97 and (chars * (main & got)).sum() / (chars * got).sum() > 0.97


def test_marginals_are_exact():
    """Against sums over every assignment of states."""
    rng = np.random.default_rng(1)
    model = H.Model(*(rng.normal(size=s) for s in H.Model.size()))
    for page in ("<div><p>One two.<p>Three<ul><li>x</ul></div>", "a<div>b</div>c", "<p>x", "<div><div><div>deep</div></div></div>"):
        nodes = H.Nodes([H.Parser().tree(page)])
        own = np.zeros((nodes.n, 3))
        for i, f in zip(nodes.at, nodes.ids, strict=True):
            own[i] += model.node[f]
        own[nodes.leaf, 2] = -50.0
        want, want_both, total = np.zeros((nodes.n, 3)), np.zeros((nodes.n, 3, 3)), 0.0
        for states in itertools.product(range(3), repeat=nodes.n):
            w = np.exp(sum(own[i, s] for i, s in enumerate(states)) + sum(model.edge[nodes.kind[i], states[nodes.parent[i]], states[i]] for i in range(1, nodes.n)))
            total += w
            for i, s in enumerate(states):
                want[i, s] += w
                want_both[i, states[nodes.parent[i]], s] += w
        got, both = model.marginals(nodes)
        assert np.allclose(got, want / total) and np.allclose(both[1:], want_both[1:] / total)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p>a <b>b<br>c</b>&nbsp;d</p>", ["a b c d"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a<!-- <p>x</p> -->b<!-->c<script>'</p>'</SCRIPT >d", ["ab" + "c d"]),
        ("<p title='<b>' class=x data-y=it's>a &lt;b&gt; &#233; &copy;</p>", ["a <b> é ©"]),
        ("1 < 2 <3 </ >x", ["1 < 2 <3 x"]),
        ("</p></div>a</b><i>b<div>c</i>d</div>e", ["ab", "cd", "e"]),
        ("a<style>b", ["a"]),
        ("a<!-- b", ["a"]),
        ("a<p title=\"b", ["a"]),
        ("<textarea>x</textarea><title>t</title><noscript>n</noscript>a", ["a"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
    ],
)
def test_blocks(page, want):
    assert blocks(page) == want


def test_hostile_pages_take_linear_time():
    for page in ("<p a='" * 50_000, "<!--" * 100_000, "<div>" * 30_000 + "x", "<" * 200_000, "<script>" * 50_000, "<b>" * 50_000 + "x</p>" * 1000, "<p>x<b>" * 20_000, "&amp" * 100_000, "<a b=" * 50_000):
        tree = H.Parser().tree(page)
        assert len(H.Nodes([tree]).tags) <= 60_001


def test_edges(spark, weights):
    long = "<article>" + "<p>Words of the text, and more of them.</p>" * 5000 + "</article>"
    rows = [(1, None, "u"), (2, "", "u"), (3, "<div><br></div>", None), (None, long, "u"), (None, long, "u"), (4, "<article><h1>T</h1><p>Some words here.</p></article>", "v")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in H.main_text(df, weights).collect()), key=str)
    body = "\n".join(["Words of the text, and more of them."] * 5000)
    want = [(0, "u", body, len(body))] * 2 + [(1, "u", "", 0), (2, "u", "", 0), (3, None, "", 0), (4, "v", "T\nSome words here.", 18)]
    assert got == sorted(want, key=str)
    assert H.main_text(df.limit(0), weights).collect() == []
    assert len(H.fit_content(df.limit(0), layouts=5, rounds=2)[0]) == 8 * H.Model.size()[0][0] * 3


def test_learning_repeats(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert H.fit_content(pages, 20, 20, 5) == H.fit_content(pages.repartition(3), 20, 20, 5)
