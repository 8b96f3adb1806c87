import itertools
import random
import time

import numpy as np
import pytest

from kelpie.llm import html_text as h


@pytest.fixture(scope="module")
def model():
    return h.default_field()


def test_held_out_pages(model):
    wrong = total = 0
    for k in range(5000, 5200):
        blocks = h.leaves(h.labelled_page(k))
        wrong += sum(y != x.label for x, y in zip(blocks, model.decode(blocks), strict=True))
        total += len(blocks)
    assert wrong < 0.05 * total


def test_viterbi_is_the_best_of_all_paths(model):
    rng = random.Random(3)
    for k in range(20):
        blocks = h.leaves(h.labelled_page(k))
        at = rng.randrange(max(1, len(blocks) - 7))
        blocks = blocks[at : at + 7]
        score = lambda path: model.start[path[0]] + sum(model.emission(x) for x, y in zip(blocks, path, strict=True) if y) + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert abs(score(best) - score(model.decode(blocks))) < 1e-9


def test_gradient_learns_labels():
    m = h.train([h.labelled_page(k) for k in range(60)], epochs=4)
    assert m.weight["of:advert"] < 0 and m.weight["in:article"] > 0
    assert np.isfinite(m.move).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies, accept?</p></div>
<article><h1>Big &amp; bold&nbsp;  news</h1><p>First   para <b>bold<br>after &copy; and &lt;tag&gt; a < b.<p>Second&#33; para, with words.
<!-- hidden <p>no</p> --><div class="ad"><p>Buy this now</p></div><ul><li>Point one<li>Point two, longer text.</ul></article>
<aside class="sidebar"><h3>More</h3><p>Other things to read here.</p></aside>
<section id="comments"><div class="comment"><p>I liked this text, thanks.</p></div></section>
<form><label>Email</label><input name=q><button>Send</button></form><footer>&copy; example</footer></body></html>"""


def test_layout(model):
    assert model.extract(PAGE) == "Big & bold news\nFirst para bold after © and <tag> a < b.\nSecond! para, with words.\nPoint one\nPoint two, longer text."


# written by hand, apart from the generator's layouts; the last ones' names tell nothing
LAYOUTS = {
    "blog": (
        """<html><body class="home blog"><header id="masthead"><h1><a href="/">My Weblog</a></h1><p>Thoughts on things</p></header>
<nav id="site-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About me</a></li></ul></nav>
<div id="primary"><main id="main"><article class="post hentry"><h2 class="entry-title">Making bread at home</h2><div class="entry-meta">By Ann, 3 May</div>
<div class="entry-content"><p>Flour, water, salt and time are all that you need for a loaf.</p><p>Mix them in the evening; bake in the <a href="/m">morning</a>, when the oven is hot.</p></div></article>
<div id="comments" class="comments-area"><h3>2 replies</h3><ol class="comment-list"><li class="comment"><p>Mine never rises, what do I do wrong?</p></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><h3>Archive</h3><ul><li><a href="/5">May</a></li><li><a href="/4">April</a></li></ul></aside>
<footer id="colophon">Proudly served. &copy; Ann</footer></body></html>""",
        ["Making bread at home", "Flour, water, salt and time are all that you need for a loaf.", "Mix them in the evening; bake in the morning, when the oven is hot."],
    ),
    "news": (
        """<body><div class="cookie-banner"><p>This site uses cookies to measure visits. Do you agree?</p><button>Yes</button></div>
<header class="site-header"><a href="/">The Daily</a></header><ul class="breadcrumbs"><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul>
<article><h1>Bridge opens after ten years</h1><p>The bridge over the river was opened on Monday, ten years after work began.</p>
<div class="ad-slot"><p>Shoes, half price, this week alone!</p></div>
<p>&ldquo;We had stopped believing in it,&rdquo; said a man who lives nearby.</p><blockquote>It cost twice as much as planned, the town says.</blockquote></article>
<div class="related"><h3>More stories</h3><ul><li><a href="/1">Tunnel closed</a></li><li><a href="/2">Ferry sold</a></li></ul></div>
<form class="newsletter"><label>Get our letter</label><input name=m><button>Subscribe</button></form><footer><p>&copy; The Daily, all rights reserved.</p></footer></body>""",
        ["Bridge opens after ten years", "The bridge over the river was opened on Monday, ten years after work began.", "“We had stopped believing in it,” said a man who lives nearby.", "It cost twice as much as planned, the town says."],
    ),
    "plain tags": (
        """<html><body><nav><a href=/>Start</a> <a href=/x>Index</a></nav><h1>On the tides</h1><p>Twice a day the sea comes in, and twice it goes out again.
<p>The moon does most of this; the sun, far heavier but farther off, does the rest.<ul><li>Spring tides come with a new or a full moon.<li>Neap tides come in between, a week later.</ul>
<footer>Last changed in June, &copy; the harbour office</footer></body></html>""",
        ["On the tides", "Twice a day the sea comes in, and twice it goes out again.", "The moon does most of this; the sun, far heavier but farther off, does the rest.", "Spring tides come with a new or a full moon.", "Neap tides come in between, a week later."],
    ),
    "untold names": (
        """<body><div class="x1"><a href="/">Home</a> | <a href="/a">Products</a> | <a href="/b">Jobs</a></div><div class="x2"><h1>How paper is made</h1>
<p>Wood is cut into chips, cooked, washed and beaten until its fibres part from one another.</p><p>What comes out, a thin grey soup, is poured on a moving sieve, pressed and dried.</p></div>
<div class="x3"><a href="/p1">Ink</a> <a href="/p2">Glue</a> <a href="/p3">Card</a></div></body>""",
        ["How paper is made", "Wood is cut into chips, cooked, washed and beaten until its fibres part from one another.", "What comes out, a thin grey soup, is poured on a moving sieve, pressed and dried."],
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_by_hand(model, name):
    page, want = LAYOUTS[name]
    assert model.extract(page).split("\n") == want


@pytest.mark.parametrize("unit", ['<a "', "<a ", '<a ">"', "<div>", "<li></ul>", "<p '", "<!--", "<!", "</ul>", "<a '\">", "<td>"])
def test_broken_pages_take_time_in_proportion(model, unit):
    def seconds(n):
        began = time.process_time()
        h.leaves(unit * n)
        h.leaves(unit * n + ">")
        return time.process_time() - began

    assert seconds(120_000) < 20 * max(0.05, seconds(30_000))


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "plain text", "</p></div>", "<script>never closed", "<p class=\"open>text</p><p>next</p>", "<!-- open", "<div>" * 3000 + "deep", "&amp &bogus; &#x110000; &#0;", "<article>" + "<p>words, and words.</p>" * 20_000])
def test_odd_pages(model, page):
    text = model.extract(page)
    assert isinstance(text, str)
    if page and len(page) > 100_000:
        assert text.count("\n") == 19_999


def test_long_references():
    long = "9" * 100_000
    got = h.decoded(f"&#{long};|&#{'0' * 6000}65;|&#{'0' * 9000};|&#x{long};|&#00000038;amp;|&#1114112;|&#12345678")
    assert got == "\ufffd|A|\ufffd|\ufffd|&amp;|\ufffd|\ufffd"
    assert [x.text for x in h.leaves(f"<p>&#{long};</p><p>a</p>")] == ["\ufffd", "a"]


def test_pages_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = h.op8_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == pages.count()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == model.extract(html[r["page_id"]]) != ""
    odd = spark.createDataFrame([(1, None, "a"), (1, "<article><p>One, two.</p></article>", "b")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in h.extract_text(odd).collect()) == ["", "One, two."]
    assert h.extract_text(odd.limit(0)).count() == 0
