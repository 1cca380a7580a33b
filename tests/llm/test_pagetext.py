"""Blocks of pages, the network's gradient, and extraction against known texts."""

import os
from html.parser import HTMLParser

import numpy as np
import pytest

from seasonloom.llm import pagetext, queries

SF = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.01"

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav class="menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<!-- x <p>hidden</p> --><div class='cookie-notice'>We use cookies</div>
<article><h2>Head &amp; tail</h2><p>First <b>bold</b>
 text<br>line<p>Second &lt;p&gt; text<div id=comments><p>A reader says</p></div></article>
<form><input name=q><button>Go</button></form><footer>&copy; us</footer><p"""


def test_blocks_follow_the_markup():
    found = pagetext.blocks(PAGE)
    assert [b.text for b in found] == [
        "T", "Site", "One", "Two", "We use cookies", "Head & tail", "First bold text line", "Second <p> text", "A reader says", "Go", "© us",
    ]
    labels = pagetext.landmark_labels(found)
    assert [b.text for b, own in zip(found, labels, strict=True) if own] == ["Head & tail", "First bold text line", "Second <p> text"]
    assert found[2].linked == 3 and found[6].linked == 0


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- never closed <p>x</p>", "<script>x", "</p></div>", "<p></p>", "&amp", "<a b='", "<p a=\"x>y\">"])
def test_broken_pages_do_not_fail(page):
    assert all(b.text for b in pagetext.blocks(page))


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<article><p>Area is <math>x=2</math> here", ["Area is x=2 here"]),
        ("<p>a<object>fallback</object> b<noscript>c</noscript><video>d</video></p>", ["afallback bcd"]),
        ("<p>one<noscript><p>two<p>three", ["one", "two", "three"]),
        ("<p>one<svg><p>two", ["one", "two"]),
        ("<a title=it's>Hello</a> world<p>He didn't go<p>\"Quoted\" end", ["Hello world", "He didn't go", '"Quoted" end']),
        ("<a title='a>b' href=\"c>d\">in</a> out", ["in out"]),
        ("<p a = 'x>y'>one</p><p a=\">two", ["one", "two"]),
        ("<p>one<style>p{}<p>two", ["one"]),
        ("<p>one<SCRIPT>x</p></Script >two", ["one two"]),
        ("<p/>one<br/>two", ["one two"]),
    ],
)
def test_content_and_attributes(page, texts):
    assert [b.text for b in pagetext.blocks(page)] == texts


def test_deep_pages_cost_their_length():
    import time

    took = []
    for n in (40_000, 400_000):
        page = "<li><font class=x>word " * n
        started = time.perf_counter()
        found = pagetext.blocks(page)
        took.append(time.perf_counter() - started)
        assert len(found) == n and found[-1].inside.depth == 2 * n
    # Ten times the page; far from a hundred times the time.
    assert took[1] < 30 * took[0] + 1


class _Article(HTMLParser):
    """The planted article of a fixture page: what lies in <article>, by the standard parser.

    Every page of the fixture has one article, and nothing but the article in it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("article", "h1", "p"):
            self.parts.append("")
        if tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.parts.append("")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts[-1] += data


def test_query_finds_the_planted_article(spark):
    pages = {r.page_id: r.html for r in queries.table(spark, SF, "pages").collect()}
    wrong = []
    for r in queries.op7_page_text(spark, SF).collect():
        parser = _Article()
        parser.feed(pages[r.page_id])
        lines = [" ".join(p.split()) for p in parser.parts]
        if r.text != "\n".join(x for x in lines if x):
            wrong.append(r.page_id)
    assert len(wrong) <= 0.01 * len(pages)


def test_sample_is_bounded_in_pages_and_blocks(spark, monkeypatch):
    rows = [(1, "<article>" + "<p>words here</p>" * 5000)] + [(2, "<article><p>copy</p></article>")] * 40 + [(k, f"<p>{k}</p>") for k in range(3, 40)]
    seen = []
    monkeypatch.setattr(pagetext, "fit", lambda pages: seen.extend(pages))
    pagetext.train(spark.createDataFrame(rows, "page_id int, html string"), 39, 5)
    assert len(seen) == 39 and max(len(y) for _, y in seen) <= 5 * pagetext.WINDOW
    assert all(len(x) == len(y) for x, y in seen)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    bounds, size = np.array([0, 3, 3, 4, 9]), 4
    x = rng.normal(size=(9, pagetext.WIDTH))
    w = {"wl": rng.normal(size=(pagetext.WIDTH, 16)) * 0.1, "ul": rng.normal(size=(4, 16)), "bl": rng.normal(size=16)}
    w |= {k[0] + "r": v for k, v in w.items()}
    goal = rng.normal(size=(9, size))
    cells = pagetext.Cells(bounds)
    for side in "lr":
        kept = []
        pagetext._pass(x, cells, w, side, kept)
        grads = pagetext._back(x, goal, w, side, kept)
        for name in (f"w{side}", f"u{side}", f"b{side}"):
            spot = np.unravel_index(7, w[name].shape)
            values = []
            for move in (1e-5, -1e-5):
                near = {k: v.copy() for k, v in w.items()}
                near[name][spot] += move
                values.append((pagetext._pass(x, cells, near, side, None) * goal).sum())
            assert grads[name][spot] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-4, abs=1e-7)


def expected(page):
    return "\n".join(b.text for b, own in zip(pagetext.blocks(page), pagetext.landmark_labels(pagetext.blocks(page)), strict=True) if own)


def test_query_matches_the_landmarks_of_all_pages(spark):
    pages = {r.page_id: r for r in queries.table(spark, SF, "pages").collect()}
    out = queries.op7_page_text(spark, SF).collect()
    assert len(out) == len(pages)
    right = [r.text == expected(pages[r.page_id].html) for r in out]
    assert np.mean(right) > 0.99
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in out)


def test_edge_rows(spark):
    pages = queries.table(spark, SF, "pages")
    model = pagetext.train(pages, 100)
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (None, PAGE, 0), (3, "<article>" + "<p>Some words of the story here.</p>" * 20_000, 0)]
    docs = spark.createDataFrame(rows, "page_id long, html string, text int")
    out = pagetext.extract(docs, model).collect()
    assert [r.text for r in out[:3]] == ["", "", ""] and len(out) == 5
    assert pagetext.extract(docs.limit(0), model).count() == 0
    assert pagetext.train(docs.limit(0)).main(np.zeros((0, pagetext.WIDTH)), np.array([0, 0])).tolist() == []
