from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.llm import pages

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies, which is a long notice about cookies and consent.</div>
<div id="sidebar"><p>A sidebar with a fairly long paragraph of text that isn't the article at all.</p></div>
<article><header><h2>Title &amp; more</h2></header><p>First   paragraph,
with <b>bold</b> and <a href="x">a link</a> of words that go on for a while.</p>
<div class="ad">Buy this now</div><p>Short.</p><ul><li>One<li>Two</ul><form><label>Mail</label><input><p>Send</p></form>
<table><tr><td>a</td><td>b</td></tr></table><p>Second&nbsp;&eacute; &#x41;&lt;b&gt; paragraph that is again long enough to count as text.
<aside>Aside</aside><section class="comments"><p>A reader comment that is long, long, long, long and loud.</p></section></article>
<footer>&copy; site</footer></body></html>"""


def test_article_of_a_full_page():
    assert pages.main_text(FULL).split("\n") == [
        "Title & more", "First paragraph, with bold and a link of words that go on for a while.", "Short.", "One", "Two", "a", "b",
        "Second é A<b> paragraph that is again long enough to count as text.",
    ]


def test_without_article_element():
    body = "".join(f"<p>Paragraph {i} with a good number of words in it, as articles have.</p>" for i in range(5))
    html = f"<body><ul>{''.join(f'<li><a href=x>{i}</a></li>' for i in range(9))}</ul><div class=menu><p>x</p></div><div class=content><h1>Head</h1>{body}<p>End.</p></div><div class=footer>f</div></body>"
    got = pages.main_text(html).split("\n")
    assert got[0] == "Head" and got[-1] == "End." and len(got) == 7


def test_names_of_wrappers_and_comments():
    body = "<p>A paragraph with quite a few words in it, so that it is text.</p>"
    html = f'<div class="page with-sidebar"><nav>n</nav><main><article class="post">{body}<div class="share-buttons">Share</div></article><div id="comments"><article class="comment">{body * 3}</article></div></main></div>'
    assert pages.main_text(html) == "A paragraph with quite a few words in it, so that it is text."


def test_odd_pages():
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<p></p>") == pages.main_text("<nav>menu</nav>") == ""
    assert pages.main_text("just text &amp; more") == "just text & more"
    assert pages.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert pages.main_text("<article><p>a < b and c<p><b>x<br><p>y</b>") == "a < b and c\nx\ny"
    assert pages.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert len(pages.main_text("<article><p>" + "word " * 200_000 + "</article>")) == 999_999


def test_smoothing_and_threshold():
    assert np.allclose(pages.smooth(np.ones(7), 1.0), 1)
    assert 2 < pages.threshold(np.array([1.0, 1, 2, 50, 60])) < 50
    assert pages.threshold(np.array([3.0])) == 3


def test_table(spark):
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame([(1, "u", FULL), (None, None, None), (1, "u", FULL)], schema).withColumn("text", F.lit("clash"))
    got = pages.extract_pages(df).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"]) for r in got) == [(0, "", ""), (1, "u", pages.main_text(FULL)), (1, "u", pages.main_text(FULL))]
    assert pages.extract_pages(df.where("false")).count() == 0


def test_query_on_whole_pages(spark, sf):
    """Against the known form of these pages: an article element of h1 and p blocks."""
    import html as h
    import re

    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        inner = r["html"][r["html"].index("<article>") + 9 :].split("</article>")[0]
        blocks = [h.unescape(re.sub(r"<[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h\d)>", inner)]
        want[r["page_id"]] = "\n".join(" ".join(b.split()) for b in blocks if b.split())
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.op4(spark, sf).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(n == len(t) for t, n in got.values())


def test_dropped_elements_within_a_line():
    a, b = "First half of a sentence with a few words", "and the second half of it, with some more words."
    for inner in ("<script>x()</script>", "<button>Go</button>", "<svg><title>t</title><text>u</text></svg>", '<span hidden>h <i>i</i></span>', '<a class="share" href="x">s</a>', "<noscript><p>n</p></noscript>"):
        got = pages.main_text(f"<article><p>{a} {inner} {b}</p><p>Last.</p></article>").replace("\n", " ")
        assert got == f"{a} {b} Last.", inner
    assert pages.main_text('<article><h2>Headline <a class="anchor" aria-hidden="true">#</a></h2><p>Words of the text.</p></article>') == "Headline\nWords of the text."
    assert pages.main_text(f'<article><p>{a}<span hidden>x</p><p>{b}</p></article>') == f"{a}\n{b}"


@pytest.mark.parametrize("html", [
    "<div>" * 100_000 + "deep", "<p><div>" * 50_000 + "x", "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000,
    "<article>" + "<span hidden>" * 50_000 + "<p>x</p>" * 50_000, "<ul><li>" * 50_000 + "x", "<div><p>some text here</p>" * 30_000,
])
def test_time_grows_with_the_page_not_its_depth(html):
    t = time.perf_counter()
    pages.main_text(html)
    assert time.perf_counter() - t < 6


def sidebar_page(outer="{side}{content}", n=25):
    """No article element and no telling names; a sidebar with many short lines that aren't links."""
    side = "<div><ul>" + "".join(f"<li><span><b>Item</b> <i>{i}</i></span> <em>today</em></li>" for i in range(n)) + "</ul></div>"
    body = [f"Paragraph {i} has a good number of words in it, enough to be taken for the text of the page by itself." for i in range(8)]
    content = "<div><h2>Head of it</h2>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
    return "<html><body><div>" + outer.format(side=side, content=content) + "</div></body></html>", "\n".join(["Head of it", *body])


@pytest.mark.parametrize("outer", ["{side}{content}", "{content}{side}", "<div>{side}</div><div><div>{content}</div></div>"])
def test_ratios_select_the_region(outer, monkeypatch):
    html, want = sidebar_page(outer)
    assert pages.main_text(html) == want
    # With the threshold out of work, the sidebar comes along: nothing else keeps it out.
    monkeypatch.setattr(pages, "threshold", lambda x: -1.0)
    assert "Item 3" in pages.main_text(html)


def test_text_beside_the_region():
    body = [f"Paragraph {i} with a good number of words in it, as articles have." for i in range(12)]
    ps = "".join(f"<p>{x}</p>" for x in body)
    menu = "<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>"
    want = ["Head", "A lead.", *body, "The end."]
    for outer in ("<body>{}</body>", "<body><div class=post>{}</div>" + menu + "</body>"):
        got = pages.main_text(outer.format(f"{menu}<h1><a href=z>Head</a></h1><p>A lead.</p><div class=body>{ps}</div><p>The end.</p>"))
        assert got.split("\n") == want
    got = pages.main_text(f"<body><p>Site</p><main><h1>Head</h1><p>A lead.</p><article>{ps}</article>{menu}<p>The end.</p></main></body>")
    assert got.split("\n") == want
