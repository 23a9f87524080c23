"""Main text: pages with known articles, malformed markup, and the tree."""

from __future__ import annotations

import random
import re

import pytest

from deskmill.llm import htmltext

TREE = htmltext.train()

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>if (a<b) "</p>";</script></head>
<body><header><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for you and for all of us.</div>
<div id="main"><article><h1>Title   here</h1><p>First &eacute;&#233;&#x2014; <b>bold</b> and
<a href="x">a link</a>.<br>Next<p>Second paragraph &lt;b&gt; with 1 &lt; 2 &nbsp; done
<ul><li>item one</li><li>item two</li></ul><div class="ad banner">Buy now, the best there is in the world of goods.</div>
<form><label>Mail</label><input><button>Send</button></form><aside>See also other stories</aside>
<!-- a <p>comment</p> --><p>Last.</p></article>
<section class="comments"><article><p>Reader says this is a very long and quite interesting remark.</p></article></section></div>
<aside class="sidebar">Popular posts of the week and the month</aside><footer>&copy; all of us</footer></body></html>"""

TEXT = "\n".join(
    ["Title here", "First éé— bold and a link. Next", "Second paragraph <b> with 1 < 2 done", "item one", "item two", "Last."]
)


def test_page():
    assert htmltext.main_text(PAGE, TREE) == TEXT


def test_page_without_landmarks():
    body = " ".join(f"word{i}" for i in range(60))
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><h2>Heading of it</h2><p>{body}.</p><p>{body} again.</p><div>Imprint</div>"
    text = htmltext.main_text(page, TREE).split("\n")
    assert f"{body}." in text and f"{body} again." in text
    assert "Imprint" not in text and "One Two" not in text


@pytest.mark.parametrize(
    "page",
    ["", "<", "<p", "<article><p>a<", "</p></p></article>", "<!-- open", "<script>never ends", "<a href='x>y", "&#xFFFFFFF; &bogus;", "<![CDATA[x", "<article>" * 3000, "a" * 200_000],
)
def test_malformed(page):
    htmltext.main_text(page, TREE)


def test_tree_fits_its_table():
    import numpy as np

    rows = np.array([r for r, _ in htmltext.LABELLED], float)
    assert htmltext.decide(TREE, rows).tolist() == [bool(y) for _, y in htmltext.LABELLED]


def test_held_out_pages(spark, sf_dir):
    """The articles of the given pages, found by their landmark, are extracted whole."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in htmltext.with_main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(?:p|h1)>", "\0", inner.replace("<br>", " "))
        inner = re.sub(r"</?b>", "", inner)
        parts = (" ".join(html.unescape(x).split()) for x in inner.split("\0"))
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = htmltext.with_main_text(df).collect()
    assert sorted(r.n_chars for r in found) == [0, 0, len(TEXT), len(TEXT), len(TEXT)]
    assert htmltext.with_main_text(df.limit(0)).count() == 0


def test_random_bytes():
    rng = random.Random(2)
    for _ in range(300):
        htmltext.main_text("".join(rng.choice("<>/!-apdiv =\"'&;#x \n") for _ in range(rng.randrange(80))), TREE)


def article(inner):
    return htmltext.main_text(f"<main><article><p>Some words come first here.</p>{inner}</article></main>", TREE).split("\n")[1:]


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<p class="advert">Buy this</p><p>Kept</p>', ["Kept"]),
        ('<p class="advert">Buy this<p>Kept', ["Kept"]),
        ('<ul><li class="share">Share<li>Kept</ul>', ["Kept"]),
        ('<ul><li class="share"><ul><li>In</li></ul>Out</li><li>Kept</li></ul>', ["Kept"]),
        ('<ul><li><span class="ad">Buy<li>Kept</ul>', ["Kept"]),
        ('<p>One <span class="ad">Buy <span>more</span> now</span> two</p>', ["One two"]),
        ('<p>One <span class="ad">Buy</p><p>two</p>', ["One", "two"]),
        ('<p>One <a class="promo-link" href="x">Buy</a> two <a href="y">three</a></p>', ["One two three"]),
        ("<p><b don't>bold</b> text</p>", ["bold text"]),
        ("<p><b x='>bold</b> text</p>", ["bold text"]),
        ('<p title="a > b">x</p>', ["x"]),
        ("<p>a<![CDATA[b</p><p>c</p>", ["ab", "c"]),
        ("<p>a<![CDATA[1 < 2]]>b</p>", ["a1 < 2b"]),
        ("<p>a<!-->b<!---->c<!-- <p>d</p> --!>e</p>", ["abce"]),
        ('<h2 id="search">Search</h2><h2 class="entry-header">Head</h2><p id="notice">Text</p>', ["Search", "Head", "Text"]),
        ("<table><tr><td class='ad'>x<td>y<tr><td>z</table>", ["y", "z"]),
        ("<h2 class='advert'>Buy</h3><p>Kept</p>", ["Kept"]),
    ],
)
def test_fragments(inner, want):
    assert article(inner) == want


@pytest.mark.parametrize(
    "piece",
    ["<b x='", "<b x=", '<b x="', "<b ", "<", "</b", "<![CDATA[", "<!-", "<!--", "<div>", "</section>", "<div></td>", "<ul><li><div></li>", "<span class=ad><h1></h1>", "<p class=ad>", "<b x= ", "<a/", "&", "<script"],
)
def test_long_broken_markup(piece):
    """Two megabytes of each end in time that grows with the length alone."""
    import time

    began = time.process_time()
    htmltext.main_text("<article><p>text " + piece * (2_000_000 // len(piece)), TREE)
    assert time.process_time() - began < 15
