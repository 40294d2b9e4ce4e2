import html
import math
import re
import time
from collections import Counter, defaultdict

import pandas as pd
import pytest

from docintake.llm.common import text_of
from docintake.llm.html_blocks import Parser
from docintake.llm.site_tree import (
    BESIDE,
    CONTENT,
    LEAST,
    PAGES,
    PRESENTATION,
    counted,
    extracted,
    host_of,
    importances,
    main_text,
    node_rows,
    parsed,
    template_nodes,
)

KIND = "page_id long, url string, html string, host string, path string, text string"


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h, "h", "p", "t") for i, u, h in pages], KIND)


def texts(spark, pages):
    return {r.page_id: r.text for r in extracted(rows(spark, pages)).collect()}


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extracted(pages).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1].replace("<br>", " ")
        parts = (re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


PAGE = """<!DOCTYPE html><html><head><title>No &lt;title</title><style>p>a{}</style>
<script>if (a < b && c > d) { x = "<p>no</p>"; }</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
<div id="cookie-notice">We use cookies</div><aside>Links</aside><!-- <p>hidden</p> -->
<main><article data-x="a > b"><header><h1>Head &amp; line</h1><p>by someone</p></header>
<p>First   <b>bold</b>&nbsp;text<br>next
<p>Caf&eacute; &#8212; &#x41;<i>b</i>c <a href='x'>link</a>.
<ul><li>one<li>two</ul><blockquote>quote</blockquote><table><tr><td>c1<td>c2</table>
<form><input value="q"><button>Send</button></form><div class="share social">Share me</div>
<img alt="x"><p>Last <span>one</span></p></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></main>
<div class="advert">Buy</div><footer>&copy; all</footer></body></html>"""


def test_structure(spark):
    got = texts(spark, [(1, "http://a.example/x", PAGE)])[1]
    assert got.split("\n") == ["Head & line", "First bold text next", "Café — Abc link.", "one", "two", "quote", "c1", "c2", "Last one"]


def test_broken_markup():
    def blocks(text):
        return [b.text for b in Parser().read(text).blocks]

    assert blocks("a < b and c > d") == ["a < b and c > d"]
    assert blocks("<p>one<p>two</p></p></div>three") == ["one", "two", "three"]
    assert blocks('<p class="a>one</p><p>two</p>')[-1] == "two"
    assert blocks("<script>never closed <p>x</p>") == []
    assert blocks("<!-- never closed <p>x</p>") == []
    assert blocks("<div><b>x<p>y</b>z</p></div>") == ["x", "yz"]
    assert blocks("<" * 50_000 + "p>") and blocks("<p " * 20_000) is not None
    assert blocks("İ<SCRIPT>x</Script>y") == ["İ", "y"] or blocks("İ<SCRIPT>x</Script>y") == ["İy"]
    assert blocks("") == [] and blocks("<p>" * 30_000 + "deep")[-1] == "deep"


def test_template_of_a_site_without_articles(spark):
    pages = [
        (i, f"http://Site.example/{i}", f"<body><div class=top>Welcome to us</div><div class=text><p>Story {i} of {i * 7}</p></div><div class=more>Write to us</div></body>")
        for i in range(12)
    ]
    other = [(100, "http://other.example/", "<body><div class=top>Welcome to us</div></body>")]
    got = texts(spark, pages + other)
    assert all(got[i] == f"Story {i} of {i * 7}" for i in range(12))
    assert got[100] == "Welcome to us"


def test_boxes_and_repeated_paragraphs_of_articles(spark):
    pages = [
        (i, "http://s.example/", f"<article><p>Story {i}</p><p>Said on every page</p><div class=kicker>Read our paper</div></article>") for i in range(8)
    ]
    got = texts(spark, pages)
    assert set(got.values()) == {f"Story {i}\nSaid on every page" for i in range(8)}


def test_copies_of_one_page_stay(spark):
    got = texts(spark, [(i, "http://s.example/", "<body><p>All the same</p></body>") for i in range(9)])
    assert set(got.values()) == {"All the same"}


def test_hard_rows(spark):
    pages = [(1, None, None), (2, "no address", ""), (2, "no address", ""), (None, "http://x/", "<p>a</p>"), (3, "http://x/", "<p>" + "word " * 200_000)]
    got = extracted(rows(spark, pages)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 0), ("3", 999_999), ("None", 1)]
    assert extracted(rows(spark, [])).collect() == []


def alone(body):
    """The text of the one page of a host, without a session."""
    return main_text(pd.Series([f"<html><body>{body}</body></html>"]), pd.Series([None]))[0]


def test_names_of_wrappers_and_of_text_in_articles():
    story = "<article><h1>Head</h1><p>Story</p></article>"
    for wrapper in ('class="content-sidebar-wrap"', 'id="page" class="no-sidebar"', 'class="sidebar"', 'id="main-nav-wrap"'):
        assert alone(f"<div {wrapper}>{story}</div>") == "Head\nStory"
        assert alone(f"<div {wrapper}><main><p>Story</p></main></div>") == "Story"
    inside = '<h2 id="related-work">Related</h2><section id="social-effects"><p>Effects</p></section><p class="notice">Mind this</p>'
    assert alone(f"<article><p>Story</p>{inside}</article>") == "Story\nRelated\nEffects\nMind this"
    assert alone(f'<div class="post"><p>Story</p>{inside}</div>') == "Story\nRelated\nEffects"
    assert alone('<article class="post category-promo"><p>Story</p></article>') == "Story"
    assert alone(f'{story}<div class="comments"><article><p>Nice</p></article></div><div id="cookie-notice">Cookies</div>') == "Head\nStory"
    assert alone(f'<div class="sidebar"><p>Lead</p><div class="widget">Links</div>{story}</div>').endswith("Head\nStory")


def article(n):
    lines = "".join(f"<p>Line {k} of story {n} is told here</p><ul><li>Point {k} of story {n}</ul>" for k in range(3))
    text = "\n".join(f"Line {k} of story {n} is told here\nPoint {k} of story {n}" for k in range(3))
    return f"<article><h1>Story {n}</h1><div class=entry-content>{lines}</div></article>", f"Story {n}\n{text}"


def test_copies_of_articles_are_no_template(spark):
    # 80 of 100 pages; 5 articles of 20 copies each; 4 equal pages on a small host; a box beside them that changes
    numbers = {"a": [max(0, i - 79) for i in range(100)], "b": [i % 5 for i in range(100)], "c": [0] * 4}
    pages = [(f"{host}{i}", f"http://{host}.example/", f"<body>{article(n)[0]}<div class=now>Now {i}</div></body>") for host, all in numbers.items() for i, n in enumerate(all)]
    frame = spark.createDataFrame(pages, "page_id string, url string, html string")
    got = {r.page_id: r.text for r in extracted(frame).collect()}
    for host, all in numbers.items():
        for i, n in enumerate(all):
            assert got[f"{host}{i}"].startswith(article(n)[1])


def test_box_on_few_pages_of_a_large_host(spark):
    box = "<div class=more>Written by our own correspondents</div>"
    got = texts(spark, [(i, "http://s.example/", f"<article><p>Story {i}</p>{box if i < 5 else ''}</article>") for i in range(800)])
    assert got == {i: f"Story {i}" for i in range(800)}


def test_the_tree_decides_inside_and_beside_articles(spark):
    pages = [
        (
            i,
            "http://s.example/",
            f"<div class=story><h2>Story {i}</h2><p>What was told of story {i} that day</p></div>"
            f"<article class=card><p>{['A teaser', 'A second one'][i % 2]}</p></article><div class=site-info>Of the site</div>",
        )
        for i in range(12)
    ]
    got = texts(spark, pages)
    assert got == {i: f"Story {i}\nWhat was told of story {i} that day" for i in range(12)}
    pages = [(i, "http://s.example/", f"<article><p>Story {i} of this site</p><ul><li>Read our paper</ul></article>") for i in range(8)]
    assert texts(spark, pages) == {i: f"Story {i} of this site" for i in range(8)}
    assert alone("<div class=story><p>The whole story</p></div><article class=card><p>A teaser</p></article>") == "The whole story\nA teaser"


def test_near_copies_of_an_article_stay(spark):
    def lines(i):
        return [f"Seen {i}" if i < 95 else f"Other {i}"] + [f"Line {k} of story {0 if i < 95 else i} is told here" for k in range(5)]

    pages = [(i, "http://s.example/", f"<article><div class=entry>{''.join(f'<p>{x}</p>' for x in lines(i))}</div></article>") for i in range(100)]
    assert texts(spark, pages) == {i: "\n".join(lines(i)) for i in range(100)}


STORY = "<p>Story</p>"


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ('<form id="aspnetForm"><div><article><h1>T</h1><p>Body</p></article></div></form>', "T\nBody"),
        ('<form id="aspnetForm"><nav>n</nav><div><h1>T</h1><p>Body</p></div><footer>f</footer></form>', "T\nBody"),
        ("<nav><main><p>Story</p></main></nav>", "Story"),
        ("<div>Text here <label>L<p>next</p></div>", "Text here\nnext"),
        ("<div><label><p>No</p></label><p>yes</p></div>", "yes"),
        ("<div><button><div>Icon</div></button>text</div>", "text"),
        ("<p>Long paragraph text <button>OK</p><p>next</p>", "Long paragraph text\nnext"),
        ("<p>a <span hidden>secret</span> b</p>", "a b"),
        ('<p>a <i aria-hidden="true">x</i>b</p><p>c <audio>fallback</audio>d<button>OK</button></p>', "a b\nc d"),
        (f'<article>{STORY}<section id="comments"><p>Nice post!</p></section></article>', "Story"),
        (f'<article>{STORY}<div class="comments-area"><h2>3 Comments</h2><p>Nice!</p></div><ol class="comment-list"><li>x</ol></article>', "Story"),
        (f'<article>{STORY}<section id="comments-on-the-theory"><h2>Comments on the theory</h2></section></article>', "Story\nComments on the theory"),
        (f'<div class="cookie-banner">C</div><div class="nav-menu">N</div><div class="site-nav">S</div><div class="ad-banner">A</div>{STORY}', "Story"),
        ('<div class="content-with-sidebar"><p>Story</p></div><div class="right-sidebar"><p>More</p></div>', "Story\nMore"),
        ('<article><header><h1>T</h1><p class="standfirst">Lead</p><time>3 May</time></header><p>x</p></article>', "T\nLead\nx"),
        ("<main><header><p>Intro</p></header><p>x</p></main>", "Intro\nx"),
        (f"<aside><article>Teaser</article></aside>{STORY}", "Story"),
    ],
)
def test_no_text_lost_and_no_remark_kept(markup, want):
    assert alone(markup) == want


@pytest.mark.parametrize(
    "markup",
    [
        "<div>x" * 40_000,
        "<p>" + "</b>x" * 80_000,
        "<font>x" * 80_000,
        "<ul>" + "<div>" * 20_000 + "<li>x" * 40_000,
        '<div class="ad">x' * 20_000,
        "<p><label>x<div>" * 20_000,
        "<div>" * 30_000 + "x</i>" * 30_000,
    ],
)
def test_time_does_not_grow_with_depth(markup):
    began = time.process_time()
    Parser().read(markup)
    assert time.process_time() - began < 10  # minutes if every step searched the open elements


def by_hand(pages):
    """Importances of one host's merged nodes from their definition, over page texts."""
    read = [Parser().read(p) for p in pages]
    rows = {tuple(node_rows(p)): p for p in read}  # pages of equal content count once here
    held, texts, parents = defaultdict(Counter), defaultdict(Counter), {}
    for found in rows:
        for path, parent, kind, value in found:
            (held if kind == PRESENTATION else texts)[path][value] += 1
            parents[path] = max(parent, parents.get(path, parent))
    out = {}
    for path, shapes in held.items():
        m = sum(shapes.values())
        if m == 1:
            presentation = content = 1.0
        else:
            presentation = -sum(c / m * math.log(c / m, m) for c in shapes.values())
            each = [math.log(c, m) for c in texts[path].values() for _ in range(c)]
            content = 1 - sum(each) / len(each) if each else 1.0
        out[path] = (parents[path], m, presentation, content, bool(texts[path]))
    return out


def test_importances_against_their_definition(spark):
    kinds = ["<ul><li>Home<li>About</ul>", "<ul><li>Home<li>News<li>Shop</ul>", "<p>Welcome</p>"]
    pages = [
        f"<body><div class=top>{kinds[i % 3]}</div><div class=text><h2>Story {i}</h2>{'<p>And more of it</p>' * (i % 4 > 1)}<p>Told {i * 7}</p></div>"
        f"<div class=end>Written in {['May', 'June'][i % 2]}</div></body>"
        for i in range(17)
    ]
    frame = spark.createDataFrame([(str(i), "http://s.example/", p) for i, p in enumerate(pages)], "key string, url string, html string")
    merged = importances(counted(parsed(frame.withColumn("host", host_of()).withColumn("html", text_of("html"))))).cache()
    want = by_hand(pages)
    got = {r.path: r for r in merged.collect()}
    assert got.keys() == want.keys() and len(want) > 6
    for path, (parent, m, presentation, content, leaf) in want.items():
        r = got[path]
        assert (r.parent, r.pages, r.leaf) == (parent, m, leaf)
        assert (r.presentation, r.content) == (pytest.approx(presentation, abs=1e-9), pytest.approx(content, abs=1e-9))

    def weight(path):
        parent, m, _, content, leaf = want[path]
        return CONTENT * content + (1 - CONTENT) * (want[parent][2] if parent in want else 1.0)

    low = {p: weight(p) < LEAST for p, x in want.items() if x[4] and x[1] >= PAGES and weight(p) < BESIDE}
    assert {r.path: r.sure for r in template_nodes(merged).collect()} == low and low
