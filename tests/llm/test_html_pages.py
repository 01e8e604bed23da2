"""Main text against pages and texts written by hand, against the tables' articles by another route, and time on broken pages."""

import html
import re
import time

import numpy as np
import pytest

from attestra.llm import html_extract

# Each page and the text that a reader would say it has.
WRITTEN = [
    ("<script>for(i=0;i<n;i++){x()}</script><article><p>Main text here</p></article>", "Main text here"),
    ("<script><!-- x </script><article><p>Main text, as before.</p></article>", "Main text, as before."),
    ('<article><p title="5" tall">Main text here</article>', "Main text here"),
    ("Hello plain <b>text</b>", "Hello plain text"),
    ("<p>a <b and more text. x</p><p>And then, a second one.</p>", "a <b and more text. x\nAnd then, a second one."),
    ("<html><head><title>T</title><body><article><h1>One title</h1><p>Text after a head that nothing closes.</article>", "One title\nText after a head that nothing closes."),
    ("<article><p>Fish &amp; chips&nbsp;cost &pound;5 &#8212; or &#x20AC;6.</p></article>", "Fish & chips cost £5 — or €6."),
    ("<article><p>A number that is none: &#" + "9" * 5000 + "; stays one sign.</p></article>", "A number that is none: � stays one sign."),
    (
        "<!doctype html><html><head><style>nav{color:red}</style></head><body><div id='page'><header class='site-header'><a href='/'>The Daily</a></header>"
        "<nav class='menu'><ul><li><a href='/a'>World</a><li><a href='/b'>Sport</a></ul></nav><main><article class='post'><h1>Rain again</h1><p>It rained in the north, and the rivers rose.</p>"
        "<aside class='ad'><p>Buy an umbrella now, half price.</p></aside><p>By evening the water fell.</p><ul><li>Two roads closed.</li><li>One bridge, too.</li></ul></article>"
        "<section id='comments'><h3>Comments</h3><p>I saw it, too. Terrible weather.</p></section></main><footer>&copy; The Daily</footer></div></body></html>",
        "Rain again\nIt rained in the north, and the rivers rose.\nBy evening the water fell.\nTwo roads closed.\nOne bridge, too.",
    ),
    (
        "<body><div class='navbar'><ul><li><a href=/>Home</a><li><a href=/x>About</a></ul></div><div class='content'><h2>How to boil an egg</h2><p>Take a pot, and fill it with water.</p>"
        "<blockquote>An egg is a small thing, said the cook.</blockquote><p>Wait for <em>eight</em> minutes.</p></div><div class='sidebar'><h3>Popular</h3><ul><li><a href=/1>Toast</a><li><a href=/2>Jam</a></ul></div>"
        "<div class='footer'><p>All rights reserved.</p></div>",
        "How to boil an egg\nTake a pot, and fill it with water.\nAn egg is a small thing, said the cook.\nWait for eight minutes.",
    ),
    (
        "<body><nav><ul><li><a href=/>Start</a></li></ul></nav><div class='cookie-notice'><p>We use cookies, as all do.</p></div><article><h1>Über Brücken</h1><p><b>Die Brücke ist alt,<br><p>und sie hält noch.</p></article>"
        "<form action=/s><label>Mail</label><input name=m><p>Subscribe to our letter.</p></form><footer>Impressum</footer></body>",
        "Über Brücken\nDie Brücke ist alt,\nund sie hält noch.",
    ),
    (None, ""),
    ("", ""),
    ("<article></article>", ""),
    ("<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/b>News</a></li></ul></nav><footer>&copy; me</footer>", ""),
]


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit_extractor(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def text_of(page, model):
    nodes, pieces = html_extract.parse(page)
    return html_extract.main_text(nodes, pieces, html_extract.decode(nodes, model.probability(html_extract.features(nodes, pieces))))


@pytest.mark.parametrize("number", range(len(WRITTEN)))
def test_pages_written_by_hand(model, number):
    page, want = WRITTEN[number]
    assert text_of(page, model) == want


def test_articles_of_the_table(spark, model):
    """The table's articles hold headings, paragraphs and breaks only, so that a few replacements give their text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.extract(pages, model).collect()}
    rows = pages.collect()
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r["html"] or "", re.DOTALL)
        blocks = re.split(r"</?(?:p|h1)>", body[1].replace("<br>", " ")) if body else []
        assert not re.search(r"<(?!/?(?:b|p|h1)>)[a-z/]", "".join(blocks)) or pytest.fail("another element in an article")
        want = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks]
        assert got[r["page_id"], r["url"]] == "\n".join(b for b in want if b), r["page_id"]
    assert len(got) == len(rows)


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<li>", '<p title="', "<ul><li>", "</p", "<!--", "<script>", "< ", "<table><tr><td>x", "&#99999999", "="])
def test_time_is_linear_in_broken_pages(unit):
    def seconds(size):
        began = time.process_time()
        nodes, pieces = html_extract.parse(unit * (size // len(unit)))
        html_extract.main_text(nodes, pieces, html_extract.decode(nodes, np.full(len(nodes), 0.6)))
        html_extract.features(nodes, pieces)
        return time.process_time() - began

    assert seconds(1_000_000) < 8 * max(seconds(250_000), 0.05)
