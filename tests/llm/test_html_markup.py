"""Ordinary markup from which no article may be lost."""

import pytest

from attestra.llm import html_extract

ARTICLE = "".join(f"<p>Paragraph {i} of the article, with some words, and more of them. It goes on for a while, and ends here.</p>" for i in range(4))
TEXT = "\n".join(f"Paragraph {i} of the article, with some words, and more of them. It goes on for a while, and ends here." for i in range(4))
LOOSE = "This page has no paragraphs, only text. It says what it has to say, in some words, and then it ends. " * 3
PAGES = {
    "comparison in a script": (f"<html><head><script>for(var i=0;i<n;i++){{f(i)}}</script></head><body><article>{ARTICLE}</article></body></html>", TEXT),
    "comment that a script leaves open": (f"<html><head><script>x='<!--'</SCRIPT ></head><body><article>{ARTICLE}</article></body></html>", TEXT),
    "quote that a script leaves open": (f"<html><body><script>if(a<b)s=\"it's\"</script><article>{ARTICLE}</article></body></html>", TEXT),
    "button without an end": (f"<html><head></head><body><article>{ARTICLE}<button>Go</article></body></html>", None),
    "no </head>": (f"<html><head><title>t</title><meta charset=utf-8><body><article>{ARTICLE}</article></body></html>", TEXT),
    "no </head>, no <body>": (f"<head><title>t</title><link href=x><article>{ARTICLE}</article>", TEXT),
    "text after an open head": (f"<head><title>t</title>{LOOSE}", LOOSE.strip()),
    "no block": (LOOSE, LOOSE.strip()),
    "inline only": (f"<b>{LOOSE}</b>", LOOSE.strip()),
    "after </body>": (f"<html><head></head><body></body><article>{ARTICLE}</article></html>", TEXT),
}


@pytest.fixture(scope="module")
def texts(spark):
    fitted = html_extract.fit_extractor(spark.createDataFrame([(i, f"u{i}", f"<p>Sentence number {i}, with some words. And more of them, and so on.</p>") for i in range(60)], "page_id long, url string, html string"))
    pages = spark.createDataFrame([(name, None, html) for name, (html, _) in PAGES.items()], "page_id string, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(pages, fitted).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_article_is_whole(texts, name):
    want = PAGES[name][1]
    assert texts[name] == want if want else texts[name].startswith(TEXT)
