"""Anchors and what encloses them, and rules by source, on pages written by hand."""

import random
from html.parser import HTMLParser

from attestra.operators import listings as L


class Walk(HTMLParser):
    """The anchors of a page with the innermost open box, by a stack."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.found, self.open = [], [], None
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = [dict(attrs).get("href", ""), "", self.stack[-1] if self.stack else None]
            self.found.append(self.open)
        elif tag in ("li", "tr", "article"):
            self.stack.append([tag, ""])
            for box in self.stack:
                box[1] += " "

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None
        elif tag in ("li", "tr", "article") and self.stack:
            self.stack.pop()
            for box in self.stack:
                box[1] += " "

    def handle_data(self, data):
        for box in self.stack:
            box[1] += data
        if self.open:
            self.open[1] += data


def test_nested_boxes_against_a_stack(spark):
    rng = random.Random(3)

    def boxes(depth):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["li", "tr", "article", "a", "text", "div"])
            if kind == "a":
                out += f'<a href="/{rng.randrange(99)}">t{rng.randrange(99)} <b>x</b></a>'
            elif kind == "text" or depth == 0:
                out += f" w{rng.randrange(99)} "
            else:
                out += f"<{kind} class=c>{boxes(depth - 1)}</{kind}>"
        return out

    pages = [(k, boxes(5)) for k in range(80)]
    clean = lambda t: " ".join(t.split())
    want = []
    for k, html in pages:
        want += [(k, h, clean(t), b[0] if b else None, clean(b[1]) if b else None) for h, t, b in Walk(html).found]
    got = L.enclosed_anchors(spark.createDataFrame(pages, "page_id long, html string").repartition(3)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["page_id"], r["href"], r["link_text"], r["container"], r["context"])) for r in got)
    assert len(want) > 80 and any(w[3] is None for w in want)


def test_unseen_parts_unclosed_boxes_and_empty_pages(spark):
    html = '<script>"<li>"</script><!-- <a href=c>c</a> --><LI>one <A HREF=u>two<img alt="pic" src="p"></A> three'
    rows = [(1, html), (2, None), (3, ""), (4, "no anchors <li>x</li>")]
    got = [tuple(r) for r in L.enclosed_anchors(spark.createDataFrame(rows, "page_id long, html string")).drop("at").collect()]
    assert got == [(1, "u", "two pic", "li", "one two pic three")]


def test_rules_by_source(spark):
    rules = spark.createDataFrame([("a", "recruit|vacanc", "result|admit", "tender", None, None), ("b", "post", None, None, "special", "other region")], L.RULE)
    rows = [("a", "For recruitment of clerks", "u1"), ("a", "Recruitment result", "u2"), ("a", "Vacancy", "u/tender"), ("a", "vacancies", "u4"), ("b", "post special", "u5"), ("b", "post", "u6"), ("b", "special post of other region", "u7"), ("c", "recruit post", "u8"), ("a", None, "u9")]
    got = L.accepted(spark.createDataFrame(rows, "source string, title string, href string"), rules).collect()
    assert {r["href"] for r in got} == {"u1", "u4", "u5"}
