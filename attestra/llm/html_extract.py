"""Main text of HTML pages: boosted trees over DOM nodes, decoded so that parents and children agree.

Every element that makes a block is a node with features of its subtree, attributes, depth and
siblings. The trees give the chance that a node holds main text. Of all labellings in which
nothing below a dropped node is kept, decoding takes the likeliest.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import columns_of, map_batches, table

#: Pages whose blocks lend their words to the training pages, and training pages; whatever the corpus.
SAMPLED, TRAINED = 200, 400

# Elements of HTML, and tokens that authors use in class, id and role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript textarea title svg iframe object select button".split())
_CODE, _CLOSES = ("script", "style"), {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.IGNORECASE) for t in _RAW}
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
# Elements that begin and end a block of text; all others stand within one, as a browser shows them.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_GROUPS = {"p": 0, "blockquote": 0, "pre": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "ul": 2, "ol": 2, "dl": 2, "li": 3, "dd": 3, "dt": 3, "nav": 4, "menu": 4, "header": 5, "footer": 6, "aside": 7, "form": 8, "fieldset": 8, "dialog": 8, "article": 9, "main": 10, "section": 11, "table": 12, "tr": 12, "td": 12, "th": 12, "tbody": 12, "figure": 13, "figcaption": 13, "body": 14, "html": 14}
_DIV, _N_GROUPS = 15, 16
_AGAINST = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar cookie cookies consent notice alert popup modal overlay comment comments reply replies discussion disqus respond form login signup subscribe newsletter search share sharing social related recommended recommendations tags pagination pager copyright legal complementary contentinfo".split())
_FOR = frozenset("article content post entry story main body text prose page maincontent articlebody".split())
# A tag's attributes: a quote opens a value only after "=", and "<" or the page's end breaks the tag off. Nothing is read twice.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/><]*+)((?:[^<>"'=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+|["'])*+)(>?)""")
_ATTRIBUTE = re.compile(r"""([^\s"'=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']\S*+)))?+""")
_LONG_NUMBER = re.compile(r"&#0*+[0-9]{8,}+;?")
_NAMES = ("class", "id", "role")
# What a start tag closes if it is open, unless a list or table was opened since.
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# What lies in a cell can't close what lies outside of it, but for the table's own parts.
_CELLS, _TABLE = ("td", "th", "caption"), frozenset("table tbody thead tfoot tr td th caption html".split())
_KEEPS_OPEN = ("ul", "ol", "dl", "table", "menu", "dir")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attrs: str = ""
    hidden: bool = False


class _Reader:
    """Builds block nodes and their pieces of text. Open blocks are indexed by tag, so that no step walks the stack."""

    def __init__(self, page: str):
        self.page, self.nodes, self.pieces = page, [Node("html", -1, 0)], []
        self.open: list[tuple[str, int]] = [("html", 0)]  # open blocks, with their nodes
        self.at: dict[str, list[int]] = {"html": [0]}  # places in `open` by tag
        self.text: list[str] = []
        self.linked, self.link_from, self.body = 0, 0, 0  # characters in links; how many blocks were open where the link began, 0 outside; the body's node

    def flush(self) -> None:
        if self.text:
            joined = "".join(self.text)
            if not joined.isspace():
                self.pieces.append((self.open[-1][1], joined, self.linked))
            self.text.clear()
            self.linked = 0

    def place(self, *tags: str) -> int:
        """Where the last opened block of one of these tags lies in `open`; 0 if none does."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, k: int) -> None:
        """Closes the k-th open block and all in it."""
        self.flush()
        while len(self.open) > k:
            self.at[self.open.pop()[0]].pop()
        if self.link_from > k:
            self.link_from = 0

    def begin(self, tag: str, attrs: str = "") -> None:
        self.flush()
        up = self.open[-1][1]
        self.nodes.append(Node(tag, up, self.nodes[up].depth + 1, attrs, hidden=tag == "head"))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, len(self.nodes) - 1))

    def begin_body(self, attrs: str = "") -> None:
        self.close(1)  # the head
        self.begin("body", attrs)
        self.body = len(self.nodes) - 1

    def read(self, start: int, end: int) -> None:
        if end > start:
            if not self.body and not self.page[start:end].isspace():
                self.begin_body()
            self.text.append(self.page[start:end])
            self.linked += (end - start) * (self.link_from > 0)

    def end_tag(self, tag: str) -> None:
        if tag == "a":
            self.link_from = 0
        elif tag == "body":  # what follows is still of it
            self.close(self.place("body") + 1 if self.body else 1)
        elif tag in _BLOCKS and (k := self.place(tag)) and (tag in _TABLE or k > self.place(*_CELLS)):
            self.close(k)
        elif tag == "p":
            self.flush()

    def start_tag(self, tag: str, attrs: str) -> None:
        if tag == "html" or (tag == "head" and self.body):
            return
        if tag == "body":
            if not self.body:
                self.begin_body(attrs)
            else:
                self.nodes[self.body].attrs += attrs
            return
        if not self.body and tag != "head" and tag not in _IN_HEAD:
            self.begin_body()
        if tag == "br":
            self.text.append(" ")
        elif tag == "hr":
            self.flush()
        elif tag == "a":
            self.link_from = len(self.open)
        elif tag in _BLOCKS:
            if tag in _CLOSED_BY and (k := self.place(*_CLOSED_BY[tag])) > self.place(*_KEEPS_OPEN):
                self.close(k)
            elif self.open[-1][0] == "p":
                self.close(len(self.open) - 1)
            self.begin(tag, attrs)


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """(block nodes in page order, pieces): a piece is a block's (node, raw text, characters of it inside links).

    As in browsers, text and elements that aren't of the head end it, and begin a body where no tag
    does; what follows </body> is still of it. So all text lies in a body. A "<" that begins no tag
    is text, and so is one with words but no attribute before the next "<". Scripts and the like end
    at their own end tag. The page is read once, from left to right.
    """
    r = _Reader(page or "")
    if not page:
        return r.nodes, r.pieces
    at, size = 0, len(page)
    unclosed: set[str] = set()  # raw elements without an end tag in what is left
    while (lt := page.find("<", at)) >= 0:
        r.read(at, lt)
        m, mark = _TAG.match(page, lt), page[lt + 1 : lt + 2]
        if m is None:
            if page.startswith("<!--", lt):
                at = _comment_end(page, lt + 4)
            elif mark and mark in "!?/":
                at = page.find(">", lt) + 1 or size
            else:
                r.read(lt, lt + 1)
                at = lt + 1
            continue
        tag, attrs, at = m[2].lower(), m[3], m.end()
        if not m[4] and "=" not in attrs and not attrs.isspace() and attrs:
            r.read(lt, at)
        elif m[1]:
            r.end_tag(tag)
        elif tag in _RAW and not attrs.rstrip().endswith("/"):
            if not r.body and tag not in _IN_HEAD:
                r.begin_body()
            end = None if tag in unclosed else _CLOSES[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in _CODE:
                at = size
            else:
                unclosed.add(tag)
        else:
            r.start_tag(tag, attrs)
    r.read(at, size)
    r.flush()
    return r.nodes, r.pieces


def _comment_end(page: str, at: int) -> int:
    """Where a comment ends whose text begins at `at`; one that isn't closed takes the rest of the page."""
    for short in (">", "->"):
        if page.startswith(short, at):
            return at + len(short)
    end = page.find("-->", at)
    return len(page) if end < 0 else end + 3


def unescaped(raw: str) -> str:
    """Character references decoded; a number too long for any character gives the replacement character."""
    return entities.unescape(_LONG_NUMBER.sub("\ufffd", raw) if "&#" in raw else raw)


def _signs(attrs: str) -> tuple[int, int]:
    """Tokens of class, id and role that speak against main text, and for it."""
    return _known_signs(attrs) if len(attrs) < 200 else _told_signs(attrs)


def _told_signs(attrs: str) -> tuple[int, int]:
    values = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs) if m[1].lower() in _NAMES)
    t = {t for v in values for t in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()) if t}
    return len(t & _AGAINST), len(t & _FOR)


_known_signs = lru_cache(maxsize=20_000)(_told_signs)


FEATURES = 26
_BAD_GROUPS, _GOOD_GROUPS = frozenset((4, 5, 6, 7, 8)), frozenset((9, 10))


def features(nodes: list[Node], pieces: list[tuple[int, str, int]]) -> np.ndarray:
    """One row for each node: its tag, attributes, depth, siblings, subtree and what stands above it."""
    n = len(nodes)
    parent = [max(0, x.parent) for x in nodes]
    group = [_GROUPS.get(x.tag, _DIV) for x in nodes]
    signs = [_signs(x.attrs) if x.attrs else (0, 0) for x in nodes]
    size, link, count, stops, below, children = ([0] * n for _ in range(6))
    first = [-1] * n
    total = 0
    for node, raw, in_links in pieces:
        size[node] += len(raw)
        link[node] += in_links
        count[node] += 1
        stops[node] += raw.count(".") + raw.count(",")
        if first[node] < 0:
            first[node] = total
        total += len(raw)
    own = size.copy()
    paragraphs = [int(g == 0) for g in group]
    bad = [int(s[0] > 0 or g in _BAD_GROUPS) for s, g in zip(signs, group)]
    good = [int(s[1] > 0 or g in _GOOD_GROUPS) for s, g in zip(signs, group)]
    over_bad, over_good, place = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        over_bad[i], over_good[i] = over_bad[p] + bad[p], over_good[p] + good[p]
        place[i] = children[p]
        children[p] += 1
    # Good text in the subtree, so that a container of the article isn't taken for what stands beside it.
    holds_good, holds_bad = good.copy(), bad.copy()
    for i in range(n - 1, 0, -1):  # parents come before their children
        p = parent[i]
        size[p] += size[i]
        link[p] += link[i]
        count[p] += count[i]
        stops[p] += stops[i]
        paragraphs[p] += paragraphs[i]
        below[p] += below[i] + 1
        holds_good[p] += holds_good[i]
        holds_bad[p] += holds_bad[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    x = np.array([group, [x.depth for x in nodes], size, own, link, stops, count, below, paragraphs, children, place, first, [s[0] for s in signs], [s[1] for s in signs], parent, over_bad, over_good, holds_good, holds_bad], float)
    group, depth, size, own, link, stops, count, below, paragraphs, children, place, first, against, favour, up, over_bad, over_good, holds_good, holds_bad = x
    up, whole = up.astype(int), max(total, 1)
    first = np.where(first < 0, total, first)
    some = np.maximum(size, 1)
    return np.column_stack([group, depth, np.log1p(size), np.log1p(own), link / some, stops / some, np.log1p(count), size / np.maximum(count, 1), np.log1p(below), below / some, np.log1p(paragraphs), children, place, place / np.maximum(children[up], 1), children[up], first / whole, size / whole, against, favour, group[up], against[up], favour[up], over_bad, over_good, holds_good, holds_bad])


def decode(nodes: list[Node], chance: np.ndarray) -> list[bool]:
    """Which nodes are kept: the likeliest labelling in which no kept node lies below a dropped one. The root is kept, the head never."""
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    dropped, kept = np.log(1 - p).tolist(), np.log(p).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        if nodes[i].hidden:
            kept[i] = -math.inf
        dropped[up] += dropped[i]
        kept[up] += max(kept[i], dropped[i])
    keep = [False] * len(nodes)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and kept[i] > dropped[i]
    return keep


def main_text(nodes: list[Node], pieces: list[tuple[int, str, int]], keep: list[bool]) -> str:
    blocks = (" ".join(unescaped(raw).split()) for node, raw, _ in pieces if keep[node])
    return "\n".join(b for b in blocks if b)


# Training pages: the layouts that sites use, filled with sampled blocks. Labels hold by construction.


def _page(rng: np.random.Generator, blocks: list[str]) -> str:
    """A page whose main text stands in elements marked data-main."""
    pick = lambda *x: x[rng.integers(len(x))]
    say = lambda k=1: entities.escape(" ".join(blocks[rng.integers(len(blocks))] for _ in range(k)))
    short = lambda: entities.escape(" ".join(blocks[rng.integers(len(blocks))].split()[: rng.integers(1, 9)]))
    links = lambda n: "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(n))
    maybe = lambda chance, text: text if rng.random() < chance else ""
    nav = pick(*[f"<nav><ul>{links(rng.integers(2, 12))}</ul></nav>"] * 2, f'<div class="{pick("menu", "navbar", "navigation")}"><ul>{links(rng.integers(2, 12))}</ul></div>', f'<ul id="{pick("nav", "menu")}">{links(rng.integers(2, 9))}</ul>')
    header = maybe(0.5, pick(f"<header><h1>{short()}</h1><p>{short()}</p></header>", f'<div class="{pick("header", "masthead")}"><p>{short()}</p></div>'))
    ad = maybe(0.7, pick(f'<div class="{pick("ad", "ads", "sponsored", "promo banner")}">{say()}</div>', f'<aside class="advert"><p>{say()}</p></aside>'))
    notice = maybe(0.4, pick(f'<div class="{pick("cookie", "cookie-notice", "consent", "notice")}"><p>{say()}</p></div>', f'<div role="alert">{short()}</div>'))
    side = maybe(0.5, pick(f"<aside><h3>{short()}</h3><ul>{links(4)}</ul><p>{say()}</p></aside>", f'<div class="sidebar"><p>{say()}</p><ul>{links(5)}</ul></div>'))
    comments = maybe(0.45, pick(f'<section class="comments">{"".join(f"<div class=comment><p>{say()}</p></div>" for _ in range(rng.integers(1, 6)))}</section>', f'<div id="comments"><h3>{short()}</h3>{"".join(f"<p>{say()}</p>" for _ in range(rng.integers(1, 5)))}</div>', f"<ol class=commentlist>{''.join(f'<li class=comment><p>{say()}</p></li>' for _ in range(rng.integers(1, 5)))}</ol>"))
    form = maybe(0.3, f"<form action=/s><p>{short()}</p><label>{short()}</label><input name=q></form>")
    footer = maybe(0.9, pick(f"<footer>&copy; {short()}</footer>", f'<div class="footer"><p>{short()}</p><ul>{links(3)}</ul></div>', f"<footer><p>{say()}</p></footer>"))
    mark = " data-main"
    part = lambda: pick(*[f"<p{mark}>{say(rng.integers(1, 4))}</p>"] * 6, f"<p{mark}><b>{short()}<br><p{mark}>{say()}</p>", f"<h2{mark}>{short()}</h2>", f"<ul><li{mark}>{say()}</li><li{mark}>{short()}</li></ul>", f"<blockquote{mark}>{say()}</blockquote>", f"<p{mark}>{short()}</p>")
    body = maybe(0.85, f"<h1{mark}>{short()}</h1>") + "".join(part() for _ in range(rng.integers(1, 18)))
    inside = lambda x: maybe(0.15, x)
    within = (inside(ad), inside(notice), inside(comments), inside(form))
    body = f"{within[0]}{body}{within[1]}{within[2]}{within[3]}"
    article = pick(*[f"<article>{body}</article>"] * 4, f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="{pick("content", "post", "entry-content", "article-body", "story")}">{body}</div>', f'<div id="main"><div class="text">{body}</div></div>', f"<div>{body}</div>")
    outer = [x for x in (ad, notice, side, form) if x]
    before, after = [x for x in outer if rng.random() < 0.5], [x for x in outer if rng.random() < 0.5]
    inner = "".join([header, nav, *before, article, *after, comments, footer])
    if rng.random() < 0.06:  # a page without a layout: loose text and paragraphs in its body
        inner = pick(f"{say(rng.integers(1, 4))}{body}", say(rng.integers(1, 4)), body)
        return f"<html><body{mark}>{inner}</body></html>"
    return f"<!DOCTYPE html><html><head><title>{short()}</title><style>p{{}}</style></head><body>{pick(inner, inner, f'<div class=wrap>{inner}</div>')}</body></html>"


def fit_extractor(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sampled: int = SAMPLED, trained: int = TRAINED) -> trees.Trees:
    """Trees fitted on `trained` generated pages; their words come from at most `sampled` pages, by a hash of the id."""
    rows = columns_of(pages, id=pages[id_col].cast("string"), html=html_col).where("html is not null")
    rows = rows.withColumn("key", F.xxhash64("id", "html"))
    keys = rows.select("key").distinct().orderBy("key").limit(sampled)  # no page leaves its task before the sample is known
    sample = rows.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("html").alias("html")).collect()
    blocks = sorted({" ".join(unescaped(raw).split()) for r in sample for _, raw, _ in parse(r["html"])[1]} - {""}) or ["Some words, that stand for a text."]
    rng = np.random.default_rng(7)
    x, y = [], []
    for _ in range(trained):
        nodes, pieces = parse(_page(rng, blocks))
        label = np.array(["data-main" in n.attrs for n in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            label[nodes[i].parent] |= label[i]
        x.append(features(nodes, pieces))
        y.append(label)
    return trees.fit(np.concatenate(x), np.concatenate(y).astype(float), trees=60, depth=5)


def extract(pages: DataFrame, model: trees.Trees, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text (the main text), n_chars (its code points).

    Null and empty pages give an empty text. Broken markup is read as it comes: what isn't closed
    ends with its parent. Repeated rows give repeated results, an empty table an empty one; only
    the named columns are read. Time and memory are linear in each page's length.
    """
    rows = columns_of(pages, id=id_col, url=url_col, html=html_col)
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict[str, list]:
        parsed = [parse(h) for h in x["html"]]
        chance = held.value.probability(np.concatenate([features(*p) for p in parsed])) if parsed else np.zeros(0)
        ends = np.cumsum([len(p[0]) for p in parsed]).tolist()
        text = [main_text(nodes, pieces, decode(nodes, chance[end - len(nodes) : end])) for (nodes, pieces), end in zip(parsed, ends)]
        return {"id": x["id"], "url": x["url"], "text": text, "n_chars": [len(t) for t in text]}

    kind = rows.schema
    out = map_batches(rows, run, f"id {kind['id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_extractor(pages))
