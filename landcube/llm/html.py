"""Main text of web pages by a tree-structured graphical model (operator 9).

A page's elements form a tree; each is content or not. Features of an element (its tag, what its class, id and role say,
its text's length and how much of it is links) give its own log-odds, and a 2 x 2 table of potentials ties it to its
parent. Sum-product messages go up to the root and down again and give every node's exact marginal; blocks of text above
one half are kept, in page order. Scripts, styles, titles, templates and form controls go whole; an element that HTML doesn't
name as a box, math, pictures or objects among them, is part of the text around it. Weights and potentials are trained by gradient ascent on the exact likelihood.

The tables have no page labels, so training pages are labelled by a rule: inside what HTML itself names as something other
than the article (nav, footer, header, aside, form ...; or by class, id or role) nothing is content; inside article or main
all else is; on pages with neither, blocks with much text and few links are. The training pages are a sample of at most
``SAMPLE`` pages, taken by the hash of their id, each also in a variant with paragraphs of the next page put into boxes of
the first kind, and with article and main renamed on every other; so that what a box says weighs against what its text
looks like. Extraction reads every page whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import need

#: Training pages at most, and steps of gradient ascent.
SAMPLE, STEPS = 120, 60

NAME, EDGE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

# HTML's own names.
RAW = {"script", "style", "title", "textarea", "template", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption", "caption", "address", "summary"}
BOX = {"html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "details", "fieldset", "menu", "dialog", "center", "hgroup", "search", "noscript"}
CLOSED_BY = {"p": BLOCK | BOX - {"html", "body", "head"} | {"hr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_TAGS = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "head", "search", "button", "fieldset"}
MAIN_TAGS = {"article", "main"}
ASIDE_WORDS = {"nav", "navbar", "navigation", "menu", "footer", "foot", "header", "masthead", "banner", "sidebar", "side", "aside", "ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "form", "search", "share", "sharing", "social", "comment", "comments", "reply", "replies", "disqus", "discussion", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "copyright", "legal", "disclaimer", "contentinfo", "complementary", "skip", "hidden", "teaser", "tags", "byline", "gdpr", "privacy", "paywall", "toc"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text", "prose"}



class Node:
    __slots__ = ("parent", "tag", "links", "pieces", "size", "features", "aside", "main", "block", "hinted")

    def __init__(self, parent: int, tag: str, hints: set[str]):
        self.parent, self.tag, self.pieces, self.links, self.size = parent, tag, [], 0, 0
        self.hinted = bool(hints & ASIDE_WORDS)
        self.aside = tag in ASIDE_TAGS or self.hinted
        self.main = tag in MAIN_TAGS or (not self.aside and bool(hints & MAIN_WORDS))


class Tags:
    """Ends of a page's tags. Every quote is followed once at most, so a page of unclosed quotes takes linear time too."""

    def __init__(self, page: str):
        self.page, self.last, self.astray = page, page.rfind(">"), set()

    def end(self, start: int, at: int) -> int:
        """Where the tag that begins at ``start`` ends: its first > outside quotes, read from ``at``; if there is none, its
        first > at all, which there must be."""
        followed = []
        while m := EDGE.search(self.page, at):
            if m[0] == ">":
                return m.start()
            if m.start() in self.astray:
                break
            followed.append(m.start())
            closed = self.page.find(m[0], m.end())
            if closed < 0:
                break
            at = closed + 1
        self.astray.update(followed)
        return self.page.find(">", start)


RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's elements, parents first, and its blocks of text: (node, text) in page order."""
    nodes, blocks = [Node(-1, "html", set())], []
    stack, text, linked, at, in_link = [0], [], 0, 0, 0
    tags, open_tags, unclosed = Tags(page), Counter(), set()

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                node = Node(stack[-1], "#text", set())
                node.size, node.links, node.block = len(joined), min(linked, len(joined)), True
                blocks.append((len(nodes), joined))
                nodes.append(node)
        text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(piece)

    while True:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = NAME.match(page, start) if start < tags.last else None
        end = tags.end(start, m.end()) if m else -1
        if start < tags.last and page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
        if end < 0:
            add("<")
            at = start + 1
            continue
        at = end + 1
        if not m:
            continue
        tag, closing, inner = m[2].lower(), bool(m[1]), page[m.end() : end]
        if tag in RAW and not closing:
            if tag not in unclosed and (found := RAW_ENDS[tag].search(page, at)):
                at = found.start()
            else:  # only what comes before the next tag goes, and no search is made twice in vain
                unclosed.add(tag)
                found = NAME.search(page, at)
                at = found.start() if found else len(page)
            continue
        if tag == "br" or tag == "hr":
            text.append(" ")
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in VOID or not (tag in BLOCK or tag in BOX or tag == "button"):
            continue
        flush()
        if closing:
            while open_tags[tag]:  # up to the nearest open one, each popped once
                open_tags[last := nodes[stack.pop()].tag] -= 1
                if last == tag:
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(nodes[stack[-1]].tag, ()):
            open_tags[nodes[stack.pop()].tag] -= 1
        hints: set[str] = set()
        for a in ATTRIBUTE.finditer(inner):
            name, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
            if name in ("hidden",) or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                hints.add("hidden")
            elif name in ("class", "id", "role"):
                hints.update(re.split(r"[^a-z]+", value))
        nodes.append(Node(stack[-1], tag, hints))
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> None:
    """What each node says by itself; sizes are summed up from the leaves first."""
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.size += node.size
        up.links += node.links
    aside, main = [], []
    for node in nodes:
        aside.append(node.aside or (node.parent >= 0 and aside[node.parent]))
        main.append(node.tag in MAIN_TAGS or (node.parent >= 0 and main[node.parent]))
        share = node.links / node.size if node.size else 0.0
        leaf = node.tag == "#text"
        tag = nodes[node.parent].tag if leaf else node.tag
        node.features = [
            j
            for j, on in enumerate(
                (
                    True, leaf, node.tag in MAIN_TAGS, node.main and node.tag not in MAIN_TAGS, node.tag in ASIDE_TAGS, node.hinted,
                    share > 0.5, 0.1 < share <= 0.5, leaf and node.size < 25, leaf and 25 <= node.size < 100, leaf and node.size >= 100,
                    tag == "p" or tag == "blockquote" or tag == "pre", tag in HEADINGS, tag == "li",
                    main[-1], aside[-1],
                )
            )
            if on
        ]


def labels(nodes: list[Node]) -> list[int]:
    """The training rule of the module's text, for every node; boxes count as content if they hold some."""
    has_main = any(n.tag in MAIN_TAGS for n in nodes)
    aside, main, out = [], [], [0] * len(nodes)
    for node in nodes:
        aside.append(node.aside or (node.parent >= 0 and aside[node.parent]))
        main.append(node.tag in MAIN_TAGS or (node.parent >= 0 and main[node.parent]))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text" and not aside[i]:
            tag, free = nodes[node.parent].tag, node.links <= 0.5 * node.size
            out[i] = int(main[i] if has_main else free and (node.size >= 25 or tag in HEADINGS))
        if out[i] and node.parent >= 0:
            out[node.parent] = 1
    return out


class Model:
    """weights: of the features; ties[a][b]: of a parent in state a with a child in state b."""

    def __init__(self, weights: list[float] | None = None, ties: list[list[float]] | None = None):
        # where there is nothing to train on: what the features' names suggest
        self.weights = weights or [0.0, 0.5, 2.0, 1.0, -4.0, -4.0, -1.5, -0.3, -0.5, 0.3, 1.0, 0.7, 0.5, -0.5, 3.0, -4.0]
        self.ties = ties or [[2.0, -2.0], [0.0, 0.5]]

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[float], list[float]]:
        """P(content) of each node; and for each node with a parent P(parent, child) of (0,1) and of (1,1)."""
        (t00, t01), (t10, t11) = self.ties
        w = self.weights
        own = [sum([w[j] for j in n.features]) for n in nodes]
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after parents
            o = max(-30.0, min(30.0, own[i]))
            e = exp(o)
            up[i] = log((exp(t10) + exp(t11) * e) / (exp(t00) + exp(t01) * e))
            own[nodes[i].parent] += up[i]
        p, p01, p11 = [0.0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes)
        total = list(own)
        for i, node in enumerate(nodes):
            if i:
                rest = max(-30.0, min(30.0, total[node.parent] - up[i]))
                o, r = exp(max(-30.0, min(30.0, own[i]))), exp(rest)
                a, b, c, d = exp(t00), exp(t01) * o, exp(t10) * r, exp(t11) * r * o
                z = a + b + c + d
                p01[i], p11[i] = b / z, d / z
                total[i] = own[i] + log((exp(t01) + exp(t11) * r) / (exp(t00) + exp(t10) * r))
            p[i] = 1 / (1 + exp(-max(-30.0, min(30.0, total[i]))))
        return p, p01, p11


def variant(page: str, other: str, k: int) -> str:
    """The page with paragraphs of another one in boxes that are not the article; see the module's text."""
    words, tags = sorted(ASIDE_WORDS), sorted(ASIDE_TAGS - {"head", "button"})
    paragraphs = re.findall(r"<p[^>]*>[^<]{30,}</p>", other)[:6] or ["<p>" + "text " * 12 + "</p>"]

    def box(j: int) -> str:
        inner = "".join(paragraphs[(j + i) % len(paragraphs)] for i in range(1 + (k + j) % 3))
        word, tag = words[(7 * k + 13 * j) % len(words)], tags[(k + j) % len(tags)]
        return f'<div class="{word}">{inner}</div>' if (k + j) % 3 else f"<{tag}>{inner}</{tag}>"

    page = re.sub(r"(<body[^>]*>)", lambda m: m[1] + box(0), page, count=1)
    page = re.sub(r"(</p>)", lambda m: m[1] + box(1), page, count=1)
    page = page.replace("</body>", box(2) + box(3) + "</body>", 1)
    return re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page) if k % 2 else page


def train(pages: list[str]) -> Model:
    """Gradient ascent on the likelihood of the rule's labels; on the driver, for a bounded sample."""
    trees = []
    for page in [*pages, *(variant(x, pages[k - 1], k) for k, x in enumerate(pages))]:
        nodes, _ = parse(page)
        features(nodes)
        trees.append((nodes, labels(nodes)))
    model = Model()
    if not any(any(y) for _, y in trees):
        return model
    rows = sum(len(nodes) for nodes, _ in trees)
    w, t = np.array(model.weights), np.array(model.ties)
    for step in range(STEPS):
        gw, gt = -0.002 * w * rows / 10, -0.002 * t * rows / 10
        for nodes, y in trees:
            p, p01, p11 = model.marginals(nodes)
            for i, node in enumerate(nodes):
                gw[node.features] += y[i] - p[i]
                if i:
                    a, b = y[node.parent], y[i]
                    up = p[node.parent]
                    gt[a, b] += 1
                    gt -= [[1 - up - p01[i], p01[i]], [up - p11[i], p11[i]]]
        rate = 8.0 / rows / (1 + step / 30)
        w, t = w + rate * gw, t + rate * gt
        model = Model(w.tolist(), t.tolist())
    return model


def main_text(page: str, model: Model) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    features(nodes)
    p, _, _ = model.marginals(nodes)
    return "\n\n".join(text for i, text in blocks if p[i] > 0.5)


def sample(pages: DataFrame) -> list[str]:
    some = pages.where("html is not null and html <> ''").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    return [r["html"] for r in some.select("html").collect()]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page row.

    A null or empty page, and one without content, gives the empty text. Repeated rows are extracted each for itself; an
    empty table gives no rows; extra columns are ignored.
    """
    pages = need(pages, "page_id", "url", "html")
    model = train(sample(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
