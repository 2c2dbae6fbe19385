"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in one is a node with a hidden label, content or
not. Nodes have potentials from their tag, class words and text, and parent-child edges have
potentials by the child's kind. Sum-product messages go up from the leaves and down from the
root; a run is part of the main text when its marginal says so. Weights are fitted to labelled
pages by the exact gradient: observed less expected features.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import short_batches

# How HTML elements nest and show.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("head title script style noscript template svg math iframe object select datalist textarea audio video canvas".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br button cite code data del dfn em embed font i img input ins kbd label mark meter output progress q ruby s samp small source span strike strong sub sup time track tt u var wbr area rp rt".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table div article section body td th blockquote nav aside footer header main form".split())

WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("parent", "tag", "hints", "text", "links", "total", "linked", "index")

    def __init__(self, parent: Node | None, tag: str, hints: list[str]):
        self.parent, self.tag, self.hints = parent, tag, hints
        self.text: list[str] = []
        self.links = 0
        self.total = self.linked = 0
        self.index = -1


TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z""", re.DOTALL)
ATTR = re.compile(r"""(?<![^\s"'/])(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}


class Page:
    """The block tree of a page: nodes in page order, parents first; unclosed and stray tags are repaired as browsers do."""

    def __init__(self, html: str) -> None:
        self.root = Node(None, "body", [])
        self.nodes = [self.root]
        self.open: list[tuple[str, Node]] = [("body", self.root)]  # every open element with its block
        self.run: Node | None = None
        self.anchors = 0
        hidden: list[str] = []  # an open element that shows nothing, and those open inside it
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at and not hidden:
                self.data(html[at : m.start()])
            at = m.end()
            tag = m.group(2) or m.group(5)
            if not tag:
                continue
            tag, ends = tag.lower(), bool(m.group(1) or m.group(4))
            if tag in SILENT:
                if tag in RAW and not ends:
                    end = RAW[tag].search(html, at)
                    at = end.end() if end else len(html)
                    continue
                if tag in RAW or tag == "head" or not (hidden or not ends):
                    continue
            if hidden or tag in SILENT:
                if not ends:
                    # a slash ends svg, math and what is inside of them only
                    if not (tag in VOID or m.group().endswith("/>") and not {"svg", "math"}.isdisjoint([*hidden, tag])):
                        hidden.append(tag)
                elif tag in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
                elif hidden[0] != "template" and tag not in INLINE and any(t == tag for t, _ in self.open[1:]):
                    hidden.clear()  # it was never closed, and the block that holds it ends
                    self.end(tag)
            elif ends:
                self.end(tag)
            else:
                self.start(tag, m.group(3) or m.group(6) or "")
        if at < len(html) and not hidden:
            self.data(html[at:])

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            if tag == "body" and attrs:
                self.root.hints = self.hint_words(attrs)
            return
        if tag in CLOSES_P and tag != "hr":
            self.close("p", STOPS)
        for other in SIBLINGS.get(tag, ()):
            self.close(other, STOPS - SIBLINGS[tag])
        if tag in VOID:
            if tag == "br" and self.run is not None:
                self.run.text.append(" ")
            elif tag not in INLINE:
                self.run = None
            return
        block = self.open[-1][1]
        if tag not in INLINE:
            self.run = None
            block = Node(block, tag, self.hint_words(attrs) if attrs else [])
            self.nodes.append(block)
        self.anchors += tag == "a"
        self.open.append((tag, block))

    @staticmethod
    def hint_words(attrs: str) -> list[str]:
        return sorted({w for v in ATTR.findall(attrs) for w in WORD.findall(CAMEL.sub(" ", unescape(v)).lower())})

    def close(self, tag: str, stops: frozenset[str] | set[str]) -> None:
        """End the innermost open ``tag`` unless one of ``stops`` lies inside it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.cut(i)
                return
            if self.open[i][0] in stops:
                return

    def end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.cut(i)
                return

    def cut(self, i: int) -> None:
        for tag, _ in self.open[i:]:
            self.anchors -= tag == "a"
            if tag not in INLINE:
                self.run = None
        del self.open[i:]

    def data(self, text: str) -> None:
        if self.run is None:
            if text.isspace():
                return
            self.run = Node(self.open[-1][1], "#text", [])
            self.nodes.append(self.run)
        self.run.text.append(text)
        if self.anchors:
            self.run.links += len(text.strip())


def parse(html: str) -> list[Node]:
    """Nodes of a page; runs hold their text, references decoded and white space made one space."""
    nodes = []
    for n in Page(html).nodes:
        if n.tag == "#text":
            text = "".join(n.text)
            n.text = [" ".join((unescape(text) if "&" in text else text).split())]
            if not n.text[0]:
                continue
            n.total, n.linked = len(n.text[0]), min(n.links, len(n.text[0]))
        n.index = len(nodes)
        nodes.append(n)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.total += n.total
            n.parent.linked += n.linked
    return nodes


def kind(n: Node) -> str:
    """The kind of edge to a node from its parent."""
    if n.tag == "#text":
        return "#text"
    if n.tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "li", "ul", "ol"):
        return "flow"
    return "named" if n.hints else "plain"


Shape = tuple[str, int, int, int, tuple[str, ...]]


def shape(n: Node) -> Shape:
    """All that a node's potential depends on: tag, size, link share, how its text ends, class words."""
    t = n.total
    share = 0 if n.linked * 20 < t or not t else 1 if n.linked * 2 < t else 2
    end = 0
    if n.tag == "#text":
        end = 1 + (n.text[0][-1] in ".!?…:\"”") + 2 * ("©" in n.text[0])
    return n.tag, (t > 0) + (t > 4) + (t > 21) + (t > 100) + (t > 464), share, end, tuple(n.hints)


def features(s: Shape) -> list[str]:
    tag, length, share, end, hints = s
    out = [f"tag:{tag}", f"len:{tag == '#text'}:{length}", f"link:{share}"] + [f"hint:{h}" for h in hints]
    return out + [f"end:{end}"] * (end > 0)


KINDS = ("#text", "flow", "named", "plain")


class TreeModel:
    """Weights of node features (for the label content) and of edges by kind, parent and child label."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, edges: dict[str, list[list[float]]]):
        self.names, self.weights, self.edges = names, weights, edges
        self.by_name = {f: float(weights[i]) for f, i in names.items()}
        self.known: dict[Shape, float] = {}

    def potential(self, s: Shape) -> float:
        if len(self.known) > 100_000:
            self.known.clear()
        got = self.known[s] = math.exp(max(-30.0, min(30.0, sum(self.by_name.get(f, 0.0) for f in features(s)))))
        return got

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, float]]]:
        """Sum-product on one tree: P(content) of every node, and of each node's edge (parent, child both; child alone).

        Parents come first in ``nodes``, so the upward pass is the reversed list and the downward
        pass the list itself; no recursion, however deep the page. Messages are (label 0, label 1).
        """
        n, edges, known = len(nodes), self.edges, self.known
        up = [(1.0, 1.0)] * n  # product of own potential and the children's messages
        msg: list[tuple[float, float]] = [(1.0, 1.0)] * n
        acc0, acc1 = [1.0] * n, [known.get(s := shape(x)) or self.potential(s) for x in nodes]
        for i in range(n - 1, -1, -1):
            z = acc0[i] + acc1[i]
            a0, a1 = acc0[i] / z, acc1[i] / z
            up[i] = (a0, a1)
            p = nodes[i].parent
            if p is not None:
                (e00, e01), (e10, e11) = edges[kind(nodes[i])]
                m0, m1 = a0 * e00 + a1 * e01, a0 * e10 + a1 * e11
                s = m0 + m1
                msg[i] = (m0 / s, m1 / s)
                j = p.index
                acc0[j] *= msg[i][0]
                acc1[j] *= msg[i][1]
                if acc0[j] + acc1[j] < 1e-200:
                    acc0[j], acc1[j] = acc0[j] * 1e200, acc1[j] * 1e200
        belief = [(0.0, 0.0)] * n
        both = [(0.0, 0.0)] * n
        for i, x in enumerate(nodes):
            a0, a1 = up[i]
            p = x.parent
            if p is None:
                belief[i] = (a0, a1)
                continue
            b0, b1 = belief[p.index]
            m0, m1 = msg[i]
            c0, c1 = b0 / max(m0, 1e-300), b1 / max(m1, 1e-300)  # the parent's belief without this child
            (e00, e01), (e10, e11) = edges[kind(x)]
            j00, j01, j10, j11 = c0 * e00 * a0, c0 * e01 * a1, c1 * e10 * a0, c1 * e11 * a1
            z = j00 + j01 + j10 + j11
            belief[i] = ((j00 + j10) / z, (j01 + j11) / z)
            both[i] = (j01 / z, j11 / z)
        return [b[1] for b in belief], both

    def text(self, html: str, least: float = 0.5) -> str:
        nodes = parse(html)
        p, _ = self.marginals(nodes)
        return "\n".join(n.text[0] for n, q in zip(nodes, p) if n.tag == "#text" and q >= least)


# What parts of pages are commonly called.
PARTS = {
    "menu": ("nav div ul header", "nav navbar navigation menu topnav main-menu site-nav breadcrumb breadcrumbs"),
    "header": ("header div", "header site-header masthead top page-header branding"),
    "footer": ("footer div", "footer site-footer page-footer bottom copyright colophon"),
    "sidebar": ("aside div section", "sidebar side widget related recommended trending rail tags"),
    "notice": ("div section aside p", "notice cookie cookies consent alert banner gdpr popup modal message warning"),
    "advert": ("div aside ins section", "ad ads advert advertisement sponsor sponsored promo promotion banner-ad"),
    "form": ("form", "form search newsletter subscribe login signup contact"),
    "comments": ("section div ol ul", "comments comment reply replies discussion responses disqus respond"),
    "share": ("div ul", "share social sharing buttons follow pagination pager"),
}
BODY = ("article main div section", "article content post entry entry-content story story-body article-body main body text page-content post-body prose")


def labelled_pages(n: int, seed: int = 5) -> Iterator[tuple[str, list[str]]]:
    """(html, its content blocks) of n drawn layouts, some without telling names or tags."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(4, 14).capitalize() + r.choice(["."] * 8 + ["?", "!"]) for _ in range(r.randint(a, b)))

    def named(tags: str, names: str, bare: float) -> tuple[str, str]:
        tag, some = r.choice(tags.split()), r.sample(names.split(), k=r.choice([1, 1, 2]))
        if r.random() < bare:
            return (tag, "")
        return tag, f' {r.choice(["class", "class", "class", "id"])}="{" ".join(some)}"'

    def part(role: str) -> str:
        tag, attrs = named(*PARTS[role], 0.15 if role in ("advert", "notice", "share", "sidebar", "comments") else 0.4)
        item = "li" if tag in ("ul", "ol") else r.choice(["div", "span", "p"])
        if role in ("menu", "share"):
            links = [f'<a href="/{w}">{w}</a>' for w in words(3, 8).split()]
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if tag in ("nav", "div", "header") and r.random() < 0.7 else "".join(f"<{item}>{x}</{item}>" for x in links)
        elif role == "header":
            body = f'<a href="/">{words(1, 3)}</a>' + (f"<p>{words(2, 6)}</p>" if r.random() < 0.5 else "")
        elif role == "footer":
            body = r.choice(["&copy; " + words(1, 3) + " &middot; " + sentences(0, 2), f"<p>&copy; {words(2, 4)}</p><p><a href='/p'>{words(1, 2)}</a></p>", f"<p>{words(2, 5)}</p>"])
        elif role == "sidebar":
            body = f"<h3>{words(1, 3)}</h3>" + "".join(r.choice([f'<p><a href="#">{words(3, 8)}</a></p>', f"<p>{sentences(1, 2)}</p>"]) for _ in range(r.randint(1, 4)))
        elif role == "form":
            body = f"<label>{words(1, 3)}</label><input name=q>" + (f"<p>{sentences(1, 2)}</p>" if r.random() < 0.5 else "") + f"<button>{words(1, 2)}</button>"
        elif role == "comments":
            body = (f"<h3>{words(1, 2)}</h3>" if r.random() < 0.6 else "") + "".join(
                f"<{(c := 'li' if tag in ('ol', 'ul') else 'div')} class=\"comment\"><b>{words(1, 2)}</b><p>{sentences(1, 5)}</p></{c}>" if r.random() < 0.7 else f"<p>{sentences(1, 4)}</p>" for _ in range(r.randint(1, 4))
            )
        else:
            body = r.choice([sentences(1, 3), f"<p>{sentences(1, 3)}</p>", f"{words(3, 9)} <a href='#'>{words(1, 2)}</a>", f"<b>{words(1, 3)}</b> {sentences(1, 2)}"])
        return f"<{tag}{attrs}>{body}</{tag}>"

    for _ in range(n):
        content: list[str] = []

        def said(x: str) -> str:
            content.append(x)
            return x

        blocks = [f"<h1>{said(words(3, 9).capitalize())}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 9)):
            shape = r.random()
            if shape < 0.7:
                blocks.append(f"<p>{said(sentences(1, 6) if r.random() < 0.85 else words(1, 3).capitalize() + '.')}</p>")
            elif shape < 0.8:
                blocks.append(f"<h2>{said(words(2, 6).capitalize())}</h2>")
            elif shape < 0.88:
                blocks.append("<ul>" + "".join(f"<li>{said(words(2, 12))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif shape < 0.93:
                blocks.append(f"<blockquote><p>{said(sentences(1, 2))}</p></blockquote>")
            else:
                blocks.append(f"<div>{said(sentences(1, 3))}</div>")
            if r.random() < 0.12:
                blocks.append(part(r.choice(["advert", "notice", "share", "form", "sidebar"])))
        if r.random() < 0.15:
            blocks.append(part("comments"))
        tag, attrs = named(*BODY, 0.25)
        main = f"<{tag}{attrs}>{''.join(blocks)}</{tag}>"
        if r.random() < 0.4:
            tag, attrs = named("main div section", "main content wrapper container page", 0.3)
            main = f"<{tag}{attrs}>{main}{part('comments') if r.random() < 0.3 else ''}</{tag}>"
        before = [part(x) for x in ("header", "menu", "notice", "advert", "form") if r.random() < 0.5]
        after = [part(x) for x in ("sidebar", "comments", "share", "advert", "form", "footer") if r.random() < 0.5]
        yield f"<html><head><title>{words(2, 5)}</title><script>x='<p>'</script></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", content


def labels_of(nodes: list[Node], content: list[str]) -> list[int]:
    """1 for the content's runs, found in page order, and for all that holds one."""
    y, k = [0] * len(nodes), 0
    for n in nodes:
        if n.tag == "#text" and k < len(content) and n.text[0] == content[k]:
            y[n.index] = 1
            k += 1
    for n in reversed(nodes):
        if y[n.index] and n.parent is not None:
            y[n.parent.index] = 1
    return y


def train(pages: Iterator[tuple[str, list[str]]], steps: int = 100, l2: float = 0.01, least: int = 3) -> TreeModel:
    """Maximum likelihood of the labels, by the exact gradient of every tree."""
    trees = [(nodes := parse(html), labels_of(nodes, content)) for html, content in pages]
    seen: dict[str, int] = {}
    for nodes, _ in trees:
        for n in nodes:
            for f in features(shape(n)):
                seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    size, k = len(names), len(KINDS)
    ids = [[[names[f] for f in features(shape(n)) if f in names] for n in nodes] for nodes, _ in trees]
    theta = np.zeros(size + 4 * k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = sum(len(t[0]) for t in trees)

    def model() -> TreeModel:
        e = np.exp(theta[size:]).reshape(k, 2, 2)
        return TreeModel(names, theta[:size], {c: e[i].tolist() for i, c in enumerate(KINDS)})

    for step in range(1, steps + 1):
        now, g = model(), np.zeros_like(theta)
        for (nodes, y), fs in zip(trees, ids):
            p, both = now.marginals(nodes)
            for i, n in enumerate(nodes):
                d = y[i] - p[i]
                for f in fs[i]:
                    g[f] += d
                if n.parent is not None:
                    at = size + 4 * KINDS.index(kind(n))
                    j01, j11 = both[i]
                    q = p[n.parent.index]
                    for place, e in ((0, 1 - q - j01), (1, j01), (2, q - j11), (3, j11)):
                        g[at + place] -= e
                    g[at + 2 * y[n.parent.index] + y[i]] += 1
        g = g / total - l2 * theta / 100
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model()


TRAINING_PAGES = 250
_FITTED: list[TreeModel] = []


def default_model() -> TreeModel:
    if not _FITTED:
        _FITTED.append(train(labelled_pages(TRAINING_PAGES)))
    return _FITTED[0]


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    NULL and empty pages, and pages without content, give the empty text. Repeated rows give
    equal results; other columns are ignored.
    """
    short_batches(pages.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
