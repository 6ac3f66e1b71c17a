"""Main text of HTML pages by a tree-structured graphical model.

A page's elements form a tree. Each element is content or not; a unary potential scores its
features (tag, hints in class, id and role, text, links, place) and a potential on each edge
couples it to its parent, by the kind of the child. Sum-product messages up and down the tree
give each element's marginal, and text whose element is content with probability over one
half is the page's text.

The weights are trained here, by gradient ascent on the likelihood of labelled pages. These
pages are composed by ``labelled_pages`` from a seed: articles of many shapes among menus,
headers, footers, sidebars, notices, adverts, forms and comments, with and without the tags
that HTML has for them.

Defined cases: a null page counts as empty; a page without content has an empty text; tags
that are never closed end with their parent, and a tag that does not end is text; scripts,
styles and comments are no text in any element; other columns do not matter; rows that repeat
an id each get their row.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|[!?][^<>]*>)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile("[a-z]+")
_SPACE = re.compile(r"\s+")

_words = lambda s: frozenset(s.split())
RAW = _words("script style noscript template iframe textarea title svg select head")
VOID = _words("area base br col embed hr img input link meta source track wbr")
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label math mrow mi mo mn ms mtext msup msub mfrac msqrt object canvas")
#: An open element of these ends when one of the named ones begins.
ENDS = {
    "p": _words("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"),
    "li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "option": _words("option"),
    "tr": _words("tr"), "td": _words("td th tr"), "th": _words("td th tr"),
}
_SCOPE = _words("ul ol dl table body html div article section main td")
KINDS = ("article", "main", "section", "div", "p", "quote", "heading", "list", "item", "nav", "header", "footer", "aside", "form", "figure", "table", "cell", "body", "inline", "other")
_KIND = {
    **dict.fromkeys(("article",), 0), "main": 1, "section": 2, "div": 3, "p": 4, "blockquote": 5, "pre": 5, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 6),
    **dict.fromkeys(("ul", "ol", "dl", "menu", "dir"), 7), **dict.fromkeys(("li", "dt", "dd"), 8), "nav": 9, "header": 10, "footer": 11, "aside": 12,
    **dict.fromkeys(("form", "button", "fieldset", "dialog"), 13), **dict.fromkeys(("figure", "figcaption"), 14), **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr"), 15),
    **dict.fromkeys(("td", "th"), 16), **dict.fromkeys(("body", "html"), 17), **dict.fromkeys(INLINE, 18),
}
BAD = _words("nav navbar navigation menu header masthead topbar footer foot bottom sidebar side aside rail ad ads adv advert advertisement banner promo promoted sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended more breadcrumb breadcrumbs widget login search copyright legal pager pagination toolbar skip disclaimer form tags meta")
TALK = _words("comment comments reply replies respond discussion disqus responses reader")
GOOD = _words("article content post entry story main text body maintext articlebody postbody prose")


@dataclass
class Node:
    tag: str
    parent: int
    kind: int
    bad: bool = False
    talk: bool = False
    good: bool = False
    label: int = -1
    own: int = 0  # characters of its own text
    linked: int = 0  # of these, in links
    stops: int = 0  # ends of sentences in its own text
    all_own: int = 0
    all_linked: int = 0
    paragraphs: int = 0
    before: int = 0  # characters of text before it in the page
    hinted_above: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # (node, block, text)


def parse(source: str) -> Page:
    """The tree of a page's elements, and its text in order, each run with its element and block."""
    page = Page([Node("html", -1, 17)])
    nodes, runs = page.nodes, page.runs
    stack: list[tuple[str, int]] = [("html", 0)]  # open tags and their elements (an inline one may share its parent's)
    links, block, at, n = 0, 0, 0, len(source)

    def text(part: str) -> None:
        if part and not part.isspace():
            runs.append((stack[-1][1], block, part))
            node = nodes[stack[-1][1]]
            k = len(part.strip())
            node.own += k
            node.linked += k if links else 0
            node.stops += part.count(". ") + part.count("? ") + part.count("! ") + part.rstrip().endswith((".", "?", "!"))
        elif part and runs:
            runs.append((stack[-1][1], block, " "))

    def close(down_to: int) -> None:
        nonlocal links, block
        while len(stack) > down_to:
            tag, _ = stack.pop()
            links -= tag == "a"
            if tag not in INLINE:
                block += 1

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            if not attrs.endswith("/") or tag == "script":
                end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
                if end or tag not in ("head", "noscript"):
                    at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                runs.append((stack[-1][1], block, " "))
            continue
        if tag in ("html", "body"):
            if tag == "body" and len(nodes) == 1:
                nodes[0].tag = "body"
            continue
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i][0]
            if tag in ENDS.get(t, ()):
                close(i)
                break
            if t in _SCOPE and t not in ENDS:
                break
        words = set()
        if "=" in attrs:
            for x in _ATTR.finditer(attrs):
                words.update(_WORD.findall(re.sub("([a-z])([A-Z])", r"\1 \2", x[2] or x[3] or x[4] or "").lower()))
        bad, talk, good = not BAD.isdisjoint(words), not TALK.isdisjoint(words), not GOOD.isdisjoint(words)
        if tag in INLINE and not (bad or talk):
            stack.append((tag, stack[-1][1]))
        else:
            nodes.append(Node(tag, stack[-1][1], _KIND.get(tag, 19), bad, talk, good))
            stack.append((tag, len(nodes) - 1))
        links += tag == "a"
        if tag not in INLINE:
            block += 1
    return page


# --- the model -------------------------------------------------------------------------

_N = len(KINDS)
_EXTRA = ("bad", "talk", "good", "above", "short", "medium", "long", "empty", "links", "some links", "stops", "no stops", "paragraphs", "large share", "small share", "first", "last", "under page", "alone")
FEATURES = _N + len(_EXTRA) + 1


def _features(page: Page) -> list[list[int]]:
    """The features that hold, of each element."""
    nodes = page.nodes
    for i in range(len(nodes)):
        x = nodes[i]
        x.all_own, x.all_linked, x.paragraphs = x.own, x.linked, int(x.kind in (4, 5) and x.own > 40)
        p = x.parent
        x.hinted_above = p >= 0 and (nodes[p].hinted_above or nodes[p].bad or nodes[p].talk or nodes[p].kind in (9, 10, 11, 12, 13))
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[nodes[i].parent]
        p.all_own += nodes[i].all_own
        p.all_linked += nodes[i].all_linked
        p.paragraphs += nodes[i].paragraphs
    total = max(1, nodes[0].all_own)
    seen, out = 0, []
    for i, x in enumerate(nodes):
        f = [x.kind]
        add = lambda k: f.append(_N + k)  # noqa: E731, B023
        for k, have in enumerate((x.bad, x.talk, x.good, x.hinted_above)):
            if have:
                add(k)
        size = x.all_own
        add(7 if not size else 4 if size < 40 else 5 if size < 160 else 6)
        if size:
            share = x.all_linked / size
            if share > 0.6:
                add(8)
            elif share > 0.15:
                add(9)
            if x.kind in (4, 5, 8, 3, 16):
                add(10 if x.stops else 11)
            if x.paragraphs > 1:
                add(12)
            add(13 if size > 0.35 * total else 14)
            if seen < 0.05 * total:
                add(15)
            if seen > 0.9 * total:
                add(16)
        if x.parent == 0:
            add(17)
        if x.kind in (0, 1):
            add(18)
        f.append(FEATURES - 1)
        out.append(f)
        seen += x.own
    return out


@dataclass
class TreeModel:
    unary: np.ndarray  # FEATURES; the score of being content, 0 for not being it
    edge: np.ndarray  # KINDS of the child x parent's label x child's label

    def marginals(self, page: Page, feats: list[list[int]] | None = None) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """P(content) of each element, and P(parent's label, own label) of each edge (00, 01, 10, 11)."""
        nodes = page.nodes
        feats = feats or _features(page)
        u, e = self.unary.tolist(), self.edge.tolist()
        n = len(nodes)
        below = [[0.0, 0.0] for _ in range(n)]  # unary potential plus the children's messages
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, -1, -1):
            b = below[i]
            b[1] += sum([u[k] for k in feats[i]])
            if i:
                t = e[nodes[i].kind]
                m = tuple(_add(t[y][0] + b[0], t[y][1] + b[1]) for y in (0, 1))
                up[i] = m
                p = below[nodes[i].parent]
                p[0] += m[0]
                p[1] += m[1]
        whole = [(0.0, 0.0)] * n  # log belief, of both labels
        out, edges = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        for i in range(n):
            b = below[i]
            if i:
                t, w = e[nodes[i].kind], whole[nodes[i].parent]
                a0, a1 = w[0] - up[i][0], w[1] - up[i][1]
                j = (a0 + t[0][0] + b[0], a0 + t[0][1] + b[1], a1 + t[1][0] + b[0], a1 + t[1][1] + b[1])
                top = max(j)
                x = [math.exp(v - top) for v in j]
                z = sum(x)
                edges[i] = tuple(v / z for v in x)
                whole[i] = (_add(j[0], j[2]) - top, _add(j[1], j[3]) - top)
            else:
                whole[i] = (b[0], b[1])
            out[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, whole[i][0] - whole[i][1]))))
        return out, edges


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[Page], steps: int = 60, rate: float = 0.5, ridge: float = 0.002) -> TreeModel:
    """Gradient ascent on the mean log likelihood of labelled pages, with AdaGrad steps."""
    model = TreeModel(np.zeros(FEATURES), np.zeros((_N, 2, 2)))
    feats = [_features(p) for p in pages]
    gu, ge = np.full(FEATURES, 1e-6), np.full((_N, 2, 2), 1e-6)
    for _ in range(steps):
        du, de = -ridge * model.unary, -ridge * model.edge
        for page, fs in zip(pages, feats, strict=True):
            marginal, edges = model.marginals(page, fs)
            scale = 1 / len(pages)
            for i, x in enumerate(page.nodes):
                du[fs[i]] += (x.label - marginal[i]) * scale
                if i:
                    d = de[x.kind]
                    d[page.nodes[x.parent].label, x.label] += scale
                    e = edges[i]
                    d[0, 0] -= e[0] * scale
                    d[0, 1] -= e[1] * scale
                    d[1, 0] -= e[2] * scale
                    d[1, 1] -= e[3] * scale
        gu += du * du
        ge += de * de
        model.unary += rate * du / np.sqrt(gu)
        model.edge += rate * de / np.sqrt(ge)
    return model


# --- labelled pages ----------------------------------------------------------------------


def labelled_pages(n: int = 160, seed: int = 11) -> list[Page]:
    """Composed pages. An element that is, or holds only, article text has data-c="1"."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        source = _compose(rng)
        page = parse(source)
        marks = re.findall(r"<[a-z][a-z0-9]*(?=[\s>])(?![^>]* data-skip)[^>]* data-c=\"([01])\"[^>]*>", source)
        for node, mark in zip(page.nodes[1:], marks, strict=True):
            node.label = int(mark)
        page.nodes[0].label = 0
        pages.append(page)
    return pages


def _compose(rng: random.Random) -> str:
    pick = rng.choice

    def word() -> str:
        return "".join(pick("abcdefghijklmnoprstuvwéèüñ") for _ in range(rng.randint(2, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 16).capitalize() + pick("....!?") for _ in range(rng.randint(a, b)))

    def el(tag: str, body: str, c: int, hint: str = "") -> str:
        names = f' {pick(("class", "class", "id"))}="{hint}"' if hint else ""
        return f'<{tag}{names} data-c="{c}">{body}</{tag}>'

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def menu(c: int = 0) -> str:
        if rng.random() < 0.6:
            return el("ul", "".join(el("li", link(), c) for _ in range(rng.randint(2, 8))), c)
        return " | ".join(link() for _ in range(rng.randint(2, 8)))

    def long_or_short() -> str:
        return sentences(1, 4) if rng.random() < 0.6 else words(2, 8)

    def wrapped(kinds: list[tuple[str, str]], body: str) -> str:
        tag, hint = pick(kinds)
        return el(tag, body, 0, hint)

    def text_or_p() -> str:
        s = long_or_short()
        return s if rng.random() < 0.5 else el("p", s, 0)

    noise = {
        "menu": lambda: wrapped([("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("div", "navbar top"), ("ul", "nav-list")], menu()),
        "header": lambda: wrapped([("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead")], (el("h1", words(1, 4), 0) if rng.random() < 0.4 else "") + (menu() if rng.random() < 0.5 else text_or_p())),
        "footer": lambda: wrapped([("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "bottom legal")], "&copy; " + words(1, 3) + " " + text_or_p() + (menu() if rng.random() < 0.4 else "")),
        "side": lambda: wrapped([("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "rail widget"), ("section", "related")], (el("h3", words(1, 4), 0) if rng.random() < 0.5 else "") + (menu() if rng.random() < 0.5 else text_or_p())),
        "notice": lambda: wrapped([("div", "cookie-notice"), ("div", "notice"), ("div", "consent banner"), ("section", "alert"), ("p", "notice")], long_or_short() if rng.random() < 0.7 else long_or_short() + "<button data-c=\"0\">" + word() + "</button>"),
        "ad": lambda: wrapped([("div", "ad"), ("div", "ads"), ("aside", "ad"), ("div", "sponsored"), ("section", "promo"), ("p", "advert"), ("div", "advertisement box")], text_or_p() if rng.random() < 0.9 else link()),
        "form": lambda: f'<form data-c="0">{el("p", words(1, 6), 0) if rng.random() < 0.5 else words(1, 6)}<input name="q"><button data-c="0">{word()}</button></form>' if rng.random() < 0.6 else wrapped([("div", "newsletter"), ("div", "signup"), ("section", "subscribe")], text_or_p()),
        "talk": lambda: wrapped([("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "reader-comments"), ("section", "responses")], "".join(pick((lambda: el("p", sentences(1, 4), 0), lambda: el("div", el("p", sentences(1, 5), 0), 0, "comment"), lambda: el("article", el("p", sentences(1, 4), 0), 0, "comment"), lambda: el("div", sentences(1, 4), 0)))() for _ in range(rng.randint(1, 5)))),
    }

    def inline(s: str) -> str:
        if rng.random() < 0.25:
            parts = s.split(" ")
            i = rng.randrange(len(parts))
            parts[i] = pick((f"<b>{parts[i]}</b>", f"<em>{parts[i]}</em>", f'<a href="/x">{parts[i]}</a>', f"{parts[i]}<br>"))
            s = " ".join(parts)
        return s

    def odd() -> str:
        """Names on article text that elsewhere tell of menus, adverts and the like."""
        return pick(("more", "meta", "tags", "lead more", "share text", "notice", "related", "widget text", "header", "promo")) if rng.random() < 0.2 else ""

    def content_block() -> str:
        r = rng.random()
        if r < 0.68:
            return el("p", inline(sentences(1, 7) if rng.random() < 0.85 else words(1, 6)), 1, odd())
        if r < 0.8:
            return el(pick(("h2", "h2", "h3")), words(1, 9), 1, odd())
        if r < 0.88:
            tag = pick(("ul", "ol"))
            return el(tag, "".join(el("li", inline(words(1, 14)), 1) for _ in range(rng.randint(2, 6))), 1)
        if r < 0.93:
            return el("blockquote", sentences(1, 3) if rng.random() < 0.5 else el("p", sentences(1, 3), 1), 1)
        if r < 0.96:
            return el("table", "".join(el("tr", "".join(el("td", words(1, 4), 1) for _ in range(3)), 1) for _ in range(rng.randint(2, 4))), 1)
        return el("div", el("p", sentences(1, 4), 1) if rng.random() < 0.5 else sentences(1, 5), 1)

    tag, hint = pick((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry"), ("section", "story"), ("article", "post tags-related"), ("article", "entry meta"), ("div", "content more"), ("div", ""), ("section", ""), ("td", "")))
    inside = [content_block() for _ in range(rng.choice((1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 14)))]
    if rng.random() < 0.7:
        inside.insert(0, el("h1", words(2, 14), 1))
    for kind in ("ad", "side", "notice", "form"):
        if rng.random() < 0.15:
            inside.insert(rng.randint(1, len(inside)), noise[kind]())
    body = "".join(inside)
    article = el(tag, body, 1, hint) if rng.random() < 0.92 else body
    if tag == "td" and article != body:
        article = el("table", el("tr", article, 0), 0)
    start = [noise[k]() for k in ("header", "menu", "notice", "ad", "side", "form") if rng.random() < 0.4]
    end = [noise[k]() for k in ("talk", "side", "ad", "form", "notice", "footer") if rng.random() < 0.45]
    rng.shuffle(start)
    page = "".join([*start, article, *end])
    if rng.random() < 0.4:
        page = el("div", page, 0, pick(("", "wrapper", "page", "container")))
    return f"<html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>"


_model: list[TreeModel] = []


def default_model() -> TreeModel:
    """Trained once a process, from the same pages each time."""
    if not _model:
        _model.append(train(labelled_pages()))
    return _model[0]


def main_text(source: str, model: TreeModel) -> str:
    """White space inside a block is one space, blocks are joined by one space in page order."""
    page = parse(source)
    if not page.runs:
        return ""
    marginal, _ = model.marginals(page)
    blocks: list[str] = []
    last, part = -1, []
    for node, block, text in page.runs:
        if marginal[node] <= 0.5:
            continue
        if block != last:
            blocks.append("".join(part))
            last, part = block, []
        part.append(html.unescape(text) if "&" in text else text)
    blocks.append("".join(part))
    return " ".join(s for b in blocks if (s := _SPACE.sub(" ", b).strip()))


def _extracted(model: TreeModel):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [main_text(h or "", model) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"].astype("Int64").to_numpy(), "url": f["url"], "text": text, "n_chars": [len(t) for t in text]})

    return run


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """``pages``: page_id, url, html. One row per row: page_id, url, text, n_chars."""
    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return cols.mapInPandas(_extracted(model or default_model()), "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
