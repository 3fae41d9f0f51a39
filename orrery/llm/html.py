"""HTML extraction: boosted trees over the features of DOM nodes.

A tolerant parser makes a tree of each page. Features of an element are its tag, what its attributes' tokens say (hashed
tokens of class, id and role, each with the log odds of main text that it has in the training pages: the least, the
greatest and the sum of its own, and the extremes on the way to the root), section tags on that way, depth, text and link density of its subtree, and
the same of its parent, of its previous and next sibling, and of the median sibling. Gradient-boosted trees give the odds
that an element's own text is main text. Decoding goes down from the root: an element is kept or dropped as a whole
once the odds of its subtree (its texts' own odds, weighted by length, with its own prior) are clear, and what lies
below a dropped element stays dropped, so an ancestor and its descendants never contradict each other. Scripts, styles,
forms and their controls, and the page's head are dropped by their tags; nothing else is, hidden elements included.

There are no labelled pages. TRAIN_PAGES come from a fixed generator of page shapes, which knows what it writes as main text
and what as menu, advert, notice, comment and so on, inside articles too. Pages of the corpus that have an ``article`` or
``main`` element add to them, SAMPLE_PAGES at most: what is in it is main text, but for ``nav``, ``header``, ``footer``,
``aside`` and ``form``, and what is outside is not. Half of all training pages have their section tags replaced by plain
``div``, so that shape and attributes have to tell on pages without them.

Defined cases: a null or empty page has no text; a page without main text has an empty one; unclosed, misnested and cut
tags are closed where they must be; repeated rows repeat their result; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import sigmoid, text_slices

SAMPLE_PAGES, TRAIN_PAGES, SAMPLE_CHARS = 150, 600, 200_000
TOKENS = 4096
SWAY = 1.0
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 24

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select".split())
NEVER = frozenset("script style head title noscript iframe template textarea select option button form input".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, as far as the nearest of the stops.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
SCOPE = frozenset("article aside body div footer header html main nav section table td th blockquote form".split())
GOOD_TAGS = frozenset({"article", "main"})
BAD_TAGS = frozenset({"nav", "header", "footer", "aside", "form", "menu"})
NAME = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "tokens", "hidden", "truth", "parent", "children", "depth", "chars", "link", "marks", "blocks", "order")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.tokens, self.hidden, self.truth = (), False, None
        self.chars = self.link = self.marks = self.blocks = 0
        if attributes:
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            self.tokens = hashed(f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}")
            self.truth = found.get("data-truth")  # generated pages have it; only labels are made of it
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")


@lru_cache(100_000)
def hashed(names: str) -> tuple[int, ...]:
    """The places of the attribute tokens: their letters' runs, in lower case."""
    return tuple(sorted({zlib.crc32(t.encode()) % TOKENS for t in NAME.findall(names.lower())}))


def parse(html: str) -> Node:
    """The tree. Children are nodes and strings (raw text with references)."""
    root = Node("#", "", None)
    at, i = root, 0
    n = len(html)
    while i < n:
        j = html.find("<", i)
        if j < 0:
            j = n
        if j > i:
            at.children.append(html[i:j])
        if j >= n:
            break
        m = TOKEN.match(html, j)
        if not m:
            at.children.append("<")
            i = j + 1
            continue
        i = m.end()
        if close := m[1]:
            close = close.lower()
            up = at
            while up is not root and up.tag != close:
                if up.tag in SCOPE and close not in SCOPE:
                    break
                up = up.parent
            if up is not root and up.tag == close:
                at = up.parent
            elif close == "p":
                at.children.append(Node("p", "", at))
        elif open_ := m[2]:
            tag = open_.lower()
            if tag in CLOSES:
                what, stops = CLOSES[tag]
                up = at
                while up is not root and up.tag not in stops and up.tag not in what:
                    up = up.parent
                if up.tag in what:
                    at = up.parent
            elif tag in BLOCK:  # a block ends an open paragraph
                up = at
                while up is not root and up.tag not in SCOPE and up.tag != "p":
                    up = up.parent
                if up.tag == "p":
                    at = up.parent
            node = Node(tag, m[3], at)
            at.children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(html, i)
                node.children.append(html[i : end.start() if end else n])
                i = end.end() if end else n
            elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
                at = node
    return root


def measure(root: Node) -> list[Node]:
    """The nodes in page order, with the sums of their subtrees."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.order = len(order)
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        if node.tag in NEVER:
            node.chars = 0
        else:
            for own in node.children:
                if isinstance(own, str):
                    node.chars += len(own.strip())
                    node.marks += own.count(".") + own.count(",") + own.count(";")
        if node.tag == "a":
            node.link = node.chars
        if up := node.parent:
            up.chars += node.chars
            up.link += node.link
            up.marks += node.marks
            up.blocks += node.blocks + (node.tag in BLOCK)
    return order


TAGS = ["p", "div", "li", "a", "h1", "h2", "h3", "td", "span", "ul", "article", "main", "nav", "header", "footer", "aside", "section", "b", "body", "pre", "blockquote"]
TAG_NUMBER = {t: i + 1 for i, t in enumerate(TAGS)}


def features(order: list[Node], odds: np.ndarray) -> np.ndarray:
    """odds: the log odds of main text of each attribute token."""
    odds = odds.tolist()
    least, most, links, good, bad = ([0.0] * len(order) for _ in range(5))
    rows, top, total = [], max(1, order[0].chars), len(order)
    near: dict[int, tuple] = {0: ((0.0,) * 6, 0.0, 0.0)}  # of a node: previous and next sibling, and the median of all
    for n in order:
        inner = [c for c in n.children if isinstance(c, Node)]
        if inner:
            size = [log1p(c.chars) for c in inner]
            link = [c.link / max(1, c.chars) for c in inner]
            middle = (sorted(size)[len(size) // 2], sorted(link)[len(link) // 2])
            for k, c in enumerate(inner):
                before = (size[k - 1], link[k - 1], float(inner[k - 1].tag == c.tag)) if k else (-1.0, -1.0, 0.0)
                after = (size[k + 1], link[k + 1], float(inner[k + 1].tag == c.tag)) if k + 1 < len(inner) else (-1.0, -1.0, 0.0)
                near[c.order] = ((*before, *after), *middle)
    for i, n in enumerate(order):
        up = n.parent
        own = [odds[t] for t in n.tokens]
        low, high, chars, at = min(own, default=0.0), max(own, default=0.0), n.chars, max(1, n.chars)
        if up:
            k, wide = up.order, max(1, up.chars)
            least[i], most[i], links[i] = min(least[k], low), max(most[k], high), float(links[k] or n.tag == "a")
            good[i], bad[i] = float(good[k] or n.tag in GOOD_TAGS), float(bad[k] or n.tag in BAD_TAGS)
            above = (log1p(up.chars), up.link / wide, up.marks / wide, log1p(len(up.children)), TAG_NUMBER.get(up.tag, 0), up.parent.link / max(1, up.parent.chars) if up.parent else 0)
        else:
            above = (0, 0, 0, 0, 0, 0)
        around, size, link = near[i]
        rows.append(
            (TAG_NUMBER.get(n.tag, 0), n.depth, log1p(chars), n.link / at, n.marks / at, log1p(n.blocks), chars / (n.blocks + 1), low, high, sum(own),
             least[i], most[i], links[i], good[i], bad[i], chars / top, i / total, n.hidden, len(own), *above, *around, size, link)
        )
    return np.array(rows, np.float32)


def token_odds(pages: list[tuple[list[Node], np.ndarray]]) -> np.ndarray:
    """The smoothed log odds of each attribute token in labelled pages."""
    n = np.ones((2, TOKENS))
    for order, y in pages:
        for node, label in zip(order, y.tolist(), strict=True):
            if label >= 0:
                for t in node.tokens:
                    n[label, t] += 1
    return np.log(n[1]) - np.log(n[0])


class Trees:
    """Boosted regression trees with logistic loss, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.bins(x)
        self.base = float(np.log((w * y).sum() + 1) - np.log((w * (1 - y)).sum() + 1))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = sigmoid(score)
            tree = self.grow(binned, w * (p - y), w * p * (1 - p))
            self.trees.append(tree)
            score += RATE * self.walk(tree, binned)
        return self

    def bins(self, x):
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.int16)

    def grow(self, b, g, h):
        """(feature, bin, values): a full tree of DEPTH levels; node k has children 2k + 1 and 2k + 2."""
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(g), int)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            G, H = g[own].sum(), h[own].sum()
            value[k] = -G / (H + 1)
            if k >= size // 2 or len(own) < 10:
                continue
            best = (1e-3, None, None)
            for f in range(b.shape[1]):
                n = len(self.cuts[f]) + 1
                if n < 2:
                    continue
                gs, hs = (np.cumsum(np.bincount(b[own, f], v[own], n))[:-1] for v in (g, h))
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], f, j)
            if best[1] is not None:
                feature[k], cut[k] = best[1:]
                node[own] = np.where(b[own, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        return feature, cut, value

    @staticmethod
    def walk(tree, b):
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f < 0, node, np.where(b[rows, f] <= cut[node], 2 * node + 1, 2 * node + 2))
        return value[node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.base + RATE * sum(self.walk(t, b) for t in self.trees)


def decode(order: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes' own text is kept. A node whose subtree's mean odds are against it is dropped with all below it."""
    weight = np.array([sum(len(c.strip()) for c in n.children if isinstance(c, str)) if n.tag not in NEVER else 0 for n in order], float)
    total, mass = odds * weight, weight.copy()
    for n in reversed(order):
        if n.parent:
            total[n.parent.order] += total[n.order]
            mass[n.parent.order] += mass[n.order]
    keep = [True] * len(order)
    for n in order[1:]:
        i = n.order
        keep[i] = keep[n.parent.order] and n.tag not in NEVER
        if keep[i] and n.tag in BLOCK and n.tag not in ("html", "body"):
            # the whole's odds count as much as its own; what is around it sways it a little: a short heading follows its section
            up = n.parent.order
            whole = total[i] / mass[i] if mass[i] else odds[i]
            around = min(SWAY, total[up] / mass[up]) if mass[up] and n.tag not in BAD_TAGS else 0
            keep[i] = whole + odds[i] + around > 0
    return keep


def blocks(order: list[Node], keep: list[bool]) -> str:
    """The kept text: blocks in page order, white space made one space, joined by an empty line."""
    out, now = [], []

    def end():
        text = SPACE.sub(" ", unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    stack = [order[0]]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            now.append(item)
        elif item is None:
            end()
        elif keep[item.order]:
            if item.tag == "br":
                now.append(" ")
                continue
            if item.tag in BLOCK:
                end()
                stack.append(None)
            for c in reversed(item.children):
                if isinstance(c, Node):
                    stack.append(c)
                elif item.tag not in ("html", "#", "ul", "ol", "table", "tr", "tbody", "nav") or c.strip():
                    stack.append(c)
    end()
    return "\n\n".join(out)


def extract(html: str | None, trees: Trees) -> str:
    return extract_all([html], trees)[0]


def extract_all(pages: list, trees: Trees) -> list[str]:
    """The main text of each page; the trees are asked once for all of them."""
    orders = [measure(parse(html)) if html else None for html in pages]
    some = [features(order, trees.tokens) for order in orders if order]
    odds = trees.odds(np.vstack(some)) if some else np.zeros(0)
    out, at = [], 0
    for order in orders:
        if order:
            out.append(blocks(order, decode(order, odds[at : at + len(order)])))
            at += len(order)
        else:
            out.append("")
    return out


def marked(order: list[Node]) -> np.ndarray:
    """1: main text, 0: not, -1: neither is said. By what the generator wrote, else by section tags."""
    out = np.full(len(order), -1)
    told = any(n.truth for n in order)
    holds = [n.tag in GOOD_TAGS or n.truth == "1" for n in order]
    for n in reversed(order):
        if n.parent and holds[n.order]:
            holds[n.parent.order] = True
    for n in order[1:]:
        i, up = n.order, out[n.parent.order]
        if told:
            out[i] = int(n.truth) if n.truth else up
        elif n.tag in BAD_TAGS or n.tag in NEVER or up == 0:
            out[i] = 0
        else:
            out[i] = 1 if n.tag in GOOD_TAGS or up == 1 else (-1 if holds[i] or not holds[0] else 0)
    return out


#: Names that pages give their parts: what the generator writes, not a list that decides.
NAMES = {
    "menu": "nav menu navbar topnav breadcrumb breadcrumbs main-menu site-nav navigation pagination pager toolbar tabs",
    "head": "header masthead site-header banner top-bar branding",
    "foot": "footer site-footer foot bottom copyright legal colophon",
    "side": "sidebar aside side related recommended widget rail most-read",
    "note": "notice cookie-notice cookies consent gdpr popup modal newsletter subscribe alert disclaimer paywall login signup",
    "ad": "ad ads advert advertisement ad-slot banner-ad sponsor sponsored promo promotion teaser outbrain taboola commercial",
    "share": "share social sharing share-buttons follow tags",
    "talk": "comments comment-list discussion replies responses cmt disqus respond reader-comments thread",
    "main": "content article post entry story main body article-body text post-content",
}


def generated(seed: int) -> str:
    """A page of one of many shapes, with sections marked by tags, by names, or both; ``data-truth`` says what is main text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ta", "re", "mi", "so", "lu", "ken", "da")) for _ in range(r.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    para = lambda: " ".join(say(r.randint(5, 14)) for _ in range(r.randint(1, 6)))
    links = lambda n: "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(n))
    name = lambda kind: r.choice(NAMES[kind].split())

    def part(tag: str, kind: str, inner: str) -> str:
        how = r.random()
        if how < 0.4 and tag != "div":
            return f"<{tag} data-truth='0'>{inner}</{tag}>"
        tag = tag if how < 0.6 else "div"
        return f"<{tag} {r.choice(('class', 'id', 'class'))}='{name(kind)}' data-truth='0'>{inner}</{tag}>"

    def aside() -> str:
        return r.choice(
            (
                lambda: part("div", "ad", f"<p>{say(r.randint(4, 12))}</p>" if r.random() < 0.5 else say(r.randint(3, 12))),
                lambda: part("div", "note", f"<p>{say(8)}</p>"),
                lambda: part("div", "share", f"<ul>{links(3)}</ul>"),
                lambda: part("aside", "side", f"<h3>{say(2)}</h3><ul>{links(4)}</ul>"),
            )
        )()

    head = part("header", "head", f"<a href='/'>{word()}</a> {say(3)}") if r.random() < 0.6 else ""
    nav = part("nav", "menu", f"<ul>{links(r.randint(3, 9))}</ul>")
    note = part("div", "note", f"<p>{say(8)}</p>") if r.random() < 0.5 else ""
    ad = part("div", "ad", r.choice((say(5), f"<p>{say(8)}</p>", para()))) if r.random() < 0.6 else ""
    side = part("aside", "side", f"<h3>{say(2)}</h3><ul>{links(5)}</ul><p>{say(6)}</p>") if r.random() < 0.5 else ""
    form = f"<form data-truth='0'><label>{word()}</label><input name='q'><button>{word()}</button></form>" if r.random() < 0.4 else ""
    one = lambda: f"<div class='{r.choice(('comment', 'reply', 'message', 'item'))}'><b>{word()}</b><p>{para()}</p></div>"
    talk = part("section", "talk", "".join(one() for _ in range(r.randint(1, 4)))) if r.random() < 0.5 else ""
    foot = part("footer", "foot", r.choice((f"&copy; {word()} {say(6)} <a href='/x'>{word()}</a>", " | ".join(word() for _ in range(r.randint(2, 9))), f"<p>{say(9)}</p>")))
    odd = lambda: r.choice(
        (f"<p>{word()}: <math>{word()}={word()}</math> {word()}</p>", f"<p>{word()} <label>{word()}</label> <span hidden>{word()}</span> {word()}</p>", f"<svg><text>{word()} {word()}</text></svg>",
         f"<figure><img src='/i'><figcaption>{say(4)}</figcaption></figure>", f"<table><tr><th>{word()}</th><td>{word()}</td></tr></table>", f"<pre>{word()} {word()}</pre>")
    )
    piece = lambda: r.choice((f"<p>{para()}</p>", f"<p>{para()}", f"<h2>{say(4)}</h2><p>{para()}</p>", f"<blockquote><p>{para()}</p></blockquote>", f"<ul><li>{say(9)}</li><li>{say(9)}</li></ul>", f"<p>{say(9)} <a href='/y'>{word()}</a> {say(9)}</p>", f"<p>{say(3)}</p>", odd()))
    pieces = [f"<h1>{say(6)}</h1>"] + [piece() for _ in range(r.randint(1, 9))]
    for _ in range(r.choice((0, 0, 1, 2))):
        pieces.insert(r.randint(1, len(pieces)), aside())
    if talk and r.random() < 0.3:
        pieces.append(talk)
        talk = ""
    tag = r.choice(("article", "article", "main"))
    attribute = f" class='{name('main')}'" if r.random() < 0.5 else ""
    main = f"""<{tag}{attribute} data-truth='1'>{''.join(pieces)}""" + (f"</{tag}>" if r.random() < 0.85 else "")  # some pages forget to close it
    if r.random() < 0.12:  # a fragment
        return main if r.random() < 0.5 else f"{nav}{main}"
    inner = f"<div id='{name('main')}'>{note if r.random() < 0.5 else ''}{main}{talk}</div>" if r.random() < 0.5 else f"{main}{talk}"
    return f"<html><head><title>{word()}</title><style>p{{}}</style></head><body>{head}{nav}{note}{form}{ad}{inner}{side}{foot}</body></html>"


def plain(order: list[Node]) -> None:
    """Makes section tags plain."""
    for n in order:
        if n.tag in GOOD_TAGS | BAD_TAGS and n.tag != "form":
            n.tag = "div"


def train(pages: list[str]) -> Trees:
    """pages: of the corpus; those that mark their main text are used beside the generated ones."""
    known = []
    texts = [generated(i) for i in range(TRAIN_PAGES)] + sorted(p for p in pages if p)
    for k, html in enumerate(texts):
        order = measure(parse(html))
        y = marked(order)
        if (y == 1).any():
            if k % 2:
                plain(order)
            known.append((order, y))
    odds = token_odds(known)
    xs, ys, ws = [], [], []
    for order, y in known:
        own = np.array([sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in order], float)
        use = (y >= 0) & np.array([n.tag not in NEVER for n in order])
        xs.append(features(order, odds)[use])
        ys.append(y[use].astype(float))
        ws.append(0.3 + np.log1p(own[use]))
    out = Trees().fit(np.vstack(xs), np.concatenate(ys), np.concatenate(ws))
    out.tokens = odds
    return out


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", trees: Trees | None = None) -> DataFrame:
    """The key, url, text and n_chars of each row."""
    if trees is None:
        some = pages.select(F.col(html).alias("h"), F.xxhash64(F.col(key)).alias("k")).where(F.length("h").between(1, SAMPLE_CHARS))
        share = min(1_000_000, -(-4 * SAMPLE_PAGES * 1_000_000 // max(1, some.count())))
        some = some.where(F.pmod("k", F.lit(1_000_000)) < share)  # so that a task sends its share alone
        trees = train([r["h"] for r in some.orderBy("k", "h").limit(SAMPLE_PAGES).select("h").collect()])
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts):
                out = extract_all(texts[a:b], trees)
                part = batch.slice(a, b - a)
                cols = [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = rows.mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"key": key, "url": url})


def op7_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_extract": op7_extract}
ORACLE_SQL: dict[str, str] = {}
