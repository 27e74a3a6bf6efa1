"""Main text of web pages from a tree-structured graphical model over DOM nodes.

Every block element is a binary variable (content or not). Unary potentials come from tag, class, text and link
features; one 2x2 table of potentials connects each node to its parent. Sum-product messages, upward from the leaves and
downward from the root, give exact marginals, for a whole batch of pages at once, one tree level at a time. The weights
maximise the likelihood of labelled pages: a bounded sample of the given pages whose own <article> element labels them,
and a fixed set of layouts whose parts are known. Pages are read where they lie: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, slices, table

#: Given pages that label themselves and are used for training, at most: those with the smallest hashes of their ids.
MAX_TRAIN = 250
#: Bytes of the pages whose messages are passed together.
BYTES = 3_000_000

# Fixed sets of HTML: elements without content, with content that is never text of the page, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template textarea select option button svg iframe object canvas audio video head title".split())
RAW = frozenset("script style noscript template textarea svg iframe title".split())
SELF_CLOSING = frozenset({"svg"})  # elements of another namespace, where a slash before > ends the element
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html div article section main".split())

TAG_GROUPS = ["p", "h", "list", "li", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "table", "quote", "figure", "root", "other"]
_GROUP = {"p": "p", **{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dir": "list", "li": "li", "dt": "li", "dd": "li", "nav": "nav", "header": "header", "hgroup": "h", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "search": "form", "dialog": "aside", "article": "article", "main": "main", "section": "section", "div": "div", "center": "div", **dict.fromkeys("table tbody thead tfoot tr td th".split(), "table"), "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "html": "root", "body": "root"}
#: Words in class, id and role that name what an element is for.
KEYWORDS = {
    "content": r"article|content|entry|post(?!er)|story|body|text|prose|main",
    "nav": r"nav|menu|breadcrumb|toc|pager|pagination|tabs",
    "header": r"header|masthead|banner|topbar|branding|logo",
    "footer": r"foot|copyright|legal|colophon|imprint",
    "side": r"side|rail|widget|related|recommend|trending|popular|promo|teaser|tags|categories",
    "ad": r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|sponsor|commercial|adslot|adbox|dfp",
    "notice": r"cookie|consent|notice|gdpr|alert|privacy|modal|popup|overlay|disclaimer|paywall",
    "comment": r"comment|reply|replies|respond|discussion|disqus|guestbook|review",
    "form": r"form|search|login|signup|subscribe|newsletter|register",
    "share": r"share|social|follow|byline|meta|author-box",
    "hidden": r"hidden|sr-only|visually",
}
_KEY = [re.compile(p, re.I) for p in KEYWORDS.values()]
FEATURES = ["bias", *(f"tag:{g}" for g in TAG_GROUPS), *(f"key:{k}" for k in KEYWORDS), "has text", "text>=25", "text>=80", "text>=250", "links>0.3", "links>0.7", "sub text>=100", "sub links>0.5", "sub empty", "stop mark", "copyright", "sole landmark", "plain page"]
_AT = {f: i for i, f in enumerate(FEATURES)}
_NAMED = [_AT[f"tag:{g}"] for g in ("nav", "header", "footer", "aside", "form", "article", "main")] + [_AT[f"key:{k}"] for k in KEYWORDS]

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
#: A slash before > that ends an unquoted value is no end of the element.
_OWN_END = re.compile(r"(?:^|[\s\"'])/\Z")
#: Deeper blocks become siblings, as in browsers, which stop at a similar depth.
MAX_DEPTH = 256
#: After so many tags of a page whose quotes leave no end to the tag, the next > ends a tag, quoted or not.
OPEN_QUOTES = 8
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Marks the parts of built-in layouts; read while training only.
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_LABEL = re.compile(r'phaseloom-content="([01])"')
#: Stands for the block of elements whose content is never text of the page.
MUTED = -2


@dataclass
class Tree:
    """Block elements of one page in page order; a node's parent comes before it. text: (node, piece of text)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    text: list[tuple[int, str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)


def _attributes(source: str) -> str:
    words = []
    for m in _ATTR.finditer(source):
        value = m[2] or m[3] or m[4] or ""
        words.append("hidden" if "hidden" in m[1].lower() and value != "false" else value)
    return " ".join(words)


class _Open:
    """Open elements, inline ones too, as (name, block they stand in); where each name, block and scope was opened."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.scopes: list[int] = [0]
        self.links = 0

    def push(self, name: str, node: int) -> None:
        k = len(self.stack)
        self.stack.append((name, node))
        self.at.setdefault(name, []).append(k)
        if name in BLOCK:
            self.blocks.append(k)
        if name in SCOPE or node == MUTED:
            self.scopes.append(k)
        self.links += name == "a"

    def last(self, name: str) -> int:
        """Place of the innermost open element of that name; 0 if none is open."""
        found = self.at.get(name)
        return found[-1] if found else 0

    def close(self, k: int) -> bool:
        """End the elements from place k on; True if a block is among them."""
        block = self.blocks[-1] >= k
        for name, _ in self.stack[k:]:
            self.at[name].pop()
            self.links -= name == "a"
        for places in (self.blocks, self.scopes):
            while places[-1] >= k:
                places.pop()
        del self.stack[k:]
        return block


def parse(source: str, labelled: bool = False) -> Tree:
    """A forgiving parse in linear time: unclosed and misnested elements end where a browser would end most of them.

    The content of buttons, menus of choices, embedded objects and media is left out. A tag without an end is text.
    labelled: read the labels of built-in layouts.
    """
    tree = Tree([-1], ["html"], [""], [], [0], [0], [0])
    open_ = _Open()
    at, n, last_end, unclosed = 0, len(source), source.rfind(">"), 0
    gap = (-1, "")

    def say(piece: str) -> None:
        node = open_.stack[-1][1]
        if node == MUTED or not piece:
            return
        tree.text.append((node, piece))
        if open_.links:
            tree.linked[node] += len(piece.strip())

    def tag_end(start: int) -> int:
        """Place of the > that ends the tag; one in quotes does not, unless the quotes leave no other."""
        nonlocal unclosed
        place = start
        while unclosed < OPEN_QUOTES and (m := _STOP.search(source, place)):
            if m[0] == ">":
                return m.start()
            place = source.find(m[0], m.end()) + 1
            if not place:
                break
        unclosed += 1
        return source.find(">", start)

    while at < n:
        start = source.find("<", at)
        while start >= 0:
            if source.startswith("<!--", start):
                break
            if start > last_end:
                start = -1
            elif source.startswith(("<!", "<?"), start) or _NAME.match(source, start):
                break
            else:
                start = source.find("<", start + 1)
        if start < 0:
            say(source[at:])
            break
        say(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = _NAME.match(source, start)
        if m is None:
            at = source.find(">", start) + 1
            continue
        end = tag_end(m.end())
        at, name, attrs = end + 1, m[2].lower(), source[m.end() : end]
        if m[1]:
            k = open_.last(name)
            if name == "br" or name == "p" and not k:
                tree.text.append(gap)
            elif k and (name in BLOCK or name in DROPPED or k > open_.blocks[-1]) and open_.close(k):
                tree.text.append(gap)
            continue
        if name in RAW:
            if name not in SELF_CLOSING or not attrs.endswith("/"):
                found = _RAW_END[name].search(source, at)
                at = found.end() if found else n
            continue
        if name in ("html", "head"):
            if labelled and (label := _LABEL.search(attrs)):
                tree.label[0] = int(label[1])
            continue
        if name in VOID:
            if name in ("br", "hr"):
                tree.text.append(gap)
            continue
        if name in DROPPED:
            open_.push(name, MUTED)
            continue
        if name in BLOCK:
            ends = IMPLIED_END.get(name, frozenset())
            while (k := max(map(open_.last, (*ends, "p")))) > open_.scopes[-1]:
                if open_.close(k):
                    tree.text.append(gap)
                if name not in ends:
                    break
            above = open_.stack[-1][1]
            if above == MUTED:
                open_.push(name, MUTED)
                continue
            label = _LABEL.search(attrs) if labelled and attrs else None
            if tree.depth[above] == MAX_DEPTH:
                above = tree.parent[above]
            tree.parent.append(above)
            tree.depth.append(tree.depth[above] + 1)
            tree.tag.append(name)
            tree.marks.append(_attributes(attrs) if attrs else "")
            tree.linked.append(0)
            tree.label.append(tree.label[above] if label is None else int(label[1]))
            tree.text.append(gap)
            open_.push(name, len(tree.tag) - 1)
        elif not _OWN_END.search(attrs):
            open_.push(name, open_.stack[-1][1])
    return tree


def _by_depth(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes at each depth, in order."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


@dataclass
class Forest:
    """Nodes of many pages; levels[d]: nodes at depth d."""

    parent: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray
    label: np.ndarray


def forest(trees: list[Tree], masked: bool = False) -> Forest:
    """Node features; masked: tags that name the content by themselves count as plain ones."""
    first = np.cumsum([0, *(len(t.tag) for t in trees)])
    n = int(first[-1])
    parent, depth = np.full(n, -1), np.array([d for t in trees for d in t.depth], int)
    own, linked = np.zeros(n), np.zeros(n)
    x = np.zeros((n, len(FEATURES)))
    x[:, _AT["bias"]] = 1
    for t, lo in zip(trees, first, strict=False):
        for i, tag in enumerate(t.tag):
            k = lo + i
            if t.parent[i] >= 0:
                parent[k] = lo + t.parent[i]
            group = _GROUP.get(tag, "other")
            if masked and group in ("article", "main", "section"):
                group = "div"
            x[k, _AT[f"tag:{group}"]] = 1
            if t.marks[i]:
                for j, key in enumerate(_KEY):
                    if key.search(t.marks[i]):
                        x[k, 1 + len(TAG_GROUPS) + j] = 1
            linked[k] = t.linked[i]
        here = slice(lo, lo + len(t.tag))
        if not (x[here][:, _NAMED].any() or linked[here].any()):  # nothing that names a part of the page, no link
            x[here, _AT["plain page"]] = 1
        if not masked:
            for name in ("article", "main"):
                if t.tag.count(name) == 1:
                    x[lo + t.tag.index(name), _AT["sole landmark"]] = 1
        for i, piece in t.text:
            if i >= 0:
                s = piece.strip()
                own[lo + i] += len(s)
                if s.endswith((".", "!", "?")):
                    x[lo + i, _AT["stop mark"]] = 1
                if "©" in s or "&copy;" in s:
                    x[lo + i, _AT["copyright"]] = 1
    levels = _by_depth(depth)
    sub, sub_linked = own.copy(), linked.copy()
    for level in levels[:0:-1]:
        np.add.at(sub, parent[level], sub[level])
        np.add.at(sub_linked, parent[level], sub_linked[level])
    for name, value in {
        "has text": own > 0, "text>=25": own >= 25, "text>=80": own >= 80, "text>=250": own >= 250, "links>0.3": linked > 0.3 * own, "links>0.7": linked > 0.7 * own,
        "sub text>=100": sub >= 100, "sub links>0.5": sub_linked > 0.5 * sub, "sub empty": sub == 0,
    }.items():
        x[:, _AT[name]] = value
    return Forest(parent, levels, x, np.concatenate([*(np.array(t.label) for t in trees), np.zeros(0, int)]))


@dataclass
class TreeModel:
    """unary: weights of the features for state 1; edge[p, c]: potential of parent state p and child state c, as logarithms."""

    unary: np.ndarray
    edge: np.ndarray

    def infer(self, f: Forest) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of state 1, marginals of (parent state, child state), and the log partition function."""
        n = len(f.parent)
        own = np.stack([np.zeros(n), f.features @ self.unary], 1)
        up, sent = own.copy(), np.zeros((n, 2))
        for level in f.levels[:0:-1]:
            sent[level] = np.logaddexp(self.edge[None, :, 0] + up[level, :1], self.edge[None, :, 1] + up[level, 1:])
            for k in (0, 1):
                np.add.at(up[:, k], f.parent[level], sent[level, k])
        belief = up.copy()
        pair = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            above = belief[f.parent[level]] - sent[level]
            both = above[:, :, None] + self.edge[None] + up[level][:, None, :]
            pair[level] = both
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
        total = np.logaddexp(belief[:, 0], belief[:, 1])
        inner = f.parent >= 0
        pair[inner] = np.exp(pair[inner] - total[inner, None, None])
        return np.exp(belief[:, 1] - total), pair, float(total[~inner].sum())


def train_model(f: Forest, rounds: int = 350, l2: float = 3e-5) -> TreeModel:
    """Adam on the log-likelihood of the labels; its gradient is observed minus expected counts."""
    y, inner = f.label.astype(float), f.parent >= 0
    model = TreeModel(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    seen = f.features.T @ y
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (f.label[f.parent[inner]], f.label[inner]), 1)
    n = max(len(y), 1)
    moment, square = np.zeros(len(FEATURES) + 4), np.zeros(len(FEATURES) + 4)
    for t in range(1, rounds + 1):
        one, pair, _ = model.infer(f)
        grad = np.append((seen - f.features.T @ one) / n - l2 * model.unary, ((pairs - pair[inner].sum(0)) / n - l2 * model.edge).ravel())
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        model.unary += move[:-4]
        model.edge += move[-4:].reshape(2, 2)
    return model


_SPACE = re.compile(r"\s+")


def extract(trees: list[Tree], model: TreeModel) -> list[str]:
    """Text of the nodes that are content likelier than not, in page order."""
    f = forest(trees)
    chosen = model.infer(f)[0] >= 0.5
    out, lo = [], 0
    for t in trees:
        parts, gap = [], False
        for node, piece in t.text:
            if node < 0:
                gap = True
            elif chosen[lo + node]:
                if gap:
                    parts.append(" ")
                    gap = False
                parts.append(piece)
            else:
                gap = True
        out.append(" ".join(html.unescape("".join(parts)).split()))
        lo += len(t.tag)
    return out


# --- labelled pages ---------------------------------------------------------------------------------------------------


def layouts(count: int = 160, seed: int = 11) -> list[str]:
    """Pages in varied layouts whose parts carry labels: 1 for content, 0 for the rest."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    words = lambda n: " ".join("".join(pick(*"abcdefghijklmnoprstuvw") for _ in range(int(rng.integers(2, 9)))) for _ in range(n)).capitalize()
    sentence = lambda: words(int(rng.integers(4, 18))) + pick(".", ".", "!", "?")
    para = lambda: " ".join(sentence() for _ in range(int(rng.integers(1, 6))))
    link = lambda: f'<a href="/{words(1)}">{words(int(rng.integers(1, 5)))}</a>'
    many = lambda f, lo, hi: "".join(f() for _ in range(int(rng.integers(lo, hi))))
    items = lambda lo=3, hi=9: "<ul>" + many(lambda: f"<li>{link()}</li>", lo, hi) + "</ul>"
    mark = lambda names: pick(f' class="{names}"', f' id="{names}"', f' class="x {names} y"')
    plain = lambda n: pick("", "", mark(n))

    def inside() -> str:
        p = lambda: pick(f"<p>{para()}</p>", f"<p>{para()}", f"<p><b>{words(2)}</b> {para()} {link()} {sentence()}</p>", f"<p><b>{sentence()}<br>", f"<div>{para()}</div>")
        extra = lambda: pick(f"<h2>{words(3)}</h2>", f"<blockquote>{pick('', '<p>')}{para()}</blockquote>", "<ul>" + many(lambda: f"<li>{sentence()}</li>", 2, 5) + "</ul>", f"<pre>{words(8)}</pre>", f"<table><tr><td>{words(2)}</td><td>{words(2)}</td></tr></table>", f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>", "")
        noise = lambda: pick("", "", "", f'<div phaseloom-content="0"{mark(pick("advert", "ad", "ads", "ad-slot", "sponsored", "promo"))}>{para()}</div>', f'<aside phaseloom-content="0">{para()}</aside>', f'<div phaseloom-content="0"{mark(pick("share", "social-share"))}>{items(2, 4)}</div>', f'<div phaseloom-content="0"{mark("related")}><h3>{words(2)}</h3>{items(2, 5)}</div>')
        return pick(f"<h1>{words(5)}</h1>", f"<h1>{sentence()}</h1>", f"<header><h1>{words(4)}</h1></header>") + many(lambda: p() + extra() + noise(), 1, 8)

    out = []
    for _ in range(count):
        tag = pick("article", "article", "article", "main", "section", "div", "div", "div")
        names = pick("post", "entry-content", "article-body", "story", "content", "post-body", "text") if tag in ("div", "section") else pick("", "", "post", "content")
        content = f'<{tag}{mark(names) if names else ""} phaseloom-content="1">{inside()}</{tag}>'
        nav = lambda: pick(f"<nav>{items()}</nav>", f'<div{mark(pick("menu", "navbar", "navigation", "breadcrumbs"))}>{items()}</div>', f'<ul{mark("menu")}>' + many(lambda: f"<li>{link()}", 3, 8) + "</ul>")
        header = lambda: pick("", f"<header>{words(3)}{nav()}</header>", f'<div{mark(pick("header", "masthead", "top-banner"))}><h2>{words(2)}</h2><p>{sentence()}</p></div>')
        side = lambda: pick(f"<aside{plain('sidebar')}><h3>{words(2)}</h3>{items()}<p>{para()}</p></aside>", f'<div{mark(pick("sidebar", "widget", "right-rail"))}><h3>{words(2)}</h3><p>{para()}</p>{items()}</div>')
        notice = lambda: f'<div{mark(pick("cookie-notice", "cookie", "consent-banner", "notice", "gdpr", "alert", "privacy-notice"))}>{pick("<p>", "")}{para()}{pick("", link())}</div>'
        frame = pick("div", "div", "section", "aside")
        ad = lambda: f'<{frame}{mark(pick("ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "sponsor"))}>{pick("<p>", "")}{pick(para, sentence)()}</{frame}>'
        form = lambda: pick(f"<form><p>{sentence()}</p><label>{words(2)}</label><input></form>", f'<div{mark(pick("newsletter", "search", "login-form", "subscribe"))}><h4>{words(2)}</h4><form><label>{words(2)}</label><input name=q></form></div>')
        each = lambda: pick(f"<li><p>{para()}</p></li>", f'<div{mark("comment")}><b>{words(1)}</b><p>{para()}</p></div>', f"<article{mark('comment')}><p>{para()}</p></article>", f"<p>{para()}</p>")
        box = pick("div", "section", "section", "ol", "aside")
        comments = lambda: f'<{box}{mark(pick("comments", "comment-list", "comments-area", "replies", "discussion", "disqus_thread", "responses comments"))}>{pick("", f"<h2>{words(2)}</h2>", f"<h3>{words(3)}</h3>")}{many(each, 1, 6)}</{box}>'
        footer = lambda: pick(f"<footer>{para()}</footer>", f"<footer><p>&copy; {words(2)}</p>{items(2, 5)}</footer>", f"<footer>&copy; {words(1)} &middot; {sentence()}</footer>", f'<div{mark(pick("footer", "copyright", "site-footer"))}><p>{sentence()}</p></div>')
        some = lambda *fs: "".join(f() for f in fs if rng.random() < 0.5)
        wrap = pick(("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page"><div class="container">', "</div></div>"), ("<main>", "</main>"), ('<div class="row">', "</div>"))
        parts = some(notice, header, nav, ad) + wrap[0] + some(nav, ad, side, form) + content + some(comments, comments, side, ad, form) + wrap[1] + some(side, notice, comments) + some(footer, footer)
        out.append(f'<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{x:y}}</style></head><body phaseloom-content="0">{parts}<script>var a="<p>";</script></body></html>')
    # Short pages: an article of a few words, or nothing but a paragraph or two.
    few = lambda: words(int(rng.integers(1, 4))) + pick("", ".", "###")
    for _ in range(count // 4):
        short = pick(f"<h1>{few()}</h1><p>{few()}", f"<h1>{few()}</h1><p><b>{few()}<br>", f"<p>{few()}</p>", f"<h1>{few()}</h1>", f"<h2>{few()}</h2><p>{sentence()}</p>", few())
        edge_top = pick("", f"<nav>{items()}</nav>", f"<header>{words(3)}<nav>{items()}</nav></header>", f'<div{mark("menu")}>{items()}</div>')
        edge_end = pick("", f"<footer>&copy; {words(2)}</footer>", f'<div{mark("cookie-notice")}><p>{para()}</p></div>', f"<aside><h3>{words(2)}</h3>{items()}</aside>")
        out.append(f'<html><body phaseloom-content="0">{edge_top}<article phaseloom-content="1">{short}</article>{edge_end}</body></html>')
        bare = pick(para, few)()
        bare = pick(bare, bare, bare, f"<p>{bare}", f"<p>{bare}</p><p>{para()}</p>", f"<div>{bare}</div>", f"<h1>{few()}</h1><p>{bare}</p>", f"<div><p>{bare}</p><p>{para()}</p><p>{para()}</p></div>", f"<ul><li>{bare}<li>{few()}</ul>")
        out.append(f'<html phaseloom-content="1">{pick("", "", "<body>")}{bare}')
    return out


def self_labelled(source: str) -> Tree | None:
    """A page with exactly one <article>, which is its content but for parts of it that name themselves something else."""
    tree = parse(source)
    where = [i for i, t in enumerate(tree.tag) if t == "article"]
    if len(where) != 1:
        return None
    other = [k for k, name in zip(_KEY, KEYWORDS, strict=True) if name not in ("content", "header")]
    for i, p in enumerate(tree.parent):
        is_other = tree.tag[i] in ("nav", "aside", "form", "footer", "menu", "dialog") or tree.marks[i] and any(k.search(tree.marks[i]) for k in other)
        tree.label[i] = int(i == where[0] or p >= 0 and tree.label[p] and not is_other)
    return tree


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_train: int = MAX_TRAIN) -> TreeModel:
    """Fit on the layouts and on at most max_train of the given pages; a quarter of the layouts with content tags masked.

    The pages are those with the smallest hashes of their ids; rows with a null id or html teach nothing. They are parsed
    whole, on the executors; the driver gets a byte for each feature of their nodes.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("id").isNotNull() & F.col("html").isNotNull())
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_train)
    chosen = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html"))  # one page for each id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html", BYTES):
                for i, source in zip(b.column("id"), b.column("html").to_pylist(), strict=True):
                    if tree := self_labelled(source):
                        f = forest([tree])
                        packed = [pa.array([x.tobytes()], pa.binary()) for x in (f.parent.astype(np.int32), f.features.astype(np.uint8), f.label.astype(np.uint8))]
                        yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.column("id").type), *packed], names=["id", "parent", "features", "label"])

    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), *(T.StructField(c, T.BinaryType()) for c in ("parent", "features", "label"))])
    given = []
    for r in chosen.mapInArrow(run, schema).orderBy("id").collect():  # max_train rows at most
        parent = np.frombuffer(r["parent"], np.int32).astype(np.int64)
        given.append(Forest(parent, _levels(parent), np.frombuffer(r["features"], np.uint8).reshape(len(parent), -1).astype(float), np.frombuffer(r["label"], np.uint8).astype(int)))
    return train_model(_training(given))


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes at each depth; a node's parent comes before it."""
    depth = np.zeros(len(parent), int)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    return _by_depth(depth)


def training_forest(given: list[Tree]) -> Forest:
    return _training([forest(given)])


def _training(given: list[Forest]) -> Forest:
    known = [parse(x, labelled=True) for x in layouts()]
    return _joined([forest(known[::4], True), *(forest(known[k::4]) for k in (1, 2, 3)), *given])


def _joined(parts: list[Forest]) -> Forest:
    lo, parents, depth = 0, [], max((len(p.levels) for p in parts), default=0)
    levels: list[list[np.ndarray]] = [[] for _ in range(depth)]
    for p in parts:
        parents.append(np.where(p.parent >= 0, p.parent + lo, -1))
        for d, level in enumerate(p.levels):
            levels[d].append(level + lo)
        lo += len(p.parent)
    return Forest(np.concatenate(parents), [np.concatenate(x) for x in levels], np.concatenate([p.features for p in parts]), np.concatenate([p.label for p in parts]))


def main_text(pages: DataFrame, model: TreeModel, html_col: str = "html") -> DataFrame:
    """pages with main_text, one row for each row; a null or empty page has an empty one. A column of that name is replaced."""
    pages = pages.drop("main_text")
    schema = T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, html_col, BYTES):
                out = extract([parse(x or "") for x in b.column(html_col).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "main_text"])
        give_back()

    return pages.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = main_text(pages, train(pages))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
