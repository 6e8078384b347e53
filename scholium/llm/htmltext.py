"""Main-text extraction: gradient-boosted trees over DOM-node features, with hierarchical decoding.

A page is read into a tree by a small, forgiving tokenizer. Each element gets features: its tag's kind, tokens of its id,
class and role, depth, position among its siblings, and densities (text, links, tags) of its subtree. Boosted trees give the
log odds that the node belongs to the article; a dynamic programme over the tree then picks the most likely labelling in
which no kept node stands under a dropped one. The trees are fitted by Spark ML on a bounded set (``PAGES``) of generated
pages of many layouts, whose labels are known; no page of the corpus is needed.

The generated pages mix named boxes with boxes whose names say nothing and layout tables, so that text and link densities
decide where names do not. Null and empty html: empty text. Unclosed and stray tags are tolerated: a tag ends at the next
``<`` at the latest, outside quotes. Repeated rows and rows without an id get a row each; pages without any kept text have an
empty text; ties between keeping and dropping a node drop it. Very long and very deep pages are read in one pass without
recursion. Empty tables give empty results; further columns are ignored.
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
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Generated pages to learn from, and the size of the model.
PAGES, TREES, TREE_DEPTH, SEED = 720, 24, 5, 7
#: What a change from kept to dropped costs in decoding, in log odds.
CHANGE = 1.5
#: Log odds down to which prose counts as not ruled out.
DOUBT = -4.0

#: Quoted values may hold any character; outside quotes a tag cannot hold another's start. No repetition gives characters back.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"))
RAW_END = {tag: re.compile(rf"</{tag}\s*>?", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose long texts (this many characters) count as prose.
PROSE, LONG_TEXT = frozenset(("p", "td", "div", "blockquote", "section", "article", "main")), 60
#: An open element of the first kind is closed by the start of the second.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = frozenset(("ul", "ol", "dl", "table", "select"))
KINDS = {
    "main": "article main", "heading": "h1 h2 h3 h4 h5 h6", "para": "p blockquote pre", "list": "ul ol li dl dt dd menu", "table": "table tbody thead tr td th caption",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form input button select label fieldset option textarea", "code": "script style noscript template iframe svg head title link meta",
    "box": "div section body html", "inline": " ".join(sorted(INLINE)), "media": "img figure figcaption picture video audio canvas",
}
KIND_OF = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
#: Words in id, class and role, by what they hint at.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pager pagination tabs sitemap skip links",
    "head": "header masthead banner logo branding top hero",
    "foot": "footer foot copyright colophon legal bottom contentinfo",
    "side": "sidebar side aside widget widgets related recommended trending popular rail complementary teaser more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast announcement disclaimer",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promoted promotion dfp banner-ad adsense",
    "form": "form search newsletter subscribe signup login register subscription",
    "social": "share sharing social follow like tweet",
    "comment": "comment comments reply replies discussion disqus respond thread reader",
    "main": "article content main post entry story body text page prose markdown articlebody",
}
HINT_OF = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
N_KINDS, N_HINTS = len(KINDS), len(HINTS)
MAIN, OTHER_PARTS = list(HINTS).index("main"), frozenset(("nav", "header", "footer", "aside", "form", "button"))
#: What a node inherits: whether an ancestor is of these kinds or hints.
COLUMNS = [*(f"tag_{k}" for k in KINDS), *(f"hint_{k}" for k in HINTS), *(f"under_{k}" for k in KINDS), *(f"under_{k}" for k in HINTS), "depth", "index", "siblings", "from_end", "chars", "link_share", "chars_per_tag", "tags", "page_share", "punctuation", "parent_share", "para_chars", "para_share", "around_para", "up_para_share", "up_link_share", "up_chars", "up_page_share"]


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    hints: tuple[int, ...]
    label: int = -1
    children: list[int] = field(default_factory=list)
    #: The page's text in order: (node, text) is kept apart, in ``Page.parts``.


@dataclass
class Page:
    nodes: list[Node]
    parts: list[tuple[int, str | None]]  # (node, text); None is a border between blocks


def hints_of(attributes: str) -> tuple[tuple[int, ...], int]:
    found, label = set(), -1
    for name, *values in ATTRIBUTE.findall(attributes):
        low = name.lower()
        if low in ("class", "id", "role", "aria-label", "itemprop"):
            for token in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(values)).lower()):
                if token in HINT_OF:
                    found.add(HINT_OF[token])
        elif low == "data-truth":
            label = int("".join(values))
    return tuple(sorted(found)), label


class Open:
    """The stack of open elements. Where the next block, inline element or list item of a name is open is known without a search,
    so that each step costs as much as what it closes."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack = nodes, [0]
        #: Places in the stack of the open blocks and of the open items and their holders, and open elements by name.
        self.blocks, self.items = [0], []
        self.named: dict[str, int] = {}
        #: For each open block the inline elements open in it, by name.
        self.inline: list[dict[str, int]] = [{}]

    def push(self, node: int) -> None:
        tag, at = self.nodes[node].tag, len(self.stack)
        self.stack.append(node)
        if tag in INLINE:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
            return
        self.blocks.append(at)
        self.inline.append({})
        self.named[tag] = self.named.get(tag, 0) + 1
        if tag in CLOSED_BY or tag in HOLDERS:
            self.items.append(at)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.nodes[self.stack.pop()].tag
            if tag in INLINE:
                self.inline[-1][tag] -= 1
                continue
            self.blocks.pop()
            self.inline.pop()
            self.named[tag] -= 1
            if self.items and self.items[-1] == len(self.stack):
                self.items.pop()

    def close(self, tag: str) -> bool:
        """Close the innermost element of this name; an inline one only inside the innermost block."""
        if not (self.inline[-1] if tag in INLINE else self.named).get(tag):
            return False
        while self.nodes[self.stack[-1]].tag != tag:
            self.cut(len(self.stack) - 1)
        self.cut(len(self.stack) - 1)
        return True

    def make_room(self, tag: str) -> None:
        """Close what the start of ``tag`` closes: an open paragraph, an open item of the same list."""
        if tag in CLOSES_P and self.nodes[self.stack[self.blocks[-1]]].tag == "p":
            self.cut(self.blocks[-1])
        for at in reversed(self.items if tag in CLOSED_BY else ()):
            open_tag = self.nodes[self.stack[at]].tag
            if open_tag in CLOSED_BY[tag]:
                return self.cut(at)
            if open_tag in HOLDERS:
                return None
        return None


def parse(page: str) -> Page:
    nodes, parts = [Node("", -1, 0, ())], []
    around = Open(nodes)
    at, end = 0, len(page)
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            parts.append((around.stack[-1], page[at:stop]))
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        m = TAG.match(page, at) or PLAIN_TAG.match(page, at)
        if m is None:  # a lone "<", or the start of an unfinished tag
            parts.append((around.stack[-1], page[at]))
            at += 1
            continue
        at = m.end()
        closing, tag, attributes = m.groups()
        tag, selfclosed = tag.lower(), attributes.endswith("/") and attributes[-2:-1] in ("", " ", '"', "'", "\n", "\t")
        block = tag not in INLINE
        if closing:
            before = around.stack[-1]
            if around.close(tag) and block:
                parts.append((before, None))
            continue
        if block:
            parts.append((around.stack[-1], None))
        around.make_room(tag)
        if tag in ("html", "body") and any(n.tag == tag for n in nodes[1:3]):
            continue
        hints, label = hints_of(attributes) if attributes else ((), -1)
        up = around.stack[-1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, hints, label))
        nodes[up].children.append(len(nodes) - 1)
        if tag in RAW and not selfclosed:
            stop = RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not selfclosed:
            around.push(len(nodes) - 1)
    return Page(nodes, parts)


def features(page: Page) -> np.ndarray:
    """(nodes, ``COLUMNS``), the root left out."""
    nodes, n = page.nodes, len(page.nodes)
    chars, links, tags, marks, paras = np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    linked, told = [False] * n, [False] * n
    for i in range(1, n):
        tag, up = nodes[i].tag, nodes[i].parent
        linked[i] = tag == "a" or linked[up]
        told[i] = tag in PROSE or (told[up] and tag in INLINE)
    for i, text in page.parts:
        if text is not None and (size := len(text.strip())):
            chars[i] += size
            marks[i] += text.count(".") + text.count(",")
            if linked[i]:
                links[i] += size
            elif told[i] and size >= LONG_TEXT:
                paras[i] += size
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i]
        marks[up] += marks[i]
        paras[up] += paras[i]
    x = np.zeros((n, len(COLUMNS)), np.float32)
    a, b = N_KINDS + N_HINTS, 2 * (N_KINDS + N_HINTS)
    for i in range(1, n):
        node = nodes[i]
        if (kind := KIND_OF.get(node.tag)) is not None:
            x[i, kind] = 1
        for h in node.hints:
            x[i, N_KINDS + h] = 1
        up = node.parent
        x[i, a:b] = np.maximum(x[up, a:b], x[up, :a])
        for k, child in enumerate(node.children):
            x[child, b + 1 : b + 4] = math.log1p(k), math.log1p(len(node.children)), math.log1p(len(node.children) - 1 - k)
        x[i, b] = node.depth
    x[:, b + 4] = np.log1p(chars)
    x[:, b + 5] = links / np.maximum(chars, 1)
    x[:, b + 6] = np.log1p(chars / tags)
    x[:, b + 7] = np.log1p(tags)
    x[:, b + 8] = chars / max(chars[0], 1)
    x[:, b + 9] = marks / np.maximum(chars, 1)
    above = np.array([max(node.parent, 0) for node in nodes])
    x[:, b + 10] = chars / np.maximum(chars[above], 1)
    x[:, b + 11] = np.log1p(paras)
    x[:, b + 12] = paras / max(paras[0], 1)
    x[:, b + 13] = np.log1p(paras[above] - paras)
    for k, of in enumerate((12, 5, 4, 8)):
        x[:, b + 14 + k] = x[above, b + of]
    return x[1:]


def decoded(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the most likely labelling in which a dropped node has only dropped descendants.

    A node's weight grows with the text that is its own, so that empty wrappers follow what they hold. To drop a node under a
    kept one costs ``CHANGE``, so that a paragraph in doubt goes with its neighbours; nodes that say what they are by a hint or a tag of
    other parts of a page are no such paragraphs. Where a page would lose all its text
    although some of its prose was not clearly ruled out (``DOUBT``), the bar is lowered to the best of that prose.
    """
    nodes, n = page.nodes, len(page.nodes)
    own, prose = np.ones(n), np.zeros(n, bool)
    for i, text in page.parts:
        if text is not None:
            size = len(text.strip())
            own[i] += min(size, 200) / 50
            prose[i] |= size >= LONG_TEXT and nodes[i].tag != "a"

    cost = np.array([0.0 if node.tag in OTHER_PARTS or any(h != MAIN for h in node.hints) else CHANGE for node in nodes])

    def best_labels(odds: np.ndarray) -> list[bool]:
        gain = np.zeros(n)
        gain[1:] = odds * own[1:]
        best = gain.copy()
        for i in range(n - 1, 0, -1):
            best[nodes[i].parent] += max(best[i], -cost[i])
        kept = [True] + [False] * (n - 1)
        for i in range(1, n):
            kept[i] = kept[nodes[i].parent] and best[i] > -cost[i]
        return kept

    kept = best_labels(odds)
    if prose.any() and not any(kept[i] and text and not text.isspace() for i, text in page.parts if i):
        top = odds[prose[1:]].max(initial=-math.inf)
        if top > DOUBT:
            kept = best_labels(odds - top + 1)
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    blocks, now = [], []
    for i, text in page.parts:
        if text is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif kept[i]:
            now.append(text)
    blocks.append("".join(now))
    return SPACE.sub(" ", " ".join(html.unescape(b).replace("\xa0", " ") for b in blocks)).strip(" ")


class Trees:
    """Fitted trees as arrays, for whole batches of nodes."""

    def __init__(self, trees: list[tuple[list[int], list[float], list[int], list[int], list[float]]], weights: list[float]):
        self.trees, self.weights = [tuple(np.array(x) for x in t) for t in trees], weights

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (column, bound, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                inner = column[at] >= 0
                low = x[np.arange(len(x)), np.maximum(column[at], 0)] <= bound[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += weight * value[at]
        return 2 * total


def exported(model) -> Trees:
    def walk(node, out) -> int:
        k = len(out[0])
        for x, v in zip(out, (-1, 0.0, 0, 0, float(node.prediction()))):
            x.append(v)
        if hasattr(node, "split") and "InternalNode" in node.getClass().getSimpleName():
            out[0][k], out[1][k] = node.split().featureIndex(), float(node.split().threshold())
            out[2][k] = walk(node.leftChild(), out)
            out[3][k] = walk(node.rightChild(), out)
        return k

    trees = []
    for tree in model.trees:
        out = ([], [], [], [], [])
        walk(tree._java_obj.rootNode(), out)
        trees.append(out)
    return Trees(trees, list(model.treeWeights))


def generated(seed: int) -> str:
    """A page of a random layout; ``data-truth`` marks what belongs to the article (1) and what does not (0)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice((".", ".", "", "!"))
    brief = r.random() < 0.2
    prose = lambda: say(r.randint(1, 9)) if brief else " ".join(say(r.randint(3, 18)) for _ in range(r.randint(1, 9)))
    pick = lambda key: r.choice([w for w in HINTS[key].split()])

    # Some sites name their boxes by what they are, some at random, some not at all; a site may mix the ways.
    telling = r.choice((1.0, 1.0, 0.7, 0.3, 0.0, 0.0, 0.0))
    bare = telling < 0.5
    code = lambda: "".join(r.choice("abcdefghjkqrvwxz0123456789") for _ in range(r.randint(3, 7)))

    def named(*keys: str) -> str:
        if r.random() >= telling:
            return r.choice(("", "", f' class="{code()}"', f' class="{code()} {code()}"', f' id="{code()}"'))
        return f' {r.choice(("class", "id", "class"))}="{r.choice(("", "", "site-", "js ", "u-"))}{pick(r.choice(keys))}{r.choice(("", "", "-box", "-wrap", " x1"))}"'

    def links(n: int) -> str:
        return "".join(f'<li data-truth="0"><a data-truth="0" href="/{word()}">{say(r.randint(1, 3))}</a></li>' for _ in range(n))

    def noise(keys: tuple[str, ...], tags: tuple[str, ...], body: str) -> str:
        tag = r.choice(tags) if r.random() < telling + 0.4 else r.choice(("div", "div", "section", "ul" if body.startswith("<li") else "div"))
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        return f'<{tag}{"" if plain else named(*keys)} data-truth="0">{body}</{tag}>'

    p = lambda text: f'<p data-truth="0">{text}</p>'
    menu = noise(("menu",), ("nav", "div", "nav", "ul"), f'<ul data-truth="0">{links(r.randint(2, 9))}</ul>')
    head = noise(("head",), ("header", "div"), f'<a data-truth="0" href="/">{say(2)}</a>' + (menu if r.random() < 0.5 else "") + (f'<h1 data-truth="0">{say(2)}</h1>' if r.random() < 0.3 else ""))
    foot = noise(("foot",), ("footer", "div", "footer"), r.choice((f"&copy; {say(4)}", p(say(r.randint(3, 9 if bare else 25))), f'<ul data-truth="0">{links(4)}</ul>', say(14) + "\n" + say(9))))
    side = noise(("side",), ("aside", "div", "section"), f'<h3 data-truth="0">{say(2)}</h3>' + f'<ul data-truth="0">{links(6)}</ul>' if bare and r.random() < 0.8 else r.choice((p(prose()), f'<ul data-truth="0">{links(6)}</ul>')))
    note = noise(("notice",), ("div", "section", "aside"), p(say(r.randint(5, 20))) + '<button data-truth="0">OK</button>')
    ad = lambda: noise(("advert",), ("div", "div", "aside", "section"), r.choice((say(r.randint(3, 12 if bare else 20)), say(5) if bare else p(prose()), f'<a data-truth="0" href="x">{say(5)}</a>')))
    form = noise(("form",), ("form", "div", "form"), f'<label data-truth="0">{say(2)}</label><input data-truth="0"><button data-truth="0">{word()}</button>')
    share = noise(("social",), ("div", "ul"), links(3))
    talk = noise(("comment",), ("div", "section", "ol"), f'<h3 data-truth="0">{say(1)}</h3>' + "".join(f'<div{named("comment")} data-truth="0">{p(prose())}</div>' for _ in range(r.randint(1, 5))))

    para = r.choice(("p", "p", "div")) if bare else "p"

    def block() -> str:
        kind = r.random()
        if kind < 0.7:
            text = prose()
            if r.random() < 0.3:
                text = f'{say(4)} <{(t := r.choice(("b", "em", "a", "span", "strong", "i")))} data-truth="1">{say(r.randint(1, 6))}</{t}> {text}'
            if r.random() < 0.15:
                text = f'<b data-truth="1">{text}<br data-truth="1">'
                return f'<p data-truth="1">{text}'
            return f'<{para} data-truth="1">{text}</{para}>'
        if kind < 0.8:
            return f'<h2 data-truth="1">{say(r.randint(1, 7))}</h2>'
        if kind < 0.88:
            return '<ul data-truth="1">' + "".join(f'<li data-truth="1">{say(r.randint(2, 14))}</li>' for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.94:
            return f'<blockquote data-truth="1"><p data-truth="1">{prose()}</p></blockquote>'
        return '<table data-truth="1"><tr data-truth="1">' + "".join(f'<td data-truth="1">{say(r.randint(1, 4))}</td>' for _ in range(3)) + "</tr></table>"

    blocks = [block() for _ in range(r.choice((1, 2, 4, 8, 16, 24)))]
    for extra in (ad(), share, form, note, side):
        if r.random() < 0.2:
            blocks.insert(r.randint(0, len(blocks)), extra)
    title = f'<h1 data-truth="1">{say(r.randint(1, 9))}</h1>'
    if r.random() < 0.2:
        title = f'<header data-truth="1">{title}<p data-truth="1">{say(4)}</p></header>'
    inner = title + "".join(blocks)
    tag = r.choice(("article", "main", "div", "div", "div", "section") if bare else ("article", "article", "article", "main", "div", "section"))
    main = inner if bare and r.random() < 0.2 else f'<{tag}{named("main") if tag in ("div", "section") or r.random() < 0.3 else ""} data-truth="1">{inner}{talk if r.random() < (0.03 if bare else 0.15) else ""}</{tag}>'
    if bare and r.random() < 0.35:
        cells = [f'<td data-truth="0"{named("menu")}>{x}</td>' for x in (menu, f'<ul data-truth="0">{links(4)}</ul>', side) if r.random() < 0.6]
        cells.insert(r.randint(0, len(cells)), f'<td{named("main")} data-truth="1">{inner}</td>')
        rows = [f'<tr data-truth="0"><td data-truth="0" colspan="3">{x}</td></tr>' if x else f'<tr data-truth="1">{"".join(cells)}</tr>' for x in ((head, "", foot) if r.random() < 0.5 else ("",))]
        main = f'<table data-truth="1">{"".join(rows)}</table>'
    for _ in range(r.randint(0, 3) if bare else 0):
        main = f'<div{named("main")} data-truth="1">{main}</div>'
    if r.random() < 0.4:
        main = f'<div{named("main") if r.random() < 0.4 else ""} data-truth="1">{main}{side if r.random() < 0.4 else ""}</div>'
    before = [x for x in (head, menu, note, ad(), ad(), form) if r.random() < 0.55]
    after = [x for x in (side, "" if bare and r.random() < 0.8 else talk, ad(), share, form, foot, foot, note) if r.random() < 0.55]
    if bare and r.random() < 0.2:
        before, after = before[:1], after[:1]
    return f'<!DOCTYPE html><html data-truth="1"><head data-truth="0"><title data-truth="0">{say(3)}</title></head><body data-truth="1">{"".join(before)}{main}{"".join(after)}</body></html>'


def learn(spark: SparkSession, pages: int = PAGES, seed: int = SEED) -> Trees:
    """Trees fitted on the nodes of ``pages`` generated pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                page = parse(generated(seed * 1_000_003 + int(k)))
                x, y = features(page), np.array([n.label for n in page.nodes[1:]])
                known = y >= 0
                yield pd.DataFrame({"x": list(x[known].astype(float)), "label": y[known].astype(float)})

    nodes = spark.range(0, pages, 1, 4).mapInPandas(run, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.4, seed=seed, maxBins=32).fit(nodes.cache())
    nodes.unpersist()
    return exported(model)


def extract(pages: DataFrame, trees: Trees, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Rows ``(page_id, <keep>, text, n_chars)``."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for pdf in batches:
            texts, group, size = [], [], 0

            def flush() -> None:
                if not group:
                    return
                xs = [features(p) for p in group]
                odds = trees.odds(np.concatenate(xs)) if sum(map(len, xs)) else np.zeros(0)
                at = 0
                for page, x in zip(group, xs):
                    texts.append(text_of(page, decoded(page, odds[at : at + len(x)])))
                    at += len(x)
                group.clear()

            for source in pdf["html"]:
                page = parse(source) if isinstance(source, str) else Page([Node("", -1, 0, ())], [])
                group.append(page)
                size += len(page.nodes)
                if size > 20_000:
                    flush()
                    size = 0
            flush()
            yield pdf.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])

    types = dict(pages.dtypes)
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), *keep, F.col(html_col).alias("html"))
    return chosen.mapInPandas(run, ", ".join(["page_id long", *(f"{c} {types[c]}" for c in keep), "text string", "n_chars long"]))


def query(pages: DataFrame) -> DataFrame:
    return extract(pages, learn(pages.sparkSession))
